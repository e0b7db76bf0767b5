import random

import pytest
from brute import WORD, licenses, low, stats, url
from pyspark.sql import functions as F

from loomgrid.llm.licenses import K, PHRASES, TEMPLATES, license_scan, template_rows
from loomgrid.llm.quality import feature_columns, labelled_sample, learn_rules, quality_rules, repeated_trigram_words
from loomgrid.llm.urls import LISTED, Cascade, Level, url_filter

CASES = [None, "", " \t\n", "a", "a b c", "a b c a b c", "x y z\nx y z\n \nq", "UNDER the MIT license! Under\x00the-mit license", "Apache License, Version 2.0 cc-by nc cc by\u00e9 nc", "# * $ a|b <c>\x0b\x0cd", "\u212aelvin under the mit license \u0130 cc by nc", "na " * 4000, "licensed  under the Apache  License (Version 2)"]


def texts():
    rng = random.Random(5)
    out = list(CASES)
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "cc", "by", "nc", "under the mit license"]) + rng.choice([" ", "\n", ".", "  "]) for _ in range(rng.randint(1, 80))))
    return out


def frame(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(3, "a", "x", 1), (None, "b b b b", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int"), rows


def test_quality(spark):
    docs, rows = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = sorted(([r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] for r in quality_rules(docs, labels).collect()), key=str)
    want = sorted(([i, *stats(t), stats(t)[0] < 50 or 100 * stats(t)[4] > 50 * stats(t)[0]] for i, t, *_ in rows), key=str)
    assert got == want


def test_long_text_with_clashing_prefixes(spark):
    """A prefix of four bits meets many hashes, so that whole pairs are sorted; a text of 200,000 words is one row."""
    rng = random.Random(3)
    own = [f"w{rng.randrange(40_000)}" for _ in range(200_000)]
    docs = spark.createDataFrame([("a b c d a b c x y",), (" ".join(own),)], "text string")
    for bits in (0, 60):
        got = [r[0] for r in docs.select(repeated_trigram_words(F.split("text", " "), bits)).collect()]
        assert got == [stats("a b c d a b c x y")[4], stats(" ".join(own))[4]]


def test_quality_verdict(spark):
    """kept and rule against the learned list, applied row by row in Python."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choice(["#$%&|", "ok", "fine"] if bad else ["good", "word", "ok"]) + str(rng.randrange(500)) for _ in range(rng.randint(60, 90)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    rules = learn_rules(labelled_sample(docs, labels, 20_000))
    assert rules
    got = {r.doc_id: r for r in quality_rules(docs, labels).withColumns({f"f_{k}": c for k, c in feature_columns().items()}).collect()}
    for i, r in got.items():
        fits = [n for n, rule in enumerate(rules, 1) if all((r[f"f_{name}"] > at) if side == ">" else (r[f"f_{name}"] <= at) for name, side, at in rule.conditions)]
        assert r.rule == (fits[0] if fits else None) and r.kept == (not r.base_failed and not fits)
    assert sum(r.kept != bool(i % 3) for i, r in got.items()) < 20


def test_quality_learns():
    rng = random.Random(1)
    rows = [(v > 0.7, {"a": v, "b": rng.random()}) for v in (rng.random() for _ in range(600))]
    rules = learn_rules(rows)
    assert rules and all(c[0] == "a" for r in rules for c in r.conditions)
    assert learn_rules([]) == [] and learn_rules([(True, {"a": 1.0})]) == []


def test_quality_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_licenses(spark):
    docs, rows = frame(spark)
    got = sorted(([r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] for r in license_scan(docs).collect()), key=str)
    assert got == sorted(([i, *licenses(t)] for i, t, *_ in rows), key=str)


def brute_spans(text, min_share=0.7, max_shift=3):
    """All matches of k-grams as votes, put together diagonal by diagonal."""
    w, found, labels = WORD.findall(low(text or "")), 0.0, set()
    for _, label, base, need, own in template_rows(PHRASES, TEMPLATES):
        votes = sorted((i - j, i, j) for i in range(len(w) - K + 1) for j in range(need) if w[i : i + K] == own[j : j + K])
        spans = []
        for k, (diag, at, tpos) in enumerate(votes):
            same = k and diag == votes[k - 1][0]
            near = k and not base and diag - votes[k - 1][0] <= max_shift and at - votes[k - 1][1] <= K + max_shift
            if not (same or near):
                spans.append(set())
            spans[-1].add(tpos)
        shares = [len(s) / need for s in spans]
        ok = [x for x in shares if x >= (1 if base else min_share)]
        labels |= {label} if ok else set()
        found = max([found, *(ok if base else shares)])
    return ",".join(sorted(labels)), found


def test_license_spans(spark):
    rng = random.Random(12)
    cases = texts() + ["licensed under cc " * 4, "licensed under cc by nc 4 0", "Licensed under CC BY-NC 4.0 and more"]
    parts = [w for _, t in TEMPLATES for w in (" ".join(t.split()[:4]), " ".join(t.split()[3:9]), t)]
    cases += [" ".join(rng.choice([*parts, "word", "and"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for i, t in enumerate(cases):
        labels, score = brute_spans(t)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-12, t
    assert got[len(texts())] == ("", 0.2)


def test_very_long_text(spark):
    text = "licensed under cc " * 100_000 + "apache license version 2"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (300_004, 1, 300_000, "apache-2")


def test_license_method(spark):
    text = "foo bar. This work is licensed under the GNU General Public License, version 3. And permission is hereby granted free of charge to any nice person obtaining a copy of this software and associated documentation files"
    r = license_scan(spark.createDataFrame([(1, text), (2, "general public")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "gpl-3,mit" and r[0].base_labels == "" and 0.7 < r[0].score <= 1 and r[1].score == 0.0
    assert spark.createDataFrame([], "doc_id long, text string").transform(license_scan).count() == 0


@pytest.mark.parametrize("listed", [LISTED, (), ("ththin.example.com",), tuple(f"h{i}.net" for i in range(0, 300, 3))])
def test_urls(spark, listed):
    urls = [None, "", "x", "http://", "http://ORG/", "http://a.Example.org/es/1?q#z", "https://example.org/en/12", "ftp://b.com/fr/", "http://b.com/de/x", "http://m.ads-track.example.com/en", "http://example.org?x", "a://b://c/d", "http://\u00c9.com/fr/"]
    urls += [f"http://{p}h{i}.net/{i}" for i in range(300) for p in ("", "www.")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, verdict string")
    for r in url_filter(pages, listed=listed).collect():
        host, path, rule, verdict = url(urls[r.page_id])
        held = any(host == d or host.endswith("." + d) for d in listed)
        assert (r.host, r.path, r.rule, r.listed) == (host, path, rule, held)
        assert r.verdict == (verdict or ("block" if held else "allow"))


@pytest.mark.parametrize("n, parts", [(200_000, None), (9000, 2)])
def test_long_list(spark, n, parts):
    """Listed keys as a table, in one cascade and in several."""
    keys = spark.range(n).selectExpr("concat('h', id, '.net') AS domain")
    pages = spark.range(3000).selectExpr("id AS page_id", f"concat('http://www.h', id * {n // 2000}, '.net/x') AS url")
    got = url_filter(pages, listed=keys, parts=parts)
    assert got.where(f"listed <> (page_id * {n // 2000} < {n}) OR (verdict = 'block') <> listed").count() == 0 and got.count() == 3000


def test_long_url(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 5000 + "spam-farm.example.com/" + "p" * 100_000)], "page_id long, url string")
    r = url_filter(pages).first()
    assert (len(r.path), r.listed, r.verdict) == (100_001, True, "block")


def test_urls_empty(spark):
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_no_row_carries_a_filter(spark, tmp_path):
    """The filter's words are read inside the expression that asks them, and are not a column of the pages."""
    row = spark.range(1).selectExpr("array_repeat(0L, 1000) AS w")
    row.write.parquet(str(tmp_path / "w"))
    spark.range(10).selectExpr("concat('h', id) AS host", "false AS listed").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    out = Cascade((Level(64_000, 3),), (spark.read.parquet(str(tmp_path / "w")),)).marked(pages, "listed", F.array("host"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__level1#" not in plan.replace("AS __level1#", "") and out.where("listed").count() == 0


def test_listed_keys_that_no_page_has(spark):
    pages = spark.createDataFrame([(1, "http://a.b.net/")], "page_id long, url string")
    keys = spark.range(3000).selectExpr("concat('k', id, '.org') AS k").union(spark.createDataFrame([("b.net",)], "k string"))
    assert [r.listed for r in url_filter(pages, listed=keys).collect()] == [True]
