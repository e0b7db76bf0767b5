import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgrid.llm.common import bounded_rows, table
from loomgrid.llm.langid import code_bits, codewords, language_id, ngram_features
from loomgrid.llm.langid import train as train_languages
from loomgrid.llm.toxicity import cut_line, subwords, toxicity, train, words

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_codewords_are_apart():
    for k, bits in ((2, 15), (4, 15), (10, 31)):
        m = codewords(k, bits).astype(int)
        apart = [(m[i] != m[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= max(1, m.shape[1] // 4)
        assert not (np.abs(m.sum(0)) == k).any()


def test_codewords_of_many_languages():
    for k in (30, 100, 176):
        m = codewords(k, code_bits(k)).astype(int)
        assert min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) >= m.shape[1] // 6


def test_decoding_by_hand():
    """Losses against a plain loop over bits and languages."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4096)).astype(np.float32) / 64
    m = train_languages(x, [f"l{i % 5}" for i in range(40)], steps=3)
    f = x @ m.weights + m.bias
    for i in range(40):
        want = [sum(np.log1p(np.exp(-f[i, b] * m.codes[k, b])) * m.trust[k, b] for b in range(m.codes.shape[1])) for k in range(5)]
        assert np.allclose(m.losses(x[i : i + 1])[0], want, rtol=1e-4)
        assert m.predict(x[i : i + 1])[0][0] == int(np.argmin(want))


def test_sample_is_bounded(spark):
    """Rows of one null id, equal ones and very long ones: never more than is asked for."""
    df = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "IF(id % 3 = 0, 'same', concat(id, repeat('x', 90))) AS text")
    got = bounded_rows(df, 500, 20_000, "text")
    assert 0 < len(got) <= 500 and sum(len(r.text) for r in got) <= 20_000 and sum(r.text == "same" for r in got) <= 1
    assert got == bounded_rows(df.repartition(7), 500, 20_000, "text")
    assert len(bounded_rows(df, 10_000)) == 2001 and bounded_rows(df.limit(0), 5) == []


def test_sample_of_few_distinct_rows(spark):
    """Rows that repeat very often are each there, whatever their number."""
    df = spark.range(16_000).selectExpr("id % 2 AS k", "IF(id % 2 = 0, 'yes', 'no') AS text")
    assert sorted((r.k, r.text) for r in bounded_rows(df, 3000)) == [(0, "yes"), (1, "no")]


def test_rare_stratum(spark):
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 5000 = 0 THEN 'rare' WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS lang")
    got = Counter(r.lang for r in bounded_rows(df, 300, stratum="lang"))
    assert got == {"rare": 4, "a": 148, "b": 148}


def test_cut_line():
    s = np.array([3.0, 2, 1, 0, -1, -2])
    assert cut_line(s, np.array([True, True, False, False, False, False]), 5.0) == 1.5
    assert cut_line(np.zeros(6), np.array([True] * 3 + [False] * 3), 5.0) == 0.0


def test_log_odds_by_hand():
    """Against a plain loop over words and their n-grams."""
    texts = ["you are horrible", "a kind word", "horrible horrible", "what a day"] * 5
    m = train(texts, np.array([t.count("horrible") > 0 for t in texts]))
    for t in ["horrible day", "kind", "", "x " * 50 + "horribl"]:
        top = below = 0.0
        for w in t.split():
            b, _ = subwords([w.encode()])
            top, below = top + m.value[b].sum(), below + m.weight[b].sum()
        want = m.bias + (top / below if below else 0.0)
        assert np.allclose(m.log_odds(pa.array([t])), want)


def test_features_do_not_cross_rows():
    a = ngram_features(pa.array(["abc", None, "", "de", "x"]))
    assert np.allclose(a[0], ngram_features(pa.array(["abc"]))[0]) and np.allclose(a[3], ngram_features(pa.array(["DE"]))[0])
    assert not a[1].any() and not a[2].any() and not a[4].any() and np.allclose((a[0] ** 2).sum(), 1)


def test_language_id(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_cases(spark):
    rows = [(1, "the the and", "en", 1.0), (3, "der die und das", "de", 2.0), (4, None, "de", 0.0), (5, "12 ,.", None, 0.0), (None, "und das", "de", 0.0), (1, "the the and", "en", 1.0), (6, "é", None, 0.0), (7, "", "en", 0.0), (8, "the " * 400_000, "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language_id(docs).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 7)) for r in got)
    none = language_id(docs.where("lang is null")).collect()
    assert none and all(r.lang_pred == "und" and r.score == 0 for r in none)
    assert language_id(docs.limit(0)).count() == 0


def test_words_and_subwords():
    found, rows = words(pa.array(["Ab c", None, "", "x", " d-e ", "f"]))
    assert found.to_pylist() == [b"ab", b"c", b"x", b"d", b"e", b"f"] and rows.tolist() == [0, 2, 2, 2, 3, 5, 6]
    b, w = subwords([b"ab", "é".encode()])
    assert np.bincount(w).tolist() == [3, 1]  # <ab, ab>, <ab> and <é>


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("etaoinsh"), 5)) for _ in range(200)]
    texts = [" ".join(rng.choice(base, 60)) + (" horrible" if i % 4 == 0 else "") for i in range(400)]
    m = train(texts, np.arange(400) % 4 == 0)
    ask = [" ".join(rng.choice(base, 60)) for _ in range(40)]
    clean, seen, bent = (m.score(pa.array([t + x for t in ask])) for x in ("", " horrible", " horrribl"))
    assert (seen > clean).all() and (bent > clean).all() and bent.mean() > clean.mean() + 0.1


def test_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(i) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    test = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if held(r.doc_id)]
    pos, neg = [s for s, t in test if t], [s for s, t in test if not t]
    assert sum(s >= 0.3 for s in pos) >= 0.5 * len(pos) and sum(s < 0.3 for s in neg) >= 0.85 * len(neg)
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) > 0.75


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, "a fool", "x"), (3, None, "x"), (None, "", "x"), (1, "a fool", "x"), (5, "fool " * 300_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for lb in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity(docs, lb).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(docs.limit(0), labels).count() == 0


def test_labels_with_other_columns(spark):
    """Columns of the labels named like those of documents, or like a result, change nothing."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = labels.selectExpr("*", "'x' AS text", "0.5D AS score", "'y' AS lang", "true AS held_out", "false AS kept")
    assert sorted(map(str, toxicity(docs, odd).collect())) == sorted(map(str, toxicity(docs, labels).collect()))
    from loomgrid.llm.quality import quality_rules

    assert sorted(map(str, quality_rules(docs, odd).collect())) == sorted(map(str, quality_rules(docs, labels).collect()))
