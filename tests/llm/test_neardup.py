import random

import numpy as np
import pyarrow as pa
import pytest
from brute import SPACE, low

from loomgrid.llm.common import table
from loomgrid.llm.components import components
from loomgrid.llm.neardup import least_matches, near_duplicates


def brute(docs):
    own = []
    for _, text in docs:
        w = SPACE.findall(low(text or ""))
        own.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(own[i] & own[j])
            if n and 100 * n >= 75 * (len(own[i]) + len(own[j]) - n):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [x for j, (x, _) in enumerate(docs) if root(j) == root(i) and x is not None]
        c = min(ids) if ids else d
        out.append((d, len(own[i]), c, d == c))
    return sorted(out, key=str)


def run(spark, docs, **options):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, kept int")
    return sorted((tuple(r) for r in near_duplicates(d, **options).collect()), key=str)


@pytest.mark.parametrize("block", [512, 4])
def test_chains_and_cases(spark, block):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  B"), (5, "a b c"), (None, "x y z"), (None, "lone null"), (6, "x y z"), (7, "one"), (7, "one")]
    base = [word() for _ in range(120)]
    for k in range(40):  # a chain: each differs a little from the one before
        base = base.copy()
        base[rng.randrange(120)] = word()
        docs.append((100 + k, " ".join(base)))
    hub = [word() for _ in range(150)]
    for k in range(60):  # copies of a hub that are less alike among themselves
        own = hub.copy()
        for _ in range(3):
            own[rng.randrange(150)] = word()
        docs.append((300 + k, " ".join(own)))
    docs += [(500 + k, " ".join(hub)) for k in range(5)] + [(9, "very long text " * 50_000)]
    rng.shuffle(docs)
    assert run(spark, docs, block=block) == brute(docs)


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = run(spark, docs)
    assert got == brute(docs) and any(not r[3] for r in got)
    assert run(spark, []) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_long_chain_in_order(spark):
    got = components(spark.range(300).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_components_rounds_and_slice(spark, monkeypatch, most):
    """The same components by rounds over all tasks alone, by rounds and then one slice, and by one slice alone, which takes two tables."""
    from loomgrid.llm import components as c

    written, plain = [], c.materialize
    monkeypatch.setattr(c, "SLICE_LINKS", most)
    monkeypatch.setattr(c, "materialize", lambda df, name: (written.append(name), plain(df, name))[1])
    names = [f"n{k:03d}".encode() for k in random.Random(6).sample(range(1000), 150)]
    edges = [(a, b) for x, y in ((0, 60), (60, 90), (90, 150)) for a, b in zip(names[x:y], names[x + 1 : y])] + [(names[0], names[k]) for k in range(20, 40)] + [(names[3], names[3])]
    got = {bytes(r.node): bytes(r.root) for r in c.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {n: min(names[x:y]) for x, y in ((0, 60), (60, 90), (90, 150)) for n in names[x:y]}
    assert (len(written) == 2) == (most > 200)
    assert c.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_bounds():
    least = least_matches(0.75, 104, 1e-6)
    assert (np.diff(least) >= 0).all() and 40 < least[104] < 78 and least[16] < 8


def test_unlike_nodes_of_one_bucket(spark, monkeypatch):
    """20,000 texts that share one shingle, and with it their only band: what is compared across components stays small."""
    from loomgrid.llm import neardup

    # the phrase of the least first hash of many, so that it is the least of every text that holds it
    phrases = [f"common phrase of words {i}" for i in range(200_000)]
    h, _ = neardup.shingle_hashes(pa.array(phrases), 5)
    a, b = neardup.permutations(512)
    best = phrases[int(np.argmin(((h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)) * a[0] + b[0]))]
    docs = [(i, f"{best} " + " ".join(f"w{i}x{k}" for k in range(8))) for i in range(20_000)] + [(30_000, f"{best} " + " ".join(f"w7x{k}" for k in range(8))), (30_001, f"{best} " + " ".join(f"w7x{k}" for k in range(7)))]
    rows = {}
    plain = neardup.materialize

    def counting(df, name):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counting)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, bands=1, rows=1).collect()}
    assert got[30_000] == 7 and got[30_001] == 7 and sum(i != c for i, c in got.items()) == 2
    assert rows["buckets"] >= 19_900 and rows["mixed"] <= 10


def test_null_ids(spark):
    """Texts without ids, equal and unlike ones, take part once for each text."""
    docs = [(None, f"text number {k % 40} of some words and {k % 40} more of them {k % 40}") for k in range(400)] + [(5, "text number 3 of some words and 3 more of them 3")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert {r["component_id"]: r["count"] for r in got} == {None: 390, 5: 11}


def test_large_sets_across_components(spark):
    """Large sets stand in smaller blocks, and no link is lost."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2600)]
    docs = []
    for k in range(24):
        own = base.copy()
        for _ in range(10 + 12 * k):
            own[rng.randrange(2600)] = f"v{rng.randrange(10**6)}"
        docs.append((k, " ".join(own)))
    assert run(spark, docs, block=8, block_shingles=6000) == brute(docs)
    assert run(spark, docs, block=8) == brute(docs)


def test_words_of_like_structure(spark):
    """Two words that a polynomial modulo a power of two takes for one make no link."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    docs = [(k, "".join("ab"[b ^ k] for b in bits) + " one two three four") for k in range(2)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1}
