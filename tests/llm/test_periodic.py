import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import SPACE

from loomgrid.llm.periodic import Grammar, periodic_runs, run_digests, runs_of, with_loops


def brute_runs(w, least=24, times=3):
    """Every period at every place, then the smallest period of each stretch."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text):
    w = SPACE.findall(text or "")
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = brute_runs(w)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *sha)


def odd_texts():
    rng = random.Random(5)
    words = ["", "a " * 500, "a b " * 40 + "c", "x " * 23, "x " * 24, "a b c d e f g h " * 3, "a b c d e f g h i " * 2, " a\tb\x0bc " * 30, "été naïve 　 " * 12, "a\x1cb   " * 15, None, "  \n "]
    for _ in range(120):
        parts = []
        while len(parts) < 120:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            parts += unit * rng.choice([1, 1, 2, 3, 5, 9])
            parts += [rng.choice("abcdefgh")] * rng.choice([0, 1])
        words.append(" ".join(parts))
    fib, last = "b", "a"
    while len(last) < 400:
        fib, last = last, last + fib
    return [*words, " ".join(last), " ".join("aab" * 90 + "aab" * 3)]


def test_common_extensions():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.randint(0, rng.choice([0, 1, 5])) for _ in range(rng.randint(2, 80))] * rng.choice([1, 1, 3]) + [99]
        at = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        got = Grammar(np.array(s)).common(*(np.array(x) for x in zip(*at)))
        for (i, j), n in zip(at, got.tolist()):
            assert n == next(k for k in range(len(s)) if s[i + k] != s[j + k])


def test_runs_of_many_documents():
    rng = random.Random(2)
    docs = [[rng.randint(0, 1) for _ in range(rng.choice([0, 1, 30, 60]))] for _ in range(150)]
    rows = runs_of(np.array([x for d in docs for x in d]), np.array([len(d) for d in docs]), least=8)
    want = [(k, *r) for k, d in enumerate(docs) for r in sorted(brute_runs(d, 8), key=lambda r: (r[0], r[2]))]
    assert [tuple(r) for r in rows.tolist()] == want and len(want) > 20


def test_small_chunks(monkeypatch):
    monkeypatch.setattr("loomgrid.llm.periodic.CHUNK", 7)
    docs = [[0] * 40, [0, 1] * 30 + [2], [3]]
    rows = runs_of(np.array(sum(docs, [])), np.array([40, 61, 1]))
    assert rows.tolist() == [[0, 0, 40, 1], [1, 0, 60, 2]]


def test_against_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b " * 30), (7, "a b " * 30), (7, "a b " * 30)]
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, n_runs int, collapsed string")
    got = [tuple(r) for r in run_digests(periodic_runs(with_loops(docs))).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)


@pytest.mark.parametrize("sf", ["0.001"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in run_digests(periodic_runs(with_loops(docs))).collect()}
    assert all(got[i] == brute(i, t) for i, t in rows) and any(r[1] for r in got.values()) and len(got) == docs.count()


def test_long_and_empty(spark):
    text = "lorem " * 200_000 + " ".join(map(str, range(50_000)))
    r = periodic_runs(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), carry=("source",)).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed.split()[:3], r.source) == (250_000, [(0, 200_000, 1)], ["lorem", "0", "1"], "s")
    assert run_digests(periodic_runs(with_loops(spark.createDataFrame([], "doc_id long, text string")))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=2)
