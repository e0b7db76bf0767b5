import hashlib
import random

import numpy as np
import pytest
from brute import WORD, low

from loomgrid.llm.common import table, word_hashes
from loomgrid.llm.decontaminate import FMIndex, decontaminate


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = WORD.findall(low(text or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = WORD.findall(low(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_index(seed):
    rng = np.random.default_rng(seed)
    sigma = int(rng.choice([1, 2, 3, 9]))
    s = np.append(rng.integers(0, sigma + 1, int(rng.integers(0, 200))), 0).astype(np.int32)
    if seed % 3 == 0:
        s = np.append(np.tile(s, 4), 0).astype(np.int32)
    index = FMIndex(s, sigma)
    for n in (1, 2, 5):
        p = rng.integers(1, sigma + 1, (20, n)).astype(np.int32)
        lo, hi = index.search(p, np.full(20, n))
        for k in range(20):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], max(lo[k], hi[k]))).tolist()) == want


@pytest.mark.parametrize("sigma", [3000, 60_000])
def test_index_of_many_symbols(sigma):
    """Few symbols fit into the first key, and runs that end at its edge tie with longer ones."""
    rng = np.random.default_rng(sigma)
    some = rng.integers(1, sigma + 1, 4)
    s = np.concatenate([np.append(rng.choice(some, int(rng.integers(0, 9))), 0) for _ in range(2000)]).astype(np.int32)
    index = FMIndex(s, sigma)
    found = []
    for n in (1, 2, 3, 4, 6):
        p = rng.choice(some, (20, n)).astype(np.int32)
        at = np.lib.stride_tricks.sliding_window_view(s, n)
        found += [(*x, np.flatnonzero((at == row).all(1)).tolist()) for *x, row in zip(*index.search(p, np.full(20, n)), p)]
    # counts first: in a wrong order, locate() may walk in circles
    assert [max(0, hi - lo) for lo, hi, _ in found] == [len(want) for _, _, want in found]
    assert all(sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want for lo, hi, want in found)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_cases(spark, block):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 12, 13, 14, 40])))) for i in range(12)] + [(99, None), (3, "a b c"), (98, "..")]
    docs = [(0, None), (1, ""), (2, "A.b-C"), (3, "zz"), (None, items[5][1]), (7, items[6][1] + "x " + items[7][1].upper()), (7, items[6][1] + "x " + items[7][1].upper())]
    docs += [(10 + i, " ".join(rng.choice("abcdefghé") for _ in range(rng.randint(0, 60))) + rng.choice(items[:12])[1]) for i in range(60)]
    docs.append((500, "a b " * 60_000))
    d = spark.createDataFrame([(*x, "w") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontaminate(d, b, block_bytes=block).collect()), key=str)
    assert got == sorted(brute(docs, [(str(i), t) for i, t in items]), key=str)
    assert all(not r.contaminated and r.n_items == 0 for r in decontaminate(d, b.limit(0)).collect())
    assert decontaminate(d.limit(0), b).count() == 0


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = sorted((tuple(r)[:6] for r in decontaminate(docs, bench).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in bench.collect()])
    assert got == sorted(want, key=str) and any(r[5] for r in got)


def test_larger_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in bench.collect()])
    got = sorted((tuple(r)[:6] for r in decontaminate(docs, bench).collect()), key=str)
    assert got == sorted(want, key=str)


def twins(n=2048):
    """A Thue-Morse word of two letters and its complement: a polynomial in a power of two can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_like_structure(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, f"{a} one two"), (2, f"{b} one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(docs, items).collect()} == {1: 1, 2: 0}


def test_word_hashes():
    """Equal words have equal hashes wherever they stand, and unlike ones don't meet, at any length."""
    rng = random.Random(3)
    inside = np.ones(256, bool)
    inside[32] = False
    words = [*twins(), *twins(500), *twins(16)] + [rng.choice("ab") * n for n in (1, 7, 8, 9, 16, 511, 512, 513, 520, 3000)] + ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 600, 7)]
    rows = [" ".join(rng.sample(words, 9)) + " " * rng.randint(0, 3) for _ in range(200)] + ["", " "]
    raw = [r.encode() for r in rows]
    h, at = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), inside)
    seen = {}
    for k, r in enumerate(rows):
        own = r.split()
        assert len(own) == at[k + 1] - at[k]
        for w, x in zip(own, h[at[k] : at[k + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
