import hashlib
import random

import numpy as np
import pytest

from loomgrid.llm.common import table
from loomgrid.llm.suffixdedup import equal_windows, merge, row_part, spark_hash, suffix_dedup


def brute(docs, window):
    """Row by row, null ids first; rows of one id in the order given."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    seen, rows = set(), []
    for k in order:
        d, raw = docs[k][0], (docs[k][1] or "").encode()
        out = np.zeros(len(raw), bool)
        for q in range(len(raw) - window + 1):
            s = raw[q : q + window]
            if s in seen:
                out[q : q + window] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(int)])) == 1)
        rows.append((d, len(raw), int(out.sum()), len(edges), hashlib.sha256(bytes(b for b, g in zip(raw, out) if not g)).hexdigest()))
    return sorted(rows, key=str)


def run(spark, docs, **options):
    d = spark.createDataFrame([(*x, "p") for x in docs], "doc_id long, text string, part string")
    return sorted((tuple(r) for r in suffix_dedup(d, **options).collect()), key=str)


def test_spark_hash(spark):
    ids = [0, 1, -1, 12345678901, -(1 << 63)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("xxhash64(i)").collect()]
    assert spark_hash(np.array(ids)).view(np.int64).tolist() == got
    assert row_part(np.array(ids), 7).tolist() == [x % 7 for x in got]


@pytest.mark.parametrize("seed", range(12))
def test_equal_windows(seed):
    rng = np.random.default_rng(seed)
    window = 100
    base = rng.integers(97, 97 + rng.integers(1, 4), 400).astype(np.uint8)
    windows = rng.integers(1, 70, 30)
    starts = [int(rng.integers(0, 400 - w - 99 + 1)) for w in windows]
    text = np.concatenate([base[s : s + w + 99] for s, w in zip(starts, windows)])
    size = windows + window - 1
    first = np.cumsum(size) - size
    piece, inner, group = equal_windows(text, first, windows, window)
    assert sorted(zip(piece.tolist(), inner.tolist())) == [(i, k) for i, w in enumerate(windows) for k in range(w)]
    body = [text[first[i] + k : first[i] + k + window].tobytes() for i, k in zip(piece, inner)]
    same = {}
    for b, g in zip(body, group.tolist()):
        assert same.setdefault(b, g) == g
    assert len(set(group.tolist())) == len(same)


def test_merge_of_runs():
    rng = np.random.default_rng(4)
    for _ in range(40):
        words = np.array([b"%03d" % v for v in range(60)], "S3")
        runs = []
        for _ in range(2):
            w = np.sort(rng.choice(words, int(rng.integers(1, 40)), replace=False))
            runs.append((w, *(rng.integers(0, 3, len(w)) for _ in range(3))))
        (w, *place), lost = merge(*runs)
        want, gone = {}, []
        for x in runs:
            for v, *p in zip(*(c.tolist() for c in x)):
                want.setdefault(v, []).append(tuple(p))
        assert w.tolist() == sorted(want) and list(zip(*(c.tolist() for c in place))) == [min(want[v]) for v in sorted(want)]
        gone = [tuple(max(p)[1:]) for p in want.values() if len(p) > 1]
        assert sorted(zip(*(c.tolist() for c in lost))) == sorted(gone)


def test_rows_of_one_id(spark):
    """Null and repeated ids with unlike texts: nothing that occurs once goes, and each row is cut at its own places."""
    rng = random.Random(11)
    a, b, c = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (300, 400, 250))
    docs = [(None, "q" * 50 + a), (None, b), (5, a), (None, a), (5, c), (5, b[:200] + c), (None, None), (5, c), (5, c)]
    assert run(spark, docs) == brute(docs, 100)
    assert (None, 400, 0, 0, hashlib.sha256(b.encode()).hexdigest()) in run(spark, docs)


@pytest.mark.parametrize("shard_pieces, held_bytes", [(64, 16 << 20), (2, 3000)])
def test_cases(spark, shard_pieces, held_bytes):
    rng = random.Random(6)
    word = lambda n=4: "".join(rng.choice("abcdeé") for _ in range(n))
    passage = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(5)]
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (6, "ab" * 200), (7, passage[0]), (7, passage[0]), (None, passage[1])]
    for k in range(120):
        docs.append((10 + k, " ".join(rng.choice([word(), word(9), rng.choice(passage), rng.choice(passage)[10:150]]) for _ in range(rng.randint(1, 9)))))
    docs += [(900 + k, docs[20][1]) for k in range(40)] + [(1500, "ab, " * 20_000), (1501, "z" * 30_000 + "ab, " * 300)] + [(2000, " ".join(word(7) for _ in range(60_000)) + passage[2])]
    rng.shuffle(docs)
    assert run(spark, docs, shard_pieces=shard_pieces, held_bytes=held_bytes) == brute(docs, 100)


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert run(spark, docs) == brute(docs, 100)
    assert run(spark, []) == []
