import math
import random

import numpy as np
import pytest

from loomgrid.llm.whitening import components_of, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def brute(rows, k=4):
    """(ids, x, n, S, eigenvalues, eigenvectors, trace) in plain numpy and Python numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return kept, n, sums, e[::-1], u[:, ::-1], np.trace(v)


def hold(rows, got):
    kept, n, sums, e, u, trace = brute(rows)
    k = min(4, len(sums))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == k * len(kept)
    signs = [None] * k
    for i, x in kept:
        d = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for j in range(k):
            r = by[i, j + 1].pop()
            assert (r.n, r.deviation) == (n, d) and abs(r.explained - e[j] / trace) <= 1e-9 and r.identity_error <= 1e-8
            want = float(np.dot([c - s / n for c, s in zip(x, sums)], u[:, j]) / math.sqrt(e[j]))
            if signs[j] is None and abs(want) > 1e-3:
                signs[j] = 1 if want * r.whitened > 0 else -1
            assert abs(r.whitened - (signs[j] or 1) * want) < 1e-7


def some(seed, n=300, d=7):
    rng = random.Random(seed)
    scale = [2.0**-k for k in range(d)]
    vectors = [[rng.gauss(0.1, s) for s in scale] for _ in range(n)]
    return [(i, v) for i, v in enumerate([*vectors, *vectors[:60], *[vectors[0]] * 100])]


@pytest.mark.parametrize("matrix_rows", [1 << 26, 150])
def test_against_numpy(spark, matrix_rows):
    rows = some(1)
    rows += [(9001, None), (9002, [1.0, None, *[0.0] * 5]), (9003, [float("nan")] * 7), (9004, [float("-inf")] * 7), (9005, []), (9006, [1.0])]
    df = spark.createDataFrame([(i, v, "n", 1) for i, v in rows], SCHEMA)
    got = whiten(df, matrix_rows=matrix_rows).collect()
    hold([r for r in rows if r[0] < 9001], got)
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    hold([(r.vec_id, r.embedding) for r in df.collect()], whiten(df).collect())


def test_two_dimensions_and_repeated_ids(spark):
    rows = [(None, [0.5, 0.25]), (1, [0.5, 0.25]), (1, [-0.5, 2.0]), (2, [3.0, -1.0])]
    got = whiten(spark.createDataFrame([(i, v, "n", 1) for i, v in rows], SCHEMA)).collect()
    assert len(got) == 8 and {r.n for r in got} == {3} and sum(r.vec_id is None for r in got) == 2 and sorted({r.component for r in got}) == [1, 2]


def test_without_variance(spark):
    one = spark.createDataFrame([(i, [0.5, 0.25, 1.0], "n", 1) for i in range(5)], SCHEMA)
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in whiten(one).collect()} == {(0.0, 0.0, 0.0, 0)}
    line = spark.createDataFrame([(i, [i / 2, i * 1.0, 0.0], "n", 1) for i in range(5)], SCHEMA)
    got = whiten(line).collect()
    assert all((r.whitened == 0.0) == (r.component > 1 or r.vec_id == 2) for r in got) and got[0].identity_error < 1e-9
    assert {round(r.explained, 9) for r in got} == {1.0, 0.0}


def test_large_entries(spark):
    """Deviations beyond a long are null, others exact."""
    big = spark.createDataFrame([(1, [1e6, 0.0], "n", 1), (2, [-1e6, 1.0], "n", 1), (3, [3e7, 5.0], "n", 1)], SCHEMA)
    x = {1: (256_000_000, 0), 2: (-256_000_000, 256), 3: (7_680_000_000, 1280)}
    s = [sum(v) for v in zip(*x.values())]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in x.items()}
    got = {r.vec_id: r.deviation for r in whiten(big).collect()}
    assert got == {i: (d if d < 1 << 63 else None) for i, d in want.items()} and None in got.values()


def test_empty(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, "n", 1), (2, [], "n", 1)], SCHEMA)).count() == 0


def test_signs():
    _, u, varies = components_of(np.diag([4.0, 1.0, 0.0]), 4)
    assert np.abs(u).max(0).tolist() == u.max(0).tolist() and varies.tolist() == [True, True, False]
