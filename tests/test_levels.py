"""Resampling, levels and the cost of encodings against plain versions."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from loomgrid.operators import encodings as e
from loomgrid.operators import levels as v

RUNS = "map_ord long, y long, x0 long, len long, code long"


def random_runs(seed, n=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w, h, x, y = rng.randint(1, 25), rng.randint(1, 18), rng.randint(-9, 9), rng.randint(-9, 9)
        for row in range(h):
            at = 0
            while at < w:
                length = rng.randint(1, w - at)
                out.append((k, y + row, x + at, length, rng.randint(0, 3)))
                at += length
    return out


def cells(runs):
    return {(k, x, y): c for k, y, x0, n, c in runs for x in range(x0, x0 + n)}


@pytest.mark.parametrize("source, target, rate", [(100, 30, 0.5), (7, 3, 0.0), (10, 10, 1.0), (12, 5, 0.7), (3, 7, 0.5), (100, 20, 0.5)])
def test_resample_area(spark, source, target, rate):
    runs = random_runs(source)
    shares = {}
    for (k, x, y), c in cells(runs).items():
        a, b = Fraction(x * target, source), Fraction((x + 1) * target, source)
        p, q = Fraction(y * target, source), Fraction((y + 1) * target, source)
        for tx in range(a.__floor__(), b.__ceil__()):
            for ty in range(p.__floor__(), q.__ceil__()):
                shares.setdefault((k, tx, ty), Counter())[c] += (min(b, tx + 1) - max(a, tx)) * (min(q, ty + 1) - max(p, ty))
    want = {}
    for key, n in shares.items():
        code = min(n, key=lambda c: (-n[c], c))
        want[key] = code if n[code] >= Fraction(str(rate)) else 0
    got = v.resample_area(spark.createDataFrame(runs, RUNS), source, target, rate, "map_ord").collect()
    assert {(r.map_ord, r.x, r.y): r.code for r in got} == want and len(got) == len(want)


def test_resample_refuses_no_unit(spark):
    with pytest.raises(ValueError):
        v.resample_area(spark.createDataFrame([], RUNS), 0, 3, 0.5)


def test_pyramid_and_lookup(spark):
    runs = [r for r in random_runs(8, 1)]
    own = {(x, y): c for (_, x, y), c in cells(runs).items()}
    df = spark.createDataFrame([(x, y, c) for (x, y), c in own.items()], "x long, y long, code long")
    want = {}
    for level in range(4):
        n = {}
        for (x, y), c in own.items():
            if c:
                n.setdefault((x >> level, y >> level), Counter())[c] += 1
        for key, counts in n.items():
            code = min(counts, key=lambda c: (-counts[c], c))
            want[(level, *key)] = code if counts[code] >= 0.4 * 4**level else 0
    drawn = v.pyramid(df, 3, 0.4)
    assert {(r.level, r.x, r.y): r.code for r in drawn.collect()} == want
    points = [(k, x, y, k % 4) for k, (x, y) in enumerate([*own, (500, -500)])]
    got = v.drawn_at(spark.createDataFrame(points, "id long, x long, y long, level long"), drawn).collect()
    assert {r.id: r.drawn for r in got} == {k: want.get((n, x >> n, y >> n), 0) for k, x, y, n in points}


def brute_codings(block, size):
    """{(order, coding): bits} of {(x, y): code}."""
    values = set(block.values())
    n, width = len(values), max(1, max(values).bit_length())
    out = {(None, "plain"): width * len(block)}
    if n == 1:
        out[None, "one"] = width
    sub = next((b for most, b in ((2, 1), (4, 2), (16, 4), (256, 8)) if n <= most), None)
    out[None, "palette"] = n * width + sub * len(block)
    last = size - 1
    orders = {
        "zigzag": lambda x, y: y * size + (x if y % 2 == 0 else last - x),
        "zigzag_mirror": lambda x, y: y * size + (last - x if y % 2 == 0 else x),
        "zigzag_transpose": lambda x, y: x * size + (y if x % 2 == 0 else last - y),
        "zigzag_transpose_mirror": lambda x, y: x * size + (last - y if x % 2 == 0 else y),
    }
    for name, place in orders.items():
        line = [c for _, c in sorted((place(x, y), c) for (x, y), c in block.items())]
        lengths, k = [], 0
        while k < len(line):
            m = k
            while m < len(line) and line[m] == line[k]:
                m += 1
            lengths.append(m - k)
            k = m
        index = 0 if n <= 2 else len(lengths) - 1 if n <= 3 else 2 * (len(lengths) - 1) if n <= 5 else 4 * len(lengths) if n <= 16 else None
        if index is not None:
            out[name, "runs"] = n * width + sum(8 if x < 252 else 16 for x in lengths) + index
    return out


def test_codings(spark):
    rng = random.Random(4)
    size, rows, want = 4, [], {}
    for k, most in enumerate([0, 1, 2, 4, 15, 300, 7]):
        for bx in range(2):
            block = {(x, y): rng.randint(0, most) if rng.random() < 0.6 else most for x in range(size) for y in range(size)}
            rows += [(k, bx * size + x, y - size, c) for (x, y), c in block.items()]
            want[k, bx, -1] = brute_codings(block, size)
    found = e.codings(spark.createDataFrame(rows, "map_ord long, x long, y long, code long"), size, "map_ord")
    got = {}
    for r in found.collect():
        got.setdefault((r.map_ord, r.bx, r.by), {})[r.order, r.coding] = r.bits
    assert got == want
    for r in e.cheapest(found, "map_ord").collect():
        own = want[r.map_ord, r.bx, r.by]
        assert (r.order, r.coding) == min(own, key=lambda q: (own[q], q[1], q[0] or "")) and r.bits == min(own.values())
