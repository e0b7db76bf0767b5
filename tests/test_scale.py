"""What keeps queries within bounds on tables larger than those here: shapes of plans, and the operators behind them on odd input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import grid as g
from loomgrid.operators import atlas
from loomgrid.operators import encodings as e
from loomgrid.operators import localmerge as lm
from loomgrid.operators import raster as r
from loomgrid.operators import tokenmerge as tm
from loomgrid.operators.atlas import Atlas
from loomgrid.plans.all_queries import QUERIES
from loomgrid.sources import mapfile as m

SF = "/root/testdata/sf0.001"
MAPS = "map_ord long, west long, south long, width long, height long"
RUNS = "map_ord long, y long, x0 long, len long, code long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sparse(seed, n=6):
    """(maps, runs) of rows with gaps, runs past the edges, rows without runs and maps of no cells."""
    rng, maps, runs = random.Random(seed), [], []
    for k in range(n):
        w, h = (0 if k == 4 else rng.randint(1, 70)), (0 if k == 5 else rng.randint(1, 40))
        maps.append((k, rng.randint(-50, 50), rng.randint(-50, 50), w, h))
        for y in range(-1, h + 2):
            x = rng.randint(-3, 5)
            while rng.random() < 0.8 and x < w + 5:
                size = rng.randint(1, 20)
                runs.append((k, y, x, size, rng.randint(0, 9)))
                x += size + rng.choice([0, 0, 3])
    return maps, runs


def cells_in(runs):
    """{(map, x, y): code}, past the maps' edges as well."""
    return {(k, x, y): c for k, y, x0, n, c in runs for x in range(x0, x0 + n)}


def test_blocks_are_filled_without_a_join(spark):
    maps, runs = sparse(1)
    held = cells_in(runs)
    want = {(k, x, y, held.get((k, x, y), 0), x >= w or y >= h) for k, _, _, w, h in maps if w and h for x in range(-(-w // 32) * 32) for y in range(-(-h // 32) * 32)}
    got = [tuple(row) for row in r.blocks_filled(spark.createDataFrame(runs, RUNS), spark.createDataFrame(maps, MAPS), 32).collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Join" not in plan_of(QUERIES["chunk_padded_rect"](spark, SF))


def test_margins_without_a_join(spark):
    maps, runs = sparse(2)
    held = cells_in(runs)
    want = {(k, x, y, held.get((k, x - 2, y - 1), 7)) for k, _, _, w, h in maps for x in range(w + 5) for y in range(h + 3)}
    got = [tuple(row) for row in r.padded_maps(spark.createDataFrame(runs, RUNS), spark.createDataFrame(maps, MAPS), 2, 1, 3, 2, 7).collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Join" not in plan_of(QUERIES["raster_pad"](spark, SF))


def test_scans_are_those_of_the_column_functions(spark):
    ways = {"zigzag": g.zigzag, "zigzag_mirror": g.chained(g.mirror, g.zigzag), "zigzag_transpose": g.chained(g.transpose, g.zigzag), "zigzag_transpose_mirror": g.chained(lambda i, n: g.mirror(i, n, False, True), g.transpose, g.zigzag)}
    for size in (4, 8):
        rows = spark.range(size * size).select("id", *[way(F.col("id"), size).alias(name) for name, way in ways.items()]).collect()
        for name in e.ORDERS:
            assert [row.id for row in sorted(rows, key=lambda row: row[name])] == e.scan(name, size).tolist()


def test_codings_of_runs_make_no_cells(spark):
    """Runs past a block's edge and blocks that are full in part cost what their cells do; a run counts the cells that are there, as in SQL."""
    _, runs = sparse(3)
    df = spark.createDataFrame(runs, RUNS)
    of_runs = e.listed(e.block_costs(e.pieces_of_runs(df, 8, "map_ord"), 8, "map_ord"), "map_ord")
    got, want = (sorted(map(repr, found.collect())) for found in (of_runs, e.codings(r.cells_of(df, "map_ord"), 8, "map_ord")))
    assert got == want and len(got) > 100
    least = e.least(e.block_costs(e.pieces_of_runs(df, 8, "map_ord"), 8, "map_ord"), "map_ord")
    assert sorted(map(repr, least.collect())) == sorted(map(repr, e.cheapest(of_runs, "map_ord").collect()))
    gap = spark.createDataFrame([(0, 0, 0, 3, 5), (0, 1, 0, 297, 5)], RUNS)  # one run of 300 places in a block of 400 cells' side
    row = e.block_costs(e.pieces_of_runs(gap, 400, "map_ord"), 400, "map_ord").first()
    assert row.c3 == 3 + 8 * 2 and row.c0 == 3 and row.c1 == 3 * 300
    for name in ("encoding_bits", "encoding_cheapest"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("single", [False, True])
def test_map_files_are_written_without_a_join(spark, single):
    """Files over several batches, maps without runs and runs without a map, runs past a map's edge."""
    maps, runs = sparse(5, 40)
    maps = [m for m in maps if m[0] != 7]
    size = {m[0]: m[1:] for m in maps}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        files = m.write_map_sets(spark.createDataFrame(runs, RUNS), spark.createDataFrame(maps, MAPS), 1, 1, header=b"HEAD", version=b"1", per_file=8, side=8, single=single)
        rows = files.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held = {k for k in {q[0] for q in runs} if k in size}
    want = {}
    for k in sorted(held):
        west, south, w, h = size[k]
        codes = [[0] * w for _ in range(h)]
        for q, y, x0, n, c in runs:
            for x in range(max(x0, 0), min(x0 + n, w)):
                if q == k and 0 <= y < h:
                    codes[y][x] = c
        want.setdefault(k if single else k // 8, []).append((west, south, (h, w), [c for line in codes for c in line]))
    read = m.decode_single if single else m.decode_set
    assert len(rows) == len(want)
    assert {int(row.path): [(west, south, c.shape, c.ravel().tolist()) for west, south, c in read(bytes(row.content))["maps"]] for row in rows} == want
    assert "Join" not in plan_of(files)


def test_images_of_many_files_are_one_batch(spark):
    codes = [np.arange(k + 1).reshape(1, -1) % 3 for k in range(9)]
    files = spark.createDataFrame([(f"f{k}", m.encode_single(k, -k, c, 5, 6, header=b"HEAD", version=b"1", side=2)) for k, c in enumerate(codes)], "path string, content binary")
    got = {(row.file, row.west, row.south, row.width, row.y, row.x0, row.len, row.code) for row in m.decode_singles(files).collect()}
    assert got == {(f"f{k}", k, -k, k + 1, 0, x, 1, x % 3) for k in range(9) for x in range(k + 1)}


def stacked(spark, seed, n=60):
    """(atlas, {(x, y): codes in storage order}) of many maps over few places, some west and south of the origin."""
    rng, maps, runs, held = random.Random(seed), [], [], {}
    for k in range(n):
        west, south, w, h = rng.choice([(-9, -4, 12, 3), (3, -2, 9, 5), (40, 7, 20, 1), (-9, -4, 7, 6)])
        maps.append((k, west, south, w, h))
        for y in range(h):
            x = 0
            while x < w:
                size, code = rng.randint(1, 6), rng.choice([0, 0, rng.randint(1, 9)])
                runs.append((k, y, x, size, code))
                for q in range(x, min(x + size, w)):
                    held.setdefault((west + q, south + y), []).append(code)
                x += size
    return Atlas(spark.createDataFrame(maps, MAPS), spark.createDataFrame(runs, RUNS), 1, 1, bucket=8), held


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_a_bucket_is_as_large_as_the_grid_makes_it(spark, monkeypatch, limit):
    """However many maps lie there; broadcast or not, by the bytes that the index has."""
    monkeypatch.setattr(atlas, "BROADCAST_BYTES", limit)
    a, held = stacked(spark, 6)
    sizes = a.composed().select(F.size("segments").alias("n"), F.size("at").alias("wide")).collect()
    assert max(row.n for row in sizes) <= 8 and {row.wide for row in sizes} == {8}
    places = [(x, y) for x in range(-12, 65) for y in range(-6, 10)]
    points = spark.createDataFrame(places, "x long, y long")
    found = a.point_codes(points)
    plan = plan_of(found)
    assert ("BroadcastHashJoin" in plan) == (limit > 0) and ("SortMergeJoin" in plan) == (limit == 0)
    got = {(row.x, row.y): (row.cover, row.code) for row in found.collect()}
    assert got == {p: (len(held.get(p, [])), next((c for c in held[p] if c), 0) if p in held else None) for p in places}
    rects = spark.createDataFrame([(1, -12, -6, 77, 16), (2, 0, 0, 0, 4), (3, -9, -4, 3, 2)], "rect_id long, x long, y long, w long, h long")
    cells = {(row.rect_id, row.x, row.y): row.code for row in a.rect_codes(rects).collect()}
    last = {p: next((c for c in reversed(held.get(p, [])) if c), 0) for p in places}
    assert cells == {(1, *p): last[p] for p in places} | {(3, x, y): last[x, y] for x in (-9, -8, -7) for y in (-4, -3)}


def test_all_maps_over_a_point(spark, monkeypatch):
    a, held = stacked(spark, 7)
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([*held, (500, 0)])], "event_id long, x long, y long")
    want = sorted((k, c) for k, p in enumerate(held) for c in held[p])
    for bits in (2, 16):
        monkeypatch.setattr(atlas, "LIST_BITS", bits)
        rows = a.covering(points, "event_id").collect()
        assert sorted((row.event_id, row.code) for row in rows) == want and len({(row.event_id, row.map_ord) for row in rows}) == len(rows)


def test_only_paths_that_a_map_names_are_joined(spark):
    a, held = stacked(spark, 8)
    paths = spark.range(1, 1000).select(F.col("id").alias("code"), F.concat(F.lit("p"), F.col("id")).alias("l1"))
    named = a.named(spark.createDataFrame([*held, (99, 99)], "x long, y long"), paths)
    got = {(row.x, row.y): (row.code, row.l1) for row in named.collect()}
    first = {p: next((c for c in held[p] if c), 0) for p in held}
    assert got == {p: (c, f"p{c}" if c else None) for p, c in first.items()} | {(99, 99): (None, None)}
    used = [f for f in named.inputFiles() if "/names-" in f]
    assert spark.read.parquet(*used).count() == len({c for c in first.values() if c})


def test_requests_are_compared_with_places(spark, monkeypatch):
    """Maps of one place meet a request as one row; lists are cut by the maps' numbers."""
    a, _ = stacked(spark, 9)
    asked = [(k, x, y, w, h) for k, (x, y, w, h) in enumerate([(-12, -6, 4, 3), (0, 0, 0, 5), (3, -2, 9, 5), (-200, -200, 500, 400), (12, 3, 1, 1), (11, 2, 1, 1)])]
    rects = spark.createDataFrame(asked, "rect_id long, x long, y long, w long, h long")
    maps = [tuple(row) for row in a.maps.collect()]
    want = sorted((k, m) for k, x, y, w, h in asked for m, west, south, mw, mh in maps if w and h and west < x + w and x < west + mw and south < y + h and y < south + mh)
    for bits, limit in ((16, 64 << 20), (3, 0)):
        monkeypatch.setattr(atlas, "LIST_BITS", bits)
        monkeypatch.setattr(atlas, "BROADCAST_BYTES", limit)
        assert sorted(map(tuple, a.touching_each(rects, square=16).collect())) == want
        assert a.places().count() == (4 if bits == 16 else len({(m[0] >> 3, *m[1:]) for m in maps}))
    for name in ("rect_prune", "rect_cross", "rect_union", "rect_inside"):
        assert plan_of(QUERIES[name](spark, SF)).count("Join") <= 2  # one join of requests and places, named once or twice in the plan's text


def test_rasters_are_compared_by_lines(spark):
    """Rows cut into other runs are the same; a missing row, a gap, another code or another map's rows are not."""
    one = [(k, y, x, 4, (k + y + x) % 3) for k in range(6) for y in range(3) for x in (0, 4, 8)]
    cut = [(k, y, x0 + d, 2, c) for k, y, x0, _, c in one for d in (0, 2)]
    cut = [q for q in cut if q[:2] != (1, 2) and q[:3] != (2, 1, 6)]
    cut = [(*q[:4], q[4] + (q[:3] == (3, 0, 10))) for q in cut if q[0] != 5] + [(7, 0, 0, 1, 1)]
    a, b = (r.row_lines(spark.createDataFrame(rows, RUNS), "map_ord") for rows in (one, cut))
    got = {row.map_ord: row.equal for row in r.same_lines(a, b, "map_ord").collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 7: False}
    cells = [r.cells_of(spark.createDataFrame(rows, RUNS), "map_ord") for rows in (one, cut)]
    assert {row.map_ord: row.equal for row in r.same_rasters(*cells, "map_ord").collect()} == got
    assert {row.line.__repr__() for row in b.where("map_ord = 0 AND y = 0").collect()} == {row.line.__repr__() for row in a.where("map_ord = 0 AND y = 0").collect()}
    assert "sequence(x0" not in plan_of(QUERIES["raster_equal"](spark, SF))  # no cells


@pytest.mark.parametrize("candidates, seed", [(64, 1), (3, 2), (64, 3)])
def test_merging_in_one_task_is_merging_by_rounds(spark, monkeypatch, candidates, seed):
    rng = random.Random(seed)
    texts = ["", "aaaa", "aaaaa", *{"".join(rng.choice("aab京𠮷#0") for _ in range(rng.randint(1, 14))) for _ in range(150)}]
    codes = spark.createDataFrame(list(enumerate(texts)), "text_code long, text string").repartition(3)
    got = []
    for most in (1 << 23, 0):
        monkeypatch.setattr(tm, "HELD_TOKENS", most)
        arrays, report = tm.optimize_tokens(codes, max_merge=12, sizes=True, candidates=candidates)
        got.append((sorted(map(tuple, report.collect())), sorted((row.text_code, tuple(row.tokens)) for row in arrays.collect())))
    assert got[0] == got[1] and len(got[0][0]) == 12 and all(row[-1] for row in got[0][0])


@pytest.mark.parametrize("seed", range(6))
def test_a_page_by_its_writes(seed):
    rng = random.Random(seed)
    records = [[rng.randint(0, rng.choice([5, 20, 90])) for _ in range(7)] for _ in range(rng.randint(1, 128))]
    for bits in (1, 4, 9):
        assert lm.page_bytes(*lm.page_writes([t for rec in records for t in [*rec, -1]]), bits) == tm._stream_bytes(records, bits)


def test_pairs_beyond_a_table(spark, monkeypatch):
    texts = lm.Texts([pa.record_batch({"text_code": [2, 1], "tokens": [["a", "b", "a", "b"], ["b", "a"]]})])
    first = texts.counts()
    monkeypatch.setattr(lm, "TABLE", 0)
    assert all((a == b).all() for a, b in zip(first, texts.counts())) and first[1].tolist() == [2, 2]
