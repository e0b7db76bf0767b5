"""Clustered runs, tiles, tagged documents, checked writes and streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import clustered as c
from loomgrid.operators import lexicon as x
from loomgrid.operators.atlas import Atlas
from loomgrid.plans.checked import RelationError, write_checked
from loomgrid.sources import rasterjson as j
from loomgrid.sources.tagged import parsed_tag, read_tagged, write_tagged
from loomgrid.sources.tiles import read_manifest, read_tiles, write_tiles


def some_atlas(spark, seed=1, n=12, spread=2000):
    rng = random.Random(seed)
    maps, runs = [], []
    for k in range(1, n + 1):
        w, h = rng.randint(1, 90), rng.randint(1, 70)
        maps.append((k, rng.randint(-spread, spread), rng.randint(-spread, spread), w, h))
        for y in range(h):
            at = 0
            while at < w:
                length = rng.randint(1, w - at)
                runs.append((k, y, at, length, rng.choice([0, 1, 2, 3])))
                at += length
    return Atlas(spark.createDataFrame(maps, "map_ord long, west long, south long, width long, height long"), spark.createDataFrame(runs, "map_ord long, y long, x0 long, len long, code long")), maps, runs


def scans(node):
    """Leaves of an executed plan, through the stages of adaptive execution."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from scans(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from scans(node.plan())
    elif node.children().size() == 0:
        yield node
    else:
        for k in range(node.children().size()):
            yield from scans(node.children().apply(k))


def files_read(df):
    """(rows, files that the scans of Parquet tables opened); df is run."""
    rows = df.collect()
    n = 0
    for leaf in scans(df._jdf.queryExecution().executedPlan()):
        m = leaf.metrics()
        if m.contains("numFiles"):
            n += m.apply("numFiles").value()
    return rows, n


def test_keys():
    rng = random.Random(2)
    for _ in range(60):
        w, s = rng.randint(-40, 40), rng.randint(-40, 40)
        e, n = w + rng.randint(0, 20), s + rng.randint(0, 20)
        most = rng.choice([1, 3, 24, 1000])
        ranges = c.key_ranges(w, s, e, n, most)
        assert len(ranges) <= most and all(a <= z for a, z in ranges) and all(p[1] < q[0] for p, q in zip(ranges, ranges[1:]))
        inside = {c.key_of(col, row) for col in range(w, e + 1) for row in range(s, n + 1)}
        assert all(any(a <= k <= z for a, z in ranges) for k in inside)
        if most == 1000:
            assert sum(z - a + 1 for a, z in ranges) == len(inside)


def test_column_key_is_the_same(spark):
    pairs = [(a, b) for a in (-1000, -1, 0, 3, 999_999) for b in (-5, 0, 77)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", c.tile_key(F.col("a"), F.col("b")).alias("z")).collect()
    assert all(r.z == c.key_of(r.a, r.b) for r in got)


def test_clustered_reads_fewer_files(spark, tmp_path):
    a, *_ = some_atlas(spark)
    path = str(tmp_path / "t")
    c.write_clustered(a, path)
    stored = c.ClusteredAtlas(a.maps, a.runs, a.unit_x, a.unit_y, a.bucket, path)
    m = a.maps.where("map_ord = 5").select(F.lit(1).alias("rect_id"), (F.col("west") - 2).alias("x"), "south", F.lit(30).cast("bigint").alias("w"), F.lit(20).cast("bigint").alias("h")).withColumnRenamed("south", "y")
    want = sorted(map(tuple, a.rect_codes(m).collect()))
    assert sorted(map(tuple, stored.rect_codes(m).collect())) == want and any(r[3] for r in want)
    everything, all_files = files_read(stored.stored())
    pieces, asked = files_read(stored.pieces_for(m))
    assert 0 < asked < all_files / 2 and 0 < len(pieces) < len(everything)
    r = m.first()
    inside, ranged = files_read(stored.pieces_in(r.x, r.y, r.w, r.h))
    assert 0 < ranged < all_files / 2
    cut = a.global_runs().where((F.col("x0") < r.x + r.w) & (F.col("x1") > r.x) & (F.col("y") >= r.y) & (F.col("y") < r.y + r.h))
    assert sorted(map(tuple, inside)) == sorted(map(tuple, cut.select(*stored.stored().drop("z", "zp").columns).collect()))
    assert stored.pieces_in(0, 0, 0, 5).count() == 0
    nothing = m.where("rect_id = 2")
    assert stored.rect_codes(nothing).count() == 0
    assert sorted(map(tuple, stored.global_runs(a.maps.where("map_ord < 3")).collect())) == sorted(map(tuple, a.global_runs(a.maps.where("map_ord < 3")).select("map_ord", "y", "b", "x0", "x1", "code").collect()))


def test_tiles_and_manifest(spark, tmp_path):
    a, *_ = some_atlas(spark, 3, n=4, spread=300)
    path = str(tmp_path / "t")
    write_tiles(a, path)
    known = {(r.gx, r.gy): r.file for r in read_manifest(spark, path).collect()}
    there = {k for k, f in known.items() if f}
    assert there and len(there) < len(known)
    assert {f"tile={f.split('.')[0]}" for f in known.values() if f} == {d for d in os.listdir(f"{path}/tiles") if d.startswith("tile=")}
    want = sorted(map(tuple, a.global_runs().where("code <> 0").select("map_ord", "y", "x0", "x1", "code").collect()))
    got = read_tiles(spark, path)
    assert sorted(tuple(r)[2:] for r in got.collect()) == want
    some = spark.createDataFrame([next(iter(there)), next(k for k in known if k not in there)], "gx long, gy long")
    part = read_tiles(spark, path, some)
    assert {(r.gx, r.gy) for r in part.collect()} == {next(iter(there))}
    assert all(f"tile={known[next(iter(there))].split('.')[0]}/" in f for f in part.inputFiles())
    assert read_tiles(spark, path, some.limit(0)).count() == 0


def test_tagged_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    os.makedirs(path)
    docs = [("a.json", {"type": "GisRaster:3", "v": 1}), ("b.json", {"type": "Raster:1::LV-RLE-ROWS", "v": "é"}), ("c.json", {"type": "GisRaster:3", "v": None})]
    df = spark.createDataFrame([(f, json.dumps(b, ensure_ascii=False)) for f, b in docs], "file string, body string")
    write_tagged(df.repartition(3), path)
    got = sorted(map(tuple, read_tagged(spark, path).collect()))
    assert got == [(f, *parsed_tag(b["type"]), json.dumps(b, ensure_ascii=False)) for f, b in docs]
    assert [r.file for r in read_tagged(spark, path, "Raster").collect()] == ["b.json"] and read_tagged(spark, path, "Other").count() == 0
    assert sorted(os.listdir(path)) == ["a.json", "b.json", "c.json"]
    write_tagged(df.where("file = 'b.json'"), path, "overwrite")
    assert os.listdir(path) == ["b.json"]


@pytest.mark.parametrize("file, body", [("x.json", '{"type": "a:1:b"}'), ("x.txt", '{"type": "a:1"}'), ("x.json", '{"kind": 1}'), ("../x.json", '{"type": "a:1"}'), ("b.json", '{"type": "a:1"}')])
def test_a_failed_write_leaves_nothing(spark, tmp_path, file, body):
    """A bad tag, a bad name, no tag, a way out of the folder, and two documents of one name."""
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("b.json", '{"type": "a:1"}'), (file, body)], "file string, body string").coalesce(1)
    with pytest.raises(Exception):
        write_tagged(df, path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_walk_of_uneven_trees(spark):
    """Depths differ by branch, siblings come in the order of their positions, and several roots are several trees."""
    nodes = [(1, None, 0, "a"), (2, 1, 5, "b"), (3, 1, 2, "c"), (4, 3, 0, "d"), (5, 4, 0, "e"), (9, None, 1, "z")]
    df = spark.createDataFrame(nodes, "id long, parent long, position long, name string")
    got = x.walk_tree(df).orderBy("path").collect()
    assert ["".join(r.parts) for r in got] == ["a", "ac", "acd", "acde", "ab", "z"]
    assert [r.leaf for r in got] == [False, False, False, True, True, True]
    chain = spark.range(40).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("bigint").alias("position"), F.col("id").cast("string").alias("name"))
    assert x.walk_tree(chain).where("leaf").first().parts == [str(k) for k in range(40)]
    for bad in ([(1, 7, 0, "a")], [(1, None, 0, "a"), (2, 3, 0, "b"), (3, 2, 0, "c")]):
        with pytest.raises(ValueError, match="root"):
            x.walk_tree(spark.createDataFrame(bad, "id long, parent long, position long, name string"))
    with pytest.raises(ValueError, match="deeper"):
        x.walk_tree(chain, 10)
    assert x.walk_tree(df.limit(0)).count() == 0


def test_relations_of_stored_slots(spark, tmp_path):
    paths = spark.createDataFrame([(1, "a", "b", "", "x"), (2, "a", "b", "", "y"), (3, "a", "", "", "x")], "code long, l1 string, l2 string, l3 string, l4 string")
    codes = x.text_codes(x.components(paths))
    found = x.stored_slots(paths, codes, str(tmp_path / "ok"))
    assert (found["slots"], found["records"], found["texts"], found["missing"]) == (12, 3, 5, 0)
    broken = {
        "missing": (paths, codes.where("text <> 'y'")),
        "beyond": (paths, codes.withColumn("text_code", F.col("text_code") + 1)),
        "last": (paths.withColumn("code", F.col("code") * 2), codes),
        "slots": (paths, codes.unionByName(codes.where("text = 'x'"))),
        "code_sum": (paths.withColumn("code", F.when(F.col("code") == 2, 1).otherwise(F.col("code"))), codes),
        "first": (paths.withColumn("code", F.col("code") - 1), codes),
    }
    for name, (p, k) in broken.items():
        out = str(tmp_path / name)
        with pytest.raises(RelationError, match=name):
            x.stored_slots(p, k, out)
        assert not os.path.exists(out)
    empty = x.stored_slots(paths.limit(0), codes, str(tmp_path / "none"))
    assert (empty["slots"], empty["records"]) == (0, 0)


def test_checked_write_names_every_break(spark, tmp_path):
    df = spark.range(5)
    kept = {"n": (F.count(F.lit(1)), 4), "top": (F.max("id"), "n"), "any": (F.min("id"), None)}
    with pytest.raises(RelationError, match="n is 5, not 4; top is 4, not 5"):
        write_checked(df, str(tmp_path / "t"), kept)
    assert write_checked(df, str(tmp_path / "t"), {"n": (F.count(F.lit(1)), 5)}) == {"n": 5}


def test_stream_starts_again(spark, tmp_path):
    """A second run from the same progress adds nothing, new files add their points, once each."""
    from loomgrid.streaming.points import name_stream, read_points

    a, *_ = some_atlas(spark, 5, n=3, spread=20)
    paths = spark.createDataFrame([(1, "a", "", "", "b"), (2, "c", "d", "", "")], "code long, l1 string, l2 string, l3 string, l4 string")
    points = spark.range(60).select(F.col("id").alias("event_id"), F.lit(None).cast("timestamp").alias("ts"), (F.col("id") / 100.0 - 0.2).alias("lon"), (F.col("id") / 150.0).alias("lat"))
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "at"))

    def run():
        name_stream(read_points(spark, folder, 2), a, paths, out, progress).awaitTermination(120)
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    points.where("event_id < 40").repartition(5).write.parquet(folder)
    assert run() == list(range(40)) == run()
    points.where("event_id >= 40").write.mode("append").parquet(folder)
    assert run() == list(range(60))


def test_table_functions(spark):
    from loomgrid.functions import sqlfunctions
    from loomgrid.plans.sql_queries import even_codes

    sqlfunctions.register(spark)
    sqlfunctions.register(spark)
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT * FROM segment_parts(3L, 12L, 4L)") == [(0, 3, 6), (1, 7, 10), (2, 11, 12)] and rows("SELECT * FROM segment_parts(3L, 2L, 4L)") == []
    assert rows("SELECT * FROM interval_parts(0D, 1D, 0.4D)") == [(0, 0.0, 0.4), (1, 0.4, 0.8), (2, 0.8, 1.0)] and rows("SELECT * FROM interval_parts(1D, 1D, 0.4D)") == []
    assert rows("SELECT * FROM run_cells(5L, 3L)") == [(5,), (6,), (7,)] and rows("SELECT * FROM run_cells(5L, 0L)") == []
    sqlfunctions.register_resolver(spark, "even_codes", even_codes)
    got = rows("SELECT even_codes(code, 1L, 2L) FROM VALUES (2L), (3L) t(code)")
    assert got[0][0].asDict() == {"r": 3, "g": 2, "b": 7, "a": 255} and (got[1][0] is None or got[1][0].r is None)


def test_pretty():
    doc = {"type": "Raster:1::LV-RLE-ROWS", "width": 2, "lines": [[2, 1], [1, 0, 1, 5]], "location": {"a": "x" * 40, "b": {"c": "y" * 40}}, "none": None, "empty": {}, "lines2": []}
    text = j.pretty(doc)
    assert json.loads(text) == doc and "    [2, 1],\n    [1, 0, 1, 5]\n" in text and '"none": null' in text
