"""Operators on rasters, as cells (x, y, code) or runs (y, x0, len, code). Row 0 is the southernmost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.functions.grid import floor_div


def cells_of(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs, expanded."""
    some = runs.where(F.col("len") > 0)
    return some.select(*keys, F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("len") - 1)).alias("x"), "y", "code")


def encode_runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal neighbours by key: (keys, run, start, count, value); run counts from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    marked = df.withColumn("__new", first).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*keys, F.col("__run").alias("run")).agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("count"), F.min(value).alias(value))


def violations(runs: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows of maps whose runs don't cover them: (map_ord, y, total, width, bad_runs); a missing row has total 0."""
    rows = maps.where(F.col("height") > 0).select("map_ord", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)).alias("y"))
    per = runs.groupBy("map_ord", "y").agg(F.sum("len").alias("total"), F.sum((F.col("len") <= 0).cast("bigint")).alias("bad_runs"))
    j = rows.join(per, ["map_ord", "y"], "full").select("map_ord", "y", F.coalesce("total", F.lit(0)).alias("total"), "width", F.coalesce("bad_runs", F.lit(0)).alias("bad_runs"))
    return j.where(F.col("width").isNull() | (F.col("total") != F.col("width")) | (F.col("bad_runs") > 0))


def clip_runs(runs: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Runs within a rectangle, in its coordinates, without expanding them."""
    a, z = F.greatest("x0", F.lit(x)), F.least(F.col("x0") + F.col("len"), F.lit(x + w))
    inside = runs.where((F.col("y") >= y) & (F.col("y") < y + h) & (a < z))
    return inside.withColumn("len", (z - a).cast("bigint")).withColumn("x0", (a - x).cast("bigint")).withColumn("y", (F.col("y") - y).cast("bigint"))


def zonal(cells: DataFrame, *keys: str) -> DataFrame:
    """By value: pixels, floor of the mean place, and bounds whose size is last minus first."""
    g = cells.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return g.select(*keys, "code", "n", floor_div(F.col("sx"), F.col("n")).alias("cx"), floor_div(F.col("sy"), F.col("n")).alias("cy"), "x", "y", (F.col("x2") - F.col("x")).alias("width"), (F.col("y2") - F.col("y")).alias("height"))


def zonal_of_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """zonal() without expanding runs: a run's sum of x is an arithmetic series."""
    n = F.col("len")
    g = runs.where(n > 0).groupBy(*keys, "code").agg(F.sum("len").alias("n"), F.sum(n * F.col("x0") + F.expr("len * (len - 1) div 2")).alias("sx"), F.sum(n * F.col("y")).alias("sy"), F.min("x0").alias("x"), F.min("y").alias("y"), F.max(F.col("x0") + n - 1).alias("x2"), F.max("y").alias("y2"))
    return g.select(*keys, "code", "n", floor_div(F.col("sx"), F.col("n")).alias("cx"), floor_div(F.col("sy"), F.col("n")).alias("cy"), "x", "y", (F.col("x2") - F.col("x")).alias("width"), (F.col("y2") - F.col("y")).alias("height"))


def resample_max_area(cells: DataFrame, k: int, minimum_rate: float, *keys: str) -> DataFrame:
    """Coarser cells of k x k: the code of the largest share (the smaller code on ties) if the share reaches the rate, else 0."""
    g = cells.groupBy(*keys, floor_div(F.col("x"), k).alias("x"), floor_div(F.col("y"), k).alias("y"), "code").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy(*keys, "x", "y").agg(F.max(F.struct(F.col("n").alias("n"), (-F.col("code")).alias("c"))).alias("b"))
    return best.select(*keys, "x", "y", F.when(F.col("b.n") >= minimum_rate * k * k, -F.col("b.c")).otherwise(0).cast("bigint").alias("code"))


def resample_center(cells: DataFrame, k: int, *keys: str) -> DataFrame:
    half = k // 2
    at = cells.where((F.pmod(F.col("x"), F.lit(k)) == half) & (F.pmod(F.col("y"), F.lit(k)) == half))
    return at.select(*keys, floor_div(F.col("x"), k).alias("x"), floor_div(F.col("y"), k).alias("y"), "code")


def padded(cells: DataFrame, w: int, h: int, left: int, top: int, right: int, bottom: int, pad: int) -> DataFrame:
    """A w x h raster within a margin; top is the margin on the low-y side."""
    spark = cells.sparkSession
    moved = cells.select((F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), "code")
    grid = spark.range(h + top + bottom).select(F.col("id").alias("y")).select("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(w + left + right - 1))).alias("x"))
    return grid.join(moved, ["x", "y"], "left").select("x", "y", F.coalesce("code", F.lit(pad)).cast("bigint").alias("code"))


def framed(runs: DataFrame, rows: DataFrame, fill: int, *carried: str) -> DataFrame:
    """(map_ord, x, y, code, carried) of every cell of rows (map_ord, y, width, carried): the code of its run, else the fill.

    Rows meet their runs as members of one group. A join would take exploded tables for as small as what they were exploded
    from, and broadcast one of them. Runs of a row don't overlap; what lies outside of the row is cut.
    """
    run = F.struct(F.col("x0").alias("a"), (F.col("x0") + F.col("len")).alias("z"), F.col("code").alias("c"))
    kept = ["width", *carried]
    given = rows.select("map_ord", "y", F.struct(*kept).alias("row"), F.lit(None).cast("struct<a:bigint,z:bigint,c:bigint>").alias("run"))
    held = runs.where("len > 0").select("map_ord", "y", F.lit(None).cast(given.schema["row"].dataType).alias("row"), run.alias("run"))
    g = given.unionByName(held).groupBy("map_ord", "y").agg(F.max("row").alias("row"), F.sort_array(F.collect_list("run")).alias("runs")).where("row is not null")
    zero, pad, width = F.lit(0).cast("bigint"), F.lit(fill).cast("bigint"), F.col("row.width").cast("bigint")
    piece = lambda a, z, c: F.struct(F.greatest(a, zero).alias("a"), F.least(z, width).alias("z"), c.alias("c"))
    own = F.transform("runs", lambda r: piece(r["a"], r["z"], F.coalesce(r["c"], pad)))
    before = F.transform("runs", lambda r, k: piece(F.coalesce(F.get("runs", k - 1)["z"], zero), r["a"], pad))
    after = F.array(piece(F.coalesce(F.try_element_at("runs", F.lit(-1))["z"], zero), width, pad))
    pieces = F.filter(F.concat(own, before, after), lambda q: q["a"] < q["z"])
    cut = g.select("map_ord", "y", *[F.col(f"row.{c}").alias(c) for c in carried], F.explode(pieces).alias("q"))
    return cut.select("map_ord", F.explode(F.sequence(F.col("q.a"), F.col("q.z") - 1)).alias("x"), "y", F.col("q.c").alias("code"), *carried)


def padded_maps(runs: DataFrame, maps: DataFrame, left: int, top: int, right: int, bottom: int, pad: int) -> DataFrame:
    """padded() of every map by its own size, out of its runs: (map_ord, x, y, code)."""
    moved = runs.select("map_ord", (F.col("y") + top).alias("y"), (F.col("x0") + left).alias("x0"), "len", "code")
    last = F.col("height") + (top + bottom - 1)
    rows = maps.where(last >= 0).select("map_ord", (F.col("width") + (left + right)).alias("width"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("y"))
    return framed(moved, rows, pad)


def blocks_filled(runs: DataFrame, maps: DataFrame, side: int) -> DataFrame:
    """(map_ord, x, y, code, padding) of every map with its edge blocks of side x side filled up by zeros."""
    whole = lambda c: F.expr(f"({c} + {side - 1}) div {side} * {side}")
    some = maps.where("width > 0 and height > 0")
    rows = some.select("map_ord", "width", "height", F.explode(F.sequence(F.lit(0).cast("bigint"), whole("height") - 1)).alias("y"))
    inner = F.when(F.col("y") < F.col("height"), F.col("width")).otherwise(0).cast("bigint").alias("inner")
    cells = framed(runs, rows.select("map_ord", "y", whole("width").alias("width"), inner), 0, "inner")
    return cells.select("map_ord", "x", "y", "code", (F.col("x") >= F.col("inner")).alias("padding"))


def tiles(cells: DataFrame, unit: int, *keys: str) -> DataFrame:
    """Cells with the tile that holds them and their place in it."""
    return cells.select(*keys, floor_div(F.col("x"), unit).alias("tx"), floor_div(F.col("y"), unit).alias("ty"), F.pmod("x", F.lit(unit)).alias("x"), F.pmod("y", F.lit(unit)).alias("y"), "code")


def quadtree(cells: DataFrame, levels: int, *keys: str) -> DataFrame:
    """Squares of one code, as large as they get: (keys, level, qx, qy, code). Level k is 2**k cells wide.

    A cell's square is the largest that is full and of one code, and its first cell stands for it. Cells are dealt once,
    by their largest possible square, and sorted once, by the squares of all levels from the largest down, so the window
    of each level finds its rows together: one shuffle and one sort for any number of levels.
    """
    squares = [f"__{axis}{k}" for k in range(levels, 0, -1) for axis in "xy"]
    c = cells.select(*keys, "x", "y", "code", *[F.expr(f"shiftright({axis}, {k})").alias(f"__{axis}{k}") for k in range(levels, 0, -1) for axis in "xy"])
    level = F.lit(0)
    for k in range(1, levels + 1):
        w = Window.partitionBy(*keys, *squares[: 2 * (levels - k + 1)])
        c = c.withColumn(f"__ok{k}", (F.count(F.lit(1)).over(w) == 4**k) & (F.min("code").over(w) == F.max("code").over(w)))
        level = F.when(F.col(f"__ok{k}"), k).otherwise(level)
    side = F.expr("shiftleft(1L, level)")
    first = c.withColumn("level", level).where((F.pmod("x", side) == 0) & (F.pmod("y", side) == 0))
    return first.select(*keys, "level", F.expr("shiftright(x, level)").alias("qx"), F.expr("shiftright(y, level)").alias("qy"), "code")


def quad_cells(quads: DataFrame, *keys: str) -> DataFrame:
    side = F.expr("shiftleft(1L, level)")
    rows = quads.withColumn("side", side).withColumn("y", F.explode(F.sequence(F.col("qy") * F.col("side"), (F.col("qy") + 1) * F.col("side") - 1)))
    return rows.select(*keys, F.explode(F.sequence(F.col("qx") * F.col("side"), (F.col("qx") + 1) * F.col("side") - 1)).alias("x"), "y", "code")


def edges(cells: DataFrame, *keys: str, include_zero: bool = True) -> DataFrame:
    """Cells whose east or north neighbour differs; without include_zero both codes must be set. A raster's last column and row have no such neighbour."""
    east = F.lead("code").over(Window.partitionBy(*keys, "y").orderBy("x"))
    north = F.lead("code").over(Window.partitionBy(*keys, "x").orderBy("y"))
    w = cells.withColumn("e", east).withColumn("n", north)

    def differs(v: str) -> Column:
        d = F.coalesce(F.col(v) != F.col("code"), F.lit(False))
        return d if include_zero else d & (F.col(v) != 0) & (F.col("code") != 0)

    return w.where(differs("e") | differs("n")).select(*keys, "x", "y")


def same_raster(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same cells."""
    left = a.select("x", "y", "code").exceptAll(b.select("x", "y", "code")).agg(F.count(F.lit(1)).alias("n"))
    right = b.select("x", "y", "code").exceptAll(a.select("x", "y", "code")).agg(F.count(F.lit(1)).alias("n"))
    return left.unionAll(right).agg((F.sum("n") == 0).alias("equal"))


def row_lines(runs: DataFrame, key: str) -> DataFrame:
    """(key, y, line) of every row that has cells: its maximal runs in order, so two rows hold the same cells if their lines are equal. Runs of a row don't overlap."""
    run = F.struct(F.col("x0").alias("a"), (F.col("x0") + F.col("len")).alias("z"), F.col("code").alias("c"))
    g = runs.where("len > 0").groupBy(key, "y").agg(F.sort_array(F.collect_list(run)).alias("r"))

    def joins(k: Column) -> Column:  # whether run k goes on from the one before it
        b, r = F.get("r", k - 1), F.get("r", k)
        return F.coalesce((b["z"] == r["a"]) & b["c"].eqNullSafe(r["c"]), F.lit(False))

    heads = F.filter("r", lambda r, k: ~joins(k))
    tails = F.filter("r", lambda r, k: ~joins(k + 1))
    return g.select(key, "y", F.zip_with(heads, tails, lambda h, t: F.struct(h["a"].alias("a"), t["z"].alias("z"), h["c"].alias("c"))).alias("line"))


def same_lines(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, equal) of every key in a or b, out of row_lines(): whether both hold the same cells. What is shuffled is a line a row."""
    side = lambda df, n: df.select(key, "y", "line", F.lit(n).alias("side"))
    rows = side(a, 1).unionByName(side(b, 2)).groupBy(key, "y").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("l"), F.max("line").alias("m"))
    return rows.groupBy(key).agg(F.min((F.col("n") == 2) & F.col("l").eqNullSafe(F.col("m"))).alias("equal"))


def same_rasters(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, equal) of every key in a or b: whether both hold the same cells."""
    both = a.select(key, "x", "y", "code", F.lit(1).alias("n")).unionByName(b.select(key, "x", "y", "code", F.lit(-1).alias("n")))
    cells = both.groupBy(key, "x", "y", "code").agg(F.sum("n").alias("n"))
    return cells.groupBy(key).agg((F.max(F.abs("n")) == 0).alias("equal"))
