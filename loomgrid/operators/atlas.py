"""A set of overlapping rasters on one grid, held as runs, and lookups in it.

Runs are put, in pieces, into buckets of one grid row and `bucket` columns, and the pieces of a bucket are composed: segments
that lie side by side, each with how many maps cover it and their first and last code. A point then meets one row by an
equi-join and takes its segment by its column, so no range join is planned, and a bucket is as large as the grid makes it, however
many maps lie there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import floor_div
from loomgrid.plans.tables import materialize

#: An index is broadcast up to this many bytes, as counted in the written table, and joined by shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Maps of one place are listed together by their numbers without the last bits, so a list has 2**16 of them at most.
LIST_BITS = 16


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the estimate of df's size allows one."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def written(df: DataFrame, name: str, row_bytes: Column | int) -> DataFrame:
    """df as a table, with a broadcast hint if the bytes of its rows, summed, allow one, and else a hint for a shuffle join.

    Catalyst takes an exploded table for as small as what it was exploded from, so its estimate decides nothing here.
    """
    table = materialize(df, name)
    size = table.agg(F.sum((F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).cast("bigint"))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge")


@dataclass(frozen=True)
class Atlas:
    """maps: map_ord, west, south, width, height. runs: map_ord, y, x0, len, code in a map's own coordinates.

    Runs must cover their maps (see raster.violations); 0 is covered but unset. map_ord is the storage order.
    """

    maps: DataFrame
    runs: DataFrame
    unit_x: int = 100
    unit_y: int = 100
    bucket: int = 64

    def bounds(self) -> DataFrame:
        """One row: x, y, w, h of the least rectangle around all maps."""
        m = self.maps.agg(F.min("west").alias("x"), F.min("south").alias("y"), F.max(F.col("west") + F.col("width")).alias("x2"), F.max(F.col("south") + F.col("height")).alias("y2"))
        return m.select("x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))

    def global_runs(self, maps: DataFrame | None = None) -> DataFrame:
        """Runs on the grid, each within one bucket: map_ord, y, b, x0, x1 (exclusive), code. Runs past a map's edge are clipped."""
        m = small((self.maps if maps is None else maps).select("map_ord", "west", "south", "width", "height"))
        r = self.runs.join(m, "map_ord").where((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x0") < F.col("width")) & (F.col("len") > 0))
        r = r.select("map_ord", (F.col("y") + F.col("south")).alias("y"), (F.col("x0") + F.col("west")).alias("x0"), (F.least(F.col("x0") + F.col("len"), F.col("width")) + F.col("west")).alias("x1"), "code")
        n = self.bucket
        r = r.withColumn("b", F.explode(F.sequence(floor_div(F.col("x0"), n), floor_div(F.col("x1") - 1, n))))
        return r.select("map_ord", "y", "b", F.greatest("x0", F.col("b") * n).alias("x0"), F.least("x1", (F.col("b") + 1) * n).alias("x1"), "code")

    def pieces_for(self, rects: DataFrame) -> DataFrame:
        """global_runs() of the maps that the rectangles may meet."""
        return self.global_runs(self.touching(rects))

    def composed(self, pieces: DataFrame | None = None) -> DataFrame:
        """By (iy, ib): segments, and for each column of the bucket the number of its segment. A segment: n maps over it, their first and last code that is set.

        Pieces of the same place are made one by aggregates first, so a bucket collects at most bucket * (bucket + 1) / 2.
        """
        n, order = self.bucket, F.when(F.col("code") != 0, F.col("map_ord"))
        places = (self.global_runs() if pieces is None else pieces).groupBy("y", "b", "x0", "x1").agg(
            F.count(F.lit(1)).alias("n"), F.min(order).alias("fo"), F.min_by("code", order).alias("fc"), F.max(order).alias("lo"), F.max_by("code", order).alias("lc")
        )
        pair = lambda o, c: F.when(F.col(o).isNotNull(), F.struct(F.col(o).alias("o"), F.col(c).alias("c")))
        place = F.struct(F.col("x0").alias("a"), F.col("x1").alias("z"), "n", pair("fo", "fc").alias("first"), pair("lo", "lc").alias("last"))
        held = places.groupBy(F.col("y").alias("iy"), F.col("b").alias("ib")).agg(F.collect_list(place).alias("p"))
        edges = F.concat(F.col("p.a"), F.col("p.z"), F.array(F.col("ib") * n, (F.col("ib") + 1) * n))
        held = held.withColumn("cuts", F.array_sort(F.array_distinct(edges)))

        def segment(x: Column, k: Column) -> Column:
            over = F.filter("p", lambda q: (q["a"] <= x) & (x < q["z"]))
            pick = lambda h: F.struct(
                F.aggregate(h, F.lit(0).cast("bigint"), lambda s, q: s + q["n"]).alias("n"),
                F.array_min(F.transform(h, lambda q: q["first"]))["c"].alias("first"),
                F.array_max(F.transform(h, lambda q: q["last"]))["c"].alias("last"),
                (F.get("cuts", k + 1) - x).cast("int").alias("wide"),
            )
            return F.get(F.transform(F.array(over), pick), 0)

        held = held.select("iy", "ib", F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), segment).alias("segments"))
        at = F.flatten(F.transform("segments", lambda s, k: F.array_repeat(k.cast("smallint"), s["wide"])))
        return held.select("iy", "ib", at.alias("at"), F.transform("segments", lambda s: F.struct(s["n"].alias("n"), s["first"].alias("first"), s["last"].alias("last"))).alias("segments"))

    def index(self, pieces: DataFrame | None = None) -> DataFrame:
        """composed(), written."""
        return written(self.composed(pieces), "atlas", F.size("segments") * 40 + (2 * self.bucket + 100))

    def _at(self, x: Column) -> Column:
        """The segment over a column of the grid, after a join with the index."""
        return F.get("segments", F.get("at", (x - F.col("ib") * self.bucket).cast("int")))

    def point_codes(self, points: DataFrame, x: str = "x", y: str = "y", index: DataFrame | None = None) -> DataFrame:
        """points with code and cover (maps over the point): the first non-zero code in storage order, 0 if covered but unset, else null."""
        j = points.join(self.index() if index is None else index, (F.col(y) == F.col("iy")) & (floor_div(F.col(x), self.bucket) == F.col("ib")), "left")
        j = j.withColumn("found", self._at(F.col(x)))
        cover = F.coalesce(F.col("found.n"), F.lit(0).cast("bigint"))
        code = F.when(cover > 0, F.coalesce(F.col("found.first"), F.lit(0).cast("bigint")))
        return j.withColumn("cover", cover).withColumn("code", code).drop("iy", "ib", "at", "segments", "found")

    def named(self, points: DataFrame, paths: DataFrame) -> DataFrame:
        """point_codes() with the paths (code, ...) of their codes. Only paths whose code a map has are joined."""
        index = self.index()
        codes = index.select(F.explode("segments.first").alias("code")).where("code is not null").distinct()
        own = [c for c in paths.columns if c != "code"]
        size = F.lit(64)
        for c in own:
            size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
        used = written(paths.join(written(codes, "codes", 16), "code", "left_semi"), "names", size)
        return self.point_codes(points, index=index).join(used, "code", "left")

    def listed(self) -> DataFrame:
        """By (iy, ib), and leading bits of the maps' numbers: pieces of runs, those of one place and code as a list of maps. Written."""
        part = F.shiftright("map_ord", LIST_BITS).alias("part")
        same = self.global_runs().groupBy("y", "b", part, "x0", "x1", "code").agg(F.collect_list("map_ord").alias("maps"))
        piece = F.struct(F.col("x0").alias("a"), F.col("x1").alias("z"), F.col("code").alias("c"), "maps")
        held = same.groupBy(F.col("y").alias("iy"), F.col("b").alias("ib"), "part").agg(F.collect_list(piece).alias("pieces")).drop("part")
        return written(held, "lists", F.aggregate("pieces", F.lit(100), lambda s, q: s + F.size(q["maps"]) * 8 + 80))

    def covering(self, points: DataFrame, key: str) -> DataFrame:
        """(key, map_ord, code) of every map over each point."""
        j = points.join(self.listed(), (F.col("y") == F.col("iy")) & (floor_div(F.col("x"), self.bucket) == F.col("ib")))
        over = F.filter("pieces", lambda p: (p["a"] <= F.col("x")) & (F.col("x") < p["z"]))
        return j.select(key, F.explode(over).alias("p")).select(key, F.explode("p.maps").alias("map_ord"), F.col("p.c").alias("code"))

    def rect_codes(self, rects: DataFrame, key: str = "rect_id") -> DataFrame:
        """(key, x, y, code) of every cell of each rectangle (key, x, y, w, h): the last non-zero code in storage order, else 0.

        The join is on strips of a row and a bucket; cells are made after it.
        """
        n = self.bucket
        some = rects.where((F.col("w") > 0) & (F.col("h") > 0))
        rows = some.select(key, F.col("x").alias("rx"), "w", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("y"))
        strips = rows.withColumn("b", F.explode(F.sequence(floor_div(F.col("rx"), n), floor_div(F.col("rx") + F.col("w") - 1, n))))
        strips = strips.select(key, "y", "b", F.greatest("rx", F.col("b") * n).alias("xa"), (F.least(F.col("rx") + F.col("w"), (F.col("b") + 1) * n) - 1).alias("xz"))
        # one request may be the whole grid: its strips are dealt before they are expanded
        strips = strips.repartition(int(rects.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "y", "b")
        j = strips.join(self.index(self.pieces_for(rects)), (F.col("y") == F.col("iy")) & (F.col("b") == F.col("ib")), "left")
        cells = j.select(key, "y", "ib", "at", "segments", F.explode(F.sequence("xa", "xz")).alias("x"))
        return cells.select(key, "x", "y", F.coalesce(self._at(F.col("x"))["last"], F.lit(0).cast("bigint")).alias("code"))

    def touching(self, rects: DataFrame) -> DataFrame:
        """Maps that meet the rectangle around all requests; the others' runs are not read."""
        around = rects.where((F.col("w") > 0) & (F.col("h") > 0)).agg(F.min("x").alias("qx"), F.min("y").alias("qy"), F.max(F.col("x") + F.col("w")).alias("qx2"), F.max(F.col("y") + F.col("h")).alias("qy2"))
        meets = (F.col("west") < F.col("qx2")) & (F.col("qx") < F.col("west") + F.col("width")) & (F.col("south") < F.col("qy2")) & (F.col("qy") < F.col("south") + F.col("height"))
        # one row on the right
        return self.maps.join(F.broadcast(around), meets, "left_semi")

    def places(self) -> DataFrame:
        """(west, south, width, height, maps): maps of one place as a list, 2**LIST_BITS at most."""
        place = ["west", "south", "width", "height"]
        some = self.maps.where((F.col("width") > 0) & (F.col("height") > 0))
        return some.groupBy(*place, F.shiftright("map_ord", LIST_BITS).alias("part")).agg(F.collect_list("map_ord").alias("maps")).drop("part")

    def meeting(self, rects: DataFrame, key: str = "rect_id", square: int = 128) -> DataFrame:
        """rects (key, x, y, w, h and others) beside the places (west, south, width, height, maps) that they meet, by an equi-join on squares of the grid.

        A pair may meet in several squares; it counts in the one that holds their common part's first cell. Requests are
        compared with places and not with maps, and dealt over tasks first: what they meet is far more than they are.
        """

        def dealt(df: DataFrame, x: str, y: str, w: str, h: str) -> DataFrame:
            some = df.where((F.col(w) > 0) & (F.col(h) > 0))
            some = some.withColumn("gx", F.explode(F.sequence(floor_div(F.col(x), square), floor_div(F.col(x) + F.col(w) - 1, square))))
            return some.withColumn("gy", F.explode(F.sequence(floor_div(F.col(y), square), floor_div(F.col(y) + F.col(h) - 1, square))))

        n = int(rects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = written(dealt(self.places(), "west", "south", "width", "height"), "places", F.size("maps") * 8 + 100)
        j = dealt(rects.repartition(n, key), "x", "y", "w", "h").join(held, ["gx", "gy"])
        meets = (F.col("west") < F.col("x") + F.col("w")) & (F.col("x") < F.col("west") + F.col("width")) & (F.col("south") < F.col("y") + F.col("h")) & (F.col("y") < F.col("south") + F.col("height"))
        first = (floor_div(F.greatest("x", "west"), square) == F.col("gx")) & (floor_div(F.greatest("y", "south"), square) == F.col("gy"))
        return j.where(meets & first).drop("gx", "gy")

    def touching_each(self, rects: DataFrame, key: str = "rect_id", square: int = 128) -> DataFrame:
        """(key, map_ord) of the maps that each request meets."""
        return self.meeting(rects.select(key, "x", "y", "w", "h"), key, square).select(key, F.explode("maps").alias("map_ord"))

    def full(self) -> DataFrame:
        """(x, y, code) of the rectangle around all maps."""
        return self.rect_codes(self.bounds().select(F.lit(0).alias("rect_id"), "x", "y", "w", "h")).drop("rect_id")


def union(*parts: Atlas) -> Atlas:
    """Maps of all parts, those of earlier parts first; the units must agree."""
    first = parts[0]
    if any((p.unit_x, p.unit_y) != (first.unit_x, first.unit_y) for p in parts):
        raise ValueError("the parts' units differ")
    step = F.lit(1 << 32)
    maps = [p.maps.withColumn("map_ord", F.col("map_ord") + k * step) for k, p in enumerate(parts)]
    runs = [p.runs.withColumn("map_ord", F.col("map_ord") + k * step) for k, p in enumerate(parts)]
    for k in range(1, len(parts)):
        maps[0], runs[0] = maps[0].unionByName(maps[k]), runs[0].unionByName(runs[k])
    return Atlas(maps[0], runs[0], first.unit_x, first.unit_y, first.bucket)
