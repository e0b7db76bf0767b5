"""Global row numbers without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import materialize, partitions_for


def with_global_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """df with its 0-based place in the order. The order must be total.

    Rows are sorted in ranges, and written with their place in the range: the bounds of ranges are sampled, so the
    counts must come from the very rows that are numbered and not from a second run of the sort. A row's place is its
    range's base and its place there. Only the counts of the ranges, one row each, meet in one task.
    """
    placed = df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__range", F.expr("shiftright(__id, 33)")).withColumn("__at", F.expr("__id & 8589934591L")).drop("__id")
    placed = materialize(placed, "ranks")
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    bases = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__base"))
    # one row a range
    return placed.join(F.broadcast(bases), "__range").withColumn(name, (F.col("__base") + F.col("__at")).cast("bigint")).drop("__range", "__at", "__base")


def within_groups(df: DataFrame, keys: list[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """df with each row's 0-based place in its group. keys and order together must be total.

    Groups are consecutive in one global order, so a group of any size is spread over ranges.
    """
    numbered = with_global_index(df, [*keys, *order], "__global")
    firsts = numbered.groupBy(*keys).agg(F.min("__global").alias("__first")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return numbered.join(firsts, same).withColumn(name, F.col("__global") - F.col("__first")).drop("__global", "__first", *(f"__{k}" for k in keys))


def running(df: DataFrame, seq: str, value: str, name: str, how: str = "sum", block: int = 100_000) -> DataFrame:
    """The running sum or max of value along seq, whole numbers without large gaps, first row included.

    Blocks of seq run side by side; what comes before a block is one number each.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    b = df.withColumn("__b", F.floor(F.col(seq) / block))
    totals = b.groupBy("__b").agg(agg(value).alias("__t"))
    before = totals.select("__b", agg("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = agg(value).over(Window.partitionBy("__b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    j = b.withColumn("__own", own).join(before, "__b")
    out = F.col("__own") + F.coalesce("__before", F.lit(0)) if how == "sum" else F.greatest("__own", "__before")
    return j.withColumn(name, out).drop("__b", "__own", "__before")
