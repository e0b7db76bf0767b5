"""Row numbers over more rows than a range sampling looks at, with columns beside the sort keys."""

import pytest
from pyspark.sql import functions as F

from loomgrid.plans.ranks import within_groups, with_global_index


@pytest.mark.parametrize("parts", [4, 8, 17])
def test_numbers_are_whole(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 200_000
        df = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.col("id").cast("string"), 5).alias("payload"))
        got = with_global_index(df, ["k"])
        r = got.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx"), F.count("idx")).first()
        assert tuple(r) == (0, n - 1, n, n)
        later = got.select((F.col("idx") + 1).alias("idx"), F.col("k").alias("before"))
        assert got.join(later, "idx").where("before >= k").count() == 0
        g = within_groups(df.withColumn("g", F.when(F.col("k") % 10 > 3, F.col("k") % 3)), ["g"], ["k"], "at")
        sums = g.groupBy("g").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count_distinct("at").alias("d"), F.count("at").alias("n")).collect()
        assert all((s.a, s.b, s.d) == (0, s.n - 1, s.n) for s in sums) and sum(s.n for s in sums) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
