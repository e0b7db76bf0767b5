"""Tables in the shared folder: what a call drops, and what it leaves to others."""

import threading

from loomgrid.plans.tables import drop_since, made, materialize


def test_a_call_drops_its_own_tables(spark):
    mark = made()
    a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    kept = drop_since(mark, b)
    assert kept.count() == 4 and not mark == [] and len(mark) == 1
    try:
        a.count()
        raise AssertionError("the table is still there")
    except Exception as gone:
        assert "AssertionError" not in type(gone).__name__


def test_an_inner_call_leaves_the_outer_ones_tables(spark):
    outer = made()
    first = materialize(spark.range(3), "first")
    inner = made()
    scratch, result = materialize(spark.range(5), "scratch"), materialize(spark.range(6), "result")
    drop_since(inner, result)
    assert first.count() == 3 and result.count() == 6 and len(outer) == 2
    drop_since(outer, first.unionAll(result))
    assert first.count() == 3 and result.count() == 6


def test_threads_keep_their_tables_apart(spark):
    """Two calls at once, one of which ends first."""
    mark = made()
    mine = materialize(spark.range(7), "mine")

    def other():
        own = made()
        table = materialize(spark.range(8), "other")
        drop_since(own, table)

    t = threading.Thread(target=other)
    t.start()
    t.join()
    later = materialize(spark.range(9), "later")
    drop_since(mark, mine.unionAll(later))
    assert mine.count() == 7 and later.count() == 9


def test_partitions_follow_the_tables_that_are_read(spark, tmp_path):
    """Not the product that a join is estimated at."""
    from loomgrid.plans.tables import input_bytes, partitions_for

    spark.range(5000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    n = input_bytes(t)
    joined = t.crossJoin(t.withColumnRenamed("id", "b")).crossJoin(t.withColumnRenamed("id", "c"))
    assert 0 < n < 1 << 20 and input_bytes(joined) == 3 * n
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(joined) == parts and partitions_for(t, 1 + n // 40) in range(39, 42)
