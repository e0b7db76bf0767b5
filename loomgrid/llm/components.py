"""Connected components of a link table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Links that one task joins; while there are more, rounds over all tasks contract them.
SLICE_LINKS = 1 << 18


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links between the numbers 0 to n - 1: the least number of each one's component."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:  # to the end of each path
            further = up[up]
            if (further == up).all():
                break
            up = further
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return up


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of any orderable type. (node, root) of every linked node; root is the least node of the component.

    Each round gives a node the least of itself and its neighbours and maps links to those; links inside one node go.
    Rounds take turns at what is least: a node's own order settles stars at once, a hash that is new each time settles a
    part of any chain. Every round takes away nodes, so the loop ends. Least-of aggregates combine on the map side, so a
    node with very many links is no task of its own. When at most SLICE_LINKS links are left, one task joins them: each
    round is a few jobs however little it moves, and a dozen rounds would go on as few links as these.
    """
    edges = materialize(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    labels, turn = None, 0

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            ends = pa.chunked_array([*t["a"].chunks, *t["b"].chunks]).combine_chunks()
            names = ends.unique()
            names = names.take(pc.array_sort_indices(names))  # numbers in the order of names, so the least number has the least name
            at = pc.index_in(ends, names).to_numpy()
            up = joined(at[: t.num_rows], at[t.num_rows :], len(names))
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(up))], ["node", "up"])

    while left := edges.count():
        if left <= SLICE_LINKS:
            least = materialize(edges.coalesce(1).mapInArrow(tidy(last), f"node {kind}, up {kind}"), "least")
            labels = composed(labels, least)
            turn += 1
            break

        def key(node: str, turn: int = turn) -> Column:
            return F.struct((F.xxhash64(node, F.lit(turn)) if turn % 2 else F.lit(0).cast("long")).alias("h"), F.col(node).alias("n"))

        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min(key("b")).alias("b")).select(F.col("a").alias("node"), F.least(key("a"), "b")["n"].alias("up")), "least")
        labels = composed(labels, least)
        moved = edges.join(least.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(least.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        edges = materialize(moved.where(F.col("ua") != F.col("ub")).select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        turn += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    if turn < 2:
        return labels
    names = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(names, "root").select("node", F.col("least").alias("root"))


def composed(labels: DataFrame | None, least: DataFrame) -> DataFrame:
    """labels (node, root) after a round that maps roots by least (node, up)."""
    if labels is None:
        return least.select("node", F.col("up").alias("root"))
    return materialize(labels.join(least.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
