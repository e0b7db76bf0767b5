"""Embedding whitening with MLlib's BlockMatrix.

Each vector becomes whole numbers, floor(scale x entry). The fit list holds each of them once; its centred rows are
indexed into a BlockMatrix, whose transpose times itself is the scatter, one square of the dimensions. Its eigenvectors
are found on the driver, and a BlockMatrix of all centred rows times the whitening matrix projects every row.

The product of a tall matrix with its transpose is one block; its middle dimension is split over the row blocks, so their
products are made apart and added. Block coordinates pass through the driver, so a matrix holds MATRIX_ROWS rows at most, and
more rows are several matrices whose scatters are added. Rows are numbered by the written files' parts: no sort, and a vector
that a third of the rows share is no task of its own.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, and so are those of another
length than most vectors have (of equally common lengths the longer stays) and empty ones; a null vec_id stays null; repeated
rows each get their rows; other columns are dropped, also those named like a result; an empty table gives no rows. A
deviation that no long can hold is null. A component without variance (its eigenvalue is rounding of the largest) has
whitened 0, and identity_error doesn't look at it; if nothing varies, explained is 0. Of two eigenvectors of opposite sign the one
whose largest entry is positive is taken. A very long vector costs its square on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_since, made, materialize

#: Rows of one BlockMatrix at most.
MATRIX_ROWS = 1 << 26
#: Bytes of a block.
BLOCK_BYTES = 4 << 20
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def numbered(df: DataFrame) -> DataFrame:
    """df, written, with idx from 0 without gaps."""
    placed = df.withColumn("id", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("part", F.expr("shiftright(id, 33)")).withColumn("at", F.expr("id & 8589934591L")).drop("id"), "placed")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    bases = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    # one row a part
    return materialize(placed.join(F.broadcast(bases), "part").withColumn("idx", F.col("base") + F.col("at")).drop("part", "at", "base"), "numbered")


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def block_matrix(rows: DataFrame, mean: list[float], first: int, n: int, matrix_rows: int) -> BlockMatrix:
    """Rows (idx, x) less the mean, as the matrix of rows first to first + n - 1; rows that are not there are zeros."""
    d = len(mean)
    centred = F.zip_with("x", F.lit(mean), lambda x, m: x.cast("double") - m)
    own = rows.where((F.col("idx") >= first) & (F.col("idx") < first + n)).select((F.col("idx") - first).alias("index"), array_to_vector(centred).alias("vector"))
    own = MLUtils.convertVectorColumnsFromML(own, "vector")
    return IndexedRowMatrix(own, n, d).toBlockMatrix(block_rows(d, matrix_rows), min(d, 1024))


def block_rows(d: int, matrix_rows: int) -> int:
    return max(1, min(matrix_rows, BLOCK_BYTES // 8 // min(d, 1024)))


def slices(rows: int, matrix_rows: int) -> Iterator[tuple[int, int]]:
    for first in range(0, rows, matrix_rows):
        yield first, min(matrix_rows, rows - first)


def scatter(a: BlockMatrix) -> np.ndarray:
    """a's transpose times a. Row blocks are multiplied apart (the last argument of MLlib's multiply, which Python's doesn't take)."""
    left, right = a.transpose()._java_matrix_wrapper, a._java_matrix_wrapper
    product = left.call("multiply", right._java_model, max(1, min(1 << 15, a.numRowBlocks)))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, eigenvectors as columns, whether each varies), of the first `most`."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    peak = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(peak < 0, -1.0, 1.0), values > max(values[0], 0.0) * len(covariance) * np.finfo(float).eps


def project(rows: DataFrame, mean: list[float], weights: np.ndarray, n: int, matrix_rows: int) -> DataFrame:
    """idx and z, the centred row times weights, of all rows."""
    spark, (d, k) = rows.sparkSession, weights.shape
    side = MLUtils.convertVectorColumnsFromML(spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(weights)], "index long, w array<double>").select("index", array_to_vector("w").alias("vector")), "vector")
    out = None
    for first, size in slices(n, matrix_rows):
        product = block_matrix(rows, mean, first, size, matrix_rows).multiply(IndexedRowMatrix(side, d, k).toBlockMatrix(min(d, 1024), k))
        part = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        part = part.select((F.col("index") + first).alias("idx"), vector_to_array("vector").alias("z"))
        out = part if out is None else out.unionByName(part)
    return materialize(out, "projected")


def identity_error(z: DataFrame, varies: np.ndarray) -> float:
    """The largest absolute entry of the covariance of z, centred, less the identity; of the components that vary."""
    own = [i for i in range(len(varies)) if varies[i]]
    pairs = [(i, j) for i in own for j in own if i <= j]
    if not pairs:
        return 0.0
    row = z.agg(*[F.covar_pop(F.col("z")[i], F.col("z")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def deviation(n: int, sums: list[int], largest: int) -> Column:
    """The sum of (n * x - S)^2 over the dimensions, exact; in long arithmetic where none can overflow."""
    if len(sums) * (n * largest + max(map(abs, sums))) ** 2 < 1 << 63:
        return F.aggregate(F.zip_with("x", F.lit(sums), lambda x, s: (x * n - s) * (x * n - s)), F.lit(0).cast("long"), lambda a, b: a + b)
    wide = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])

    def squared(x: Column, s: Column) -> Column:
        by = F.try_subtract(F.try_multiply(x.cast("decimal(19,0)"), F.lit(str(n)).cast("decimal(18,0)")).cast("decimal(38,0)"), s)
        near = F.when(F.abs(by) < F.lit("4000000000").cast("decimal(38,0)"), by.cast("decimal(19,0)"))
        return (near * near).cast("decimal(38,0)")

    total = F.aggregate(F.zip_with("x", wide, squared), F.lit("0").cast("decimal(38,0)"), lambda a, b: F.try_add(a, b).cast("decimal(38,0)"))
    return total.try_cast("long")


def whiten(embeddings: DataFrame, *, scale: int = 256, components: int = 4, matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """A row for each vector and component: see RESULT. n is the number of distinct vectors, explained a component's share of the variance."""
    spark, mark = embeddings.sparkSession, made()
    kept = embeddings.where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding"), scale).alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    top = lengths.agg(F.max(F.struct("rows", "d"))["d"]).first()[0]
    if top is None:
        return spark.createDataFrame([], RESULT)
    rows = numbered(kept.where(F.size("x") == top))
    fit = materialize(rows.groupBy("x").agg(F.min("idx").alias("idx")), "fit")
    n, all_ = fit.count(), rows.count()
    totals = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    found = sorted(totals.collect())
    sums, largest = [int(r["s"]) for r in found], max(max(abs(r["hi"]), abs(r["lo"])) for r in found)
    mean = [s / n for s in sums]
    v = sum(scatter(block_matrix(fit, mean, first, size, matrix_rows)) for first, size in slices(all_, matrix_rows)) / n
    values, vectors, varies = components_of(v, min(components, top))
    trace = float(np.trace(v))
    explained = [float(e) / trace if trace > 0 else 0.0 for e in values]
    z = project(rows, mean, np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), 0.0), all_, matrix_rows)
    error = identity_error(z.join(fit.select("idx"), "idx", "left_semi"), varies)
    each = F.zip_with("z", F.lit(explained), lambda w, e: F.struct(w.alias("whitened"), e.alias("explained")))
    out = rows.select("idx", "vec_id", deviation(n, sums, largest).alias("deviation")).join(z, "idx").select("vec_id", "deviation", F.posexplode(each).alias("j", "c"))
    out = out.select("vec_id", (F.col("j") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
    return drop_since(mark, out)
