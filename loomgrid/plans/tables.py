"""Tables in the folder that driver and executors share: lineage is cut there, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One is set here only where all runs on this machine (tests); a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table of this application. Its folder goes when the driver ends."""
    folder = f"{shared_dir(spark)}/loomgrid/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Lists of the paths that calls which are still building have written, innermost last; each thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("loomgrid_tables", default=())


def made() -> list[str]:
    """A mark: the list of tables that this thread writes until drop_since() closes it."""
    mark: list[str] = []
    _open.set((*_open.get(), mark))
    return mark


def drop_since(mark: list[str], result: DataFrame, *also: DataFrame) -> DataFrame:
    """result, after the tables written under the mark that it doesn't read are gone. Other calls' tables stay, and those that `also` read (as subqueries of the result do)."""
    spark = result.sparkSession
    read = {f.rsplit("/", 2)[-2] for df in (result, *also) for f in df.inputFiles()}
    for path in [p for p in mark if p.rsplit("/", 1)[-1] not in read]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        for held in _open.get():
            if path in held:
                held.remove(path)
    _open.set(tuple(x for x in _open.get() if x is not mark))
    return result


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    for mark in _open.get():
        mark.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by Catalyst's statistics of each; used only to size partitions. An estimate of a join would be a product."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions such that each gets about bytes_each of df's input, and no fewer than the session's own count."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, -(-input_bytes(df) // bytes_each))


def cut(df: DataFrame) -> DataFrame:
    return materialize(df, "cut")
