"""Tables that are checked by the pass that writes them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation


class RelationError(ValueError):
    """A table breaks a relation that it must keep."""


def write_checked(df: DataFrame, path: str, kept: Mapping[str, tuple[Column, int | str | None]], derive: Callable[[dict[str, int]], dict[str, int]] | None = None) -> dict[str, int]:
    """Writes df as Parquet and returns the named aggregates of its rows, made while they are written: no second scan.

    kept: name to (aggregate, what it must equal): a number, the name of another aggregate or of one that derive makes of
    them, or None. derive may also name an aggregate itself, which must equal its value then. If one doesn't hold, the table
    is taken away and RelationError tells which.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, (c, _) in kept.items()]).write.option("compression", "zstd").parquet(path)
    found = {n: int(seen.get[n]) for n in kept}
    more = derive(found) if derive else {}
    wrong = []
    for name, (_, want) in kept.items():
        want = {**found, **more}[want] if isinstance(want, str) else want
        want = more.get(name, want)
        if want is not None and found[name] != want:
            wrong.append(f"{name} is {found[name]}, not {want}")
    if wrong:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        raise RelationError("; ".join(wrong))
    return found
