"""Windows over series that are cut into chunks.

An operator that looks at a bounded neighbourhood needs no whole series in one
task: a series is cut into chunks, and samples near a border go to both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a chunk.
CHUNK = 1 << 16


def whole():
    """A window over a whole series, for what can't be cut into chunks."""
    return W.partitionBy("series_id").orderBy("t")


def halo(signal: DataFrame, before: int, after: int, size: int = CHUNK) -> DataFrame:
    """``signal`` with ``chunk`` and ``core``: every chunk also has ``before`` samples ahead of it and ``after`` behind it."""
    t = F.col("t")

    def at(x: Column) -> Column:
        return F.floor(x / size)

    first, last = F.greatest(at(t - after), F.least(at(t), F.lit(0))), at(t + before)
    return signal.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("core", F.col("chunk") == at(t))


def local(signal: DataFrame, before: int, after: int, size: int = CHUNK, **columns) -> DataFrame:
    """``signal`` with columns made by functions of a window that reaches ``before`` samples back and ``after`` on."""
    w = W.partitionBy("series_id", "chunk").orderBy("t")
    made = halo(signal, before, after, size).withColumns({k: f(w) for k, f in columns.items()})
    return made.where("core").drop("chunk", "core")


def shifted(column: str, by: int, w) -> Column:
    """The value ``by`` samples on (back, if negative)."""
    return F.lead(column, by).over(w) if by > 0 else F.lag(column, -by).over(w) if by < 0 else F.col(column)


def lengths(signal: DataFrame) -> DataFrame:
    """(series_id, n)."""
    return signal.groupBy("series_id").agg(F.count("*").alias("n"))


def mirrored(signal: DataFrame, size: int, whole_sample: bool = False) -> DataFrame:
    """``signal`` with ``n`` and its first and last ``size`` samples reflected beyond its ends.

    The end sample is repeated, unless ``whole_sample``. Series need at least
    ``size`` samples (one more for whole_sample).
    """
    t, n, skip = F.col("t"), F.col("n"), int(whole_sample)
    left = F.when((t < size + skip) & (t >= skip), -1 - t + skip)
    right = F.when((t >= n - size - skip) & (t < n - skip), 2 * n - 1 - t - skip)
    at = F.filter(F.array(t, left, right), lambda x: x.isNotNull())
    return signal.join(lengths(signal), "series_id").withColumn("t", F.explode(at))
