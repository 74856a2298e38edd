"""Zero crossings, extrema and envelopes of signals (series_id, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modeloom.operators.frames import lengths, local, mirrored, whole


def plateaus(signal: DataFrame) -> DataFrame:
    """Runs of equal values: (series_id, run, first, last, value), with the values of the runs before and after."""
    starts = local(signal, 1, 0, fresh=lambda w: (F.lag("value").over(w) != F.col("value")) | F.lag("value").over(w).isNull()).where("fresh")
    by = W.partitionBy("series_id").orderBy("t")
    ends = lengths(signal)
    return starts.join(ends, "series_id").select(
        "series_id",
        F.col("t").alias("first"),
        (F.coalesce(F.lead("t").over(by), F.col("n")) - 1).alias("last"),
        "value",
        F.lag("value").over(by).alias("before"),
        F.lead("value").over(by).alias("after"),
    )


def middle(first: str = "first", last: str = "last"):
    """A run's middle; halves go to the even neighbour."""
    return F.bround((F.col(first) + F.col(last)) / 2, 0).cast("bigint")


def find_extrema(signal: DataFrame) -> DataFrame:
    """(series_id, t, kind, value): kind is max or min; of a plateau its middle; none at a series' ends."""
    up, down = F.col("value") > F.col("before"), F.col("value") > F.col("after")
    low, rise = F.col("value") < F.col("before"), F.col("value") < F.col("after")
    kind = F.when(up & down, "max").when(low & rise, "min")
    return plateaus(signal).select("series_id", middle().alias("t"), kind.alias("kind"), "value").where(F.col("kind").isNotNull())


def find_zero_crossings(signal: DataFrame) -> DataFrame:
    """(series_id, t): the sample before each change of sign, and the middle of each run of exact zeros."""
    change = local(signal, 0, 1, product=lambda w: F.col("value") * F.lead("value").over(w)).where("product < 0").select("series_id", "t")
    zeros = plateaus(signal).where("value = 0").select("series_id", middle().alias("t"))
    return change.unionByName(zeros)


def parabolic_extrema(signal: DataFrame) -> DataFrame:
    """(series_id, at, kind, value): vertices of parabolas through three samples, after interior samples of flat runs are dropped."""
    runs = plateaus(signal).select("series_id", F.col("first").cast("double").alias("x"), "value")
    by = W.partitionBy("series_id").orderBy("x")
    p = runs.select(
        "series_id", F.lag("x").over(by).alias("x0"), F.col("x").alias("x1"), F.lead("x").over(by).alias("x2"),
        F.lag("value").over(by).alias("y0"), F.col("value").alias("y1"), F.lead("value").over(by).alias("y2"),
    ).where("x0 is not null and x2 is not null and (y1 - y0) * (y2 - y1) < 0")
    # in coordinates of the middle sample: y1 + b u + a u * u
    back, on = F.expr("(y1 - y0) / (x1 - x0)"), F.expr("(y2 - y1) / (x2 - x1)")
    a = (on - back) / F.expr("x2 - x0")
    b = (back * F.expr("x2 - x1") + on * F.expr("x1 - x0")) / F.expr("x2 - x0")
    return p.select("series_id", (F.col("x1") - b / (2 * a)).alias("at"), F.when(a < 0, "max").otherwise("min").alias("kind"), (F.col("y1") - b * b / (4 * a)).alias("value"))


def not_duplicate(signal: DataFrame) -> DataFrame:
    """The samples that don't lie inside a run of equal values."""
    inside = lambda w: F.coalesce((F.lag("value").over(w) == F.col("value")) & (F.lead("value").over(w) == F.col("value")), F.lit(False))
    return local(signal, 1, 1, inside=inside).where("not inside").drop("inside")


def mirror_extend(signal: DataFrame, size: int) -> DataFrame:
    """(series_id, t, value): ``size`` samples reflected at each end, counted from 0 again."""
    return mirrored(signal, size).select("series_id", (F.col("t") + size).alias("t"), "value")


def rolling_envelopes(signal: DataFrame, window_size: int) -> DataFrame:
    """(series_id, t, value, upper, lower): moving maxima and minima of an odd window over reflected ends."""
    half = window_size // 2
    frame = lambda w: w.rowsBetween(-half, half)
    made = local(mirrored(signal, half), half, half, upper=lambda w: F.max("value").over(frame(w)), lower=lambda w: F.min("value").over(frame(w)))
    return made.where((F.col("t") >= 0) & (F.col("t") < F.col("n"))).drop("n")


def filter_sift(signal: DataFrame, window_size: int) -> DataFrame:
    """One sift with order-statistic envelopes: (series_id, t, value, mean, mode).

    Envelopes are moving maxima and minima, smoothed by moving means of the
    same window over reflected ends; the mode is what their mean leaves.
    """
    half = window_size // 2
    env = rolling_envelopes(signal, window_size).withColumn("mid", (F.col("upper") + F.col("lower")) / 2)
    wide = mirrored(env, half)
    made = local(wide, half, half, mean=lambda w: F.sum("mid").over(w.rowsBetween(-half, half)) / window_size)
    kept = made.where((F.col("t") >= 0) & (F.col("t") < F.col("n")))
    return kept.select("series_id", "t", "value", "mean", (F.col("value") - F.col("mean")).alias("mode"))


def knots(signal: DataFrame) -> DataFrame:
    """Extrema and both end samples: (series_id, t, value), in no order."""
    ends = signal.join(lengths(signal), "series_id").where((F.col("t") == 0) | (F.col("t") == F.col("n") - 1))
    return find_extrema(signal).select("series_id", "t", "value").unionByName(ends.select("series_id", "t", "value"))


def itd_baseline(signal: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One baseline of intrinsic time-scale decomposition: (series_id, t, value, baseline, rotation).

    Baseline knots weigh each extremum against the line through its neighbours;
    between knots the baseline follows the signal linearly.
    """
    by = W.partitionBy("series_id").orderBy("t")
    k = knots(signal).select(
        "series_id", "t", "value",
        F.lag("t").over(by).alias("t0"), F.lag("value").over(by).alias("x0"), F.lead("t").over(by).alias("t2"), F.lead("value").over(by).alias("x2"),
    )
    line = F.col("x0") + (F.col("t") - F.col("t0")) / (F.col("t2") - F.col("t0")) * (F.col("x2") - F.col("x0"))
    inner = F.lit(alpha) * line + F.lit(1 - alpha) * F.col("value")
    k = k.select("series_id", F.col("t").alias("kt"), F.col("value").alias("kx"), F.when(F.col("t0").isNull() | F.col("t2").isNull(), F.col("value")).otherwise(inner).alias("kl"))
    nxt = W.partitionBy("series_id").orderBy("kt")
    # the knot at or before each sample, carried forward
    parts = k.select("series_id", "kt", "kx", "kl", F.lead("kt").over(nxt).alias("nt"), F.lead("kx").over(nxt).alias("nx"), F.lead("kl").over(nxt).alias("nl"))
    packed = parts.select("series_id", F.col("kt").alias("t"), F.struct("kx", "kl", "nt", "nx", "nl").alias("k"))
    seen = signal.join(packed, ["series_id", "t"], "left")
    last = seen.withColumn("k", F.last("k", ignorenulls=True).over(whole().rowsBetween(W.unboundedPreceding, 0)))
    span = F.col("k.nx") - F.col("k.kx")
    base = F.when(F.col("k.nt").isNull(), F.col("k.kl")).when(span == 0, F.col("k.kl")).otherwise(F.col("k.kl") + (F.col("k.nl") - F.col("k.kl")) / span * (F.col("value") - F.col("k.kx")))
    return last.select("series_id", "t", "value", base.alias("baseline")).withColumn("rotation", F.col("value") - F.col("baseline"))


def lmd_local_mean(signal: DataFrame) -> DataFrame:
    """(series_id, first, last, mean, amplitude) between consecutive extrema: half their sum and half their distance."""
    by = W.partitionBy("series_id").orderBy("t")
    e = find_extrema(signal).select("series_id", F.col("t").alias("first"), F.lead("t").over(by).alias("last"), "value", F.lead("value").over(by).alias("next"))
    return e.where("last is not null").select(
        "series_id", "first", "last", ((F.col("value") + F.col("next")) / 2).alias("mean"), (F.abs(F.col("value") - F.col("next")) / 2).alias("amplitude")
    )

