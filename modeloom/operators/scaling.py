"""Normalisations and pointwise forms. Per-series statistics are aggregated and joined, never gathered in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modeloom.operators.frames import local, shifted


def _scaled(signal: DataFrame, form: Column, **stats: Column) -> DataFrame:
    per = signal.groupBy("series_id").agg(*[c.alias(k) for k, c in stats.items()])
    return signal.join(per, "series_id").withColumn("scaled", form).drop(*stats)


def max_min_normalization(signal: DataFrame) -> DataFrame:
    lo, hi = F.col("lo"), F.col("hi")
    return _scaled(signal, (F.col("value") - lo) / (hi - lo), lo=F.min("value"), hi=F.max("value"))


def z_score_normalization(signal: DataFrame) -> DataFrame:
    """With the population's deviation."""
    return _scaled(signal, (F.col("value") - F.col("mu")) / F.col("sd"), mu=F.avg("value"), sd=F.stddev_pop("value"))


def max_absolute_normalization(signal: DataFrame) -> DataFrame:
    return _scaled(signal, F.col("value") / F.col("hi"), hi=F.max(F.abs("value")))


def log_transformation(signal: DataFrame) -> DataFrame:
    return signal.withColumn("scaled", F.log1p("value"))


def decimal_scaling_normalization(signal: DataFrame) -> DataFrame:
    return _scaled(signal, F.col("value") / F.pow(F.lit(10.0), F.ceil(F.log10(F.col("hi") + 1))), hi=F.max(F.abs("value")))


def centralize(signal: DataFrame) -> DataFrame:
    return _scaled(signal, F.col("value") - F.col("mu"), mu=F.avg("value"))


def differ(signal: DataFrame, delta: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the ends."""

    def slope(w):
        before, after = shifted("value", -1, w), shifted("value", 1, w)
        wide = (F.coalesce(after, F.col("value")) - F.coalesce(before, F.col("value"))) / delta
        return F.when(before.isNull() | after.isNull(), wide).otherwise(wide / 2)

    return local(signal, 1, 1, derivative=slope)


def soft_threshold(signal: DataFrame, level: float) -> DataFrame:
    return signal.withColumn("shrunk", F.signum("value") * F.greatest(F.abs("value") - level, F.lit(0.0)))


def finite_set_prox(signal: DataFrame, values: tuple[float, ...] = (-1.0, 1.0)) -> DataFrame:
    """The nearest allowed value, the first of equally near ones."""
    pairs = F.array(*[F.struct(F.abs(F.col("value") - v).alias("d"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(values)])
    return signal.withColumn("nearest", F.array_min(pairs)["v"])


def snr(pairs: DataFrame) -> DataFrame:
    """(series_id, snr) from (series_id, clean, estimate): decibels of the clean signal's variance over the error."""
    mu = pairs.groupBy("series_id").agg(F.avg("clean").alias("mu"))
    ratio = F.sum((F.col("clean") - F.col("mu")) ** 2) / F.sum((F.col("clean") - F.col("estimate")) ** 2)
    return pairs.join(mu, "series_id").groupBy("series_id").agg((10 * F.log10(ratio)).alias("snr"))


def rayleigh_inverse(probabilities: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds x, the value that a Rayleigh variable stays below with probability p."""
    return probabilities.withColumn("x", F.lit(scale) * F.sqrt(-2 * F.log(1 - F.col("p"))))


def normalize_time(signal: DataFrame) -> DataFrame:
    """(series_id, time, scaled): times from the first one on, in units of the smallest step."""
    w = W.partitionBy("series_id").orderBy("time")
    steps = signal.select("series_id", "time", (F.lead("time").over(w) - F.col("time")).alias("step"))
    stats = steps.groupBy("series_id").agg(F.min("time").alias("first"), F.min("step").alias("unit"))
    return signal.select("series_id", "time").join(stats, "series_id").select("series_id", "time", ((F.col("time") - F.col("first")) / F.col("unit")).alias("scaled"))
