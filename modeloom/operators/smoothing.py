"""Smoothers and moving decompositions of signals (series_id, t, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modeloom.operators.frames import lengths, local, mirrored, shifted
from modeloom.operators.kernels.numeric import savgol_rows


def simple_moving_average(signal: DataFrame, window_size: int = 2) -> DataFrame:
    """Means of ``window_size`` samples; samples beyond the ends count as 0."""
    back, on = window_size // 2, (window_size - 1) // 2
    return local(signal, back, on, smoothed=lambda w: F.sum("value").over(w.rowsBetween(-back, on)) / window_size)


def weighted_moving_average(signal: DataFrame, window_size: int = 2) -> DataFrame:
    """Weights 1 to ``window_size``, the oldest sample's the largest; samples beyond the ends count as 0."""
    on, total = (window_size - 1) // 2, window_size * (window_size + 1) / 2
    terms = {on - k: (k + 1) / total for k in range(window_size)}
    return local(signal, window_size // 2, on, smoothed=lambda w: _weighed(w, terms, zero=True))


def _weighed(w, terms: dict[int, float], zero: bool = False):
    total = F.lit(0.0)
    for by, weight in sorted(terms.items()):
        x = shifted("value", by, w)
        total = total + (F.coalesce(x, F.lit(0.0)) if zero else x) * F.lit(weight)
    return total


def gaussian_weights(sigma: float, truncate: float = 4.0) -> dict[int, float]:
    reach = int(truncate * sigma + 0.5)
    raw = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def gaussian_smoothing(signal: DataFrame, sigma: float = 2) -> DataFrame:
    """A Gaussian filter cut at four sigma; the ends are reflected, end samples repeated."""
    terms = gaussian_weights(sigma)
    reach = max(terms)
    made = local(mirrored(signal, reach), reach, reach, smoothed=lambda w: _weighed(w, terms))
    return made.where((F.col("t") >= 0) & (F.col("t") < F.col("n"))).drop("n")


def savgol_smoothing(signal: DataFrame, window_length: int = 11, poly_order: int = 2) -> DataFrame:
    """Least-squares polynomials over an odd window; at the ends, that of the last whole window."""
    fit, half, reach = savgol_rows(window_length, poly_order), window_length // 2, window_length - 1

    def smoothed(w):
        def reads(row: int):
            return _weighed(w, {j - row: float(fit[row, j]) for j in range(window_length)}, zero=True)

        out = reads(half)
        for i in range(half):
            out = F.when(F.col("t") == i, reads(i)).when(F.col("n") - 1 - F.col("t") == i, reads(reach - i)).otherwise(out)
        return out

    return local(signal.join(lengths(signal), "series_id"), reach, reach, smoothed=smoothed).drop("n")


#: Samples whose weights are followed one by one; slower smoothers carry sums from chunk to chunk of so many.
CARRIED = 256


def exponential_smoothing(signal: DataFrame, alpha: float = 0.4) -> DataFrame:
    """y = alpha x + (1 - alpha) y before it, from the first sample on; alpha 0 keeps the first sample, alpha 1 the signal.

    A quick smoother looks back as far as weights reach 1e-18. A slow one smooths
    chunks from nothing; what the chunks before leave fades by their lengths,
    and is folded over the chunks' ends, which are few.
    """
    if not 0 < alpha < 1:
        first = signal.groupBy("series_id").agg(F.min_by("value", "t").alias("first"))
        return signal.join(first, "series_id").withColumn("smoothed", F.col("first") if alpha <= 0 else F.col("value")).drop("first")
    reach = math.ceil(math.log(1e-18) / math.log(1 - alpha))
    if reach <= CARRIED:
        back = F.collect_list("value")
        return local(
            signal, reach, 0,
            smoothed=lambda w: F.aggregate(
                F.slice(back.over(w.rowsBetween(-reach, 0)), 2, reach),
                F.element_at(back.over(w.rowsBetween(-reach, 0)), 1),
                lambda y, x: x * alpha + y * (1 - alpha),
            ),
        )
    fade = 1 - alpha
    chunk, within = F.floor(F.col("t") / CARRIED), F.col("t") % CARRIED
    weighed = F.col("value") * F.when(F.col("t") == 0, 1.0).otherwise(alpha) * F.pow(F.lit(fade), -within)
    parts = signal.withColumn("chunk", chunk).withColumn("own", F.sum(weighed).over(W.partitionBy("series_id", "chunk").orderBy("t")) * F.pow(F.lit(fade), within))
    ends = parts.groupBy("series_id", "chunk").agg(F.max_by("own", "t").alias("own"))
    before = F.collect_list("own").over(W.partitionBy("series_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.withColumn("carry", F.aggregate(before, F.lit(0.0), lambda y, x: x + y * fade**CARRIED)).drop("own")
    return parts.join(carried, ["series_id", "chunk"]).withColumn("smoothed", F.col("own") + F.col("carry") * F.pow(F.lit(fade), within + 1)).drop("chunk", "own", "carry")


SMOOTHERS = {
    "simple": simple_moving_average,
    "weighted": weighted_moving_average,
    "gaussian": gaussian_smoothing,
    "savgol": savgol_smoothing,
    "exponential": exponential_smoothing,
}


def moving_decomposition(signal: DataFrame, method: str = "simple", **params) -> DataFrame:
    """(series_id, t, value, trend, seasonality): a smoother's trend, and what it leaves."""
    smooth = SMOOTHERS[method](signal, **params).withColumnRenamed("smoothed", "trend")
    return smooth.withColumn("seasonality", F.col("value") - F.col("trend"))
