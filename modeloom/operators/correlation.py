"""Correlations and lag matrices of signals (series_id, t, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.operators.frames import lengths, local, shifted


#: Multiplications up to which products are summed one by one.
DIRECT = 1 << 24


def _step(x: np.ndarray) -> float | None:
    """The largest power of two, 2**-64 at least, of which all samples are whole multiples; None if there is none."""
    mantissa, exponent = np.frexp(x[x != 0])
    whole = np.abs(np.ldexp(mantissa, 53)).astype(np.uint64)
    low = exponent - 53 + np.frexp((whole & (~whole + np.uint64(1))).astype(float))[1] - 1
    least = int(low.min()) if len(low) else 0
    return 2.0**least if least >= -64 else None


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of x[t] y[t - lag] for every lag from 1 - len(y) to len(x) - 1: plain sums, or of long series an FFT.

    Where samples are whole multiples of powers of two (counts, halves) and the FFT
    errs by less than half a step of their products, the sums are moved to that
    step, which makes them exact.
    """
    if len(x) * len(y) <= DIRECT:
        return np.correlate(x, y, "full")
    size = len(x) + len(y) - 1
    sums = np.roll(np.fft.irfft(np.fft.rfft(x, 2 * size) * np.conj(np.fft.rfft(y, 2 * size)), 2 * size), len(y) - 1)[:size]
    if np.isfinite(sums).all() and (a := _step(x)) and (b := _step(y)):
        error = 16 * np.finfo(float).eps * np.log2(2 * size) * np.linalg.norm(x) * np.linalg.norm(y)
        if error < a * b / 2:
            sums = np.round(sums / (a * b)) * (a * b)
    return sums


def lagged_products(left: DataFrame, right: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(series_id, lag, total, overlap): sums of x[t] y[t - lag] for all lags, or for lags up to ``max_lag`` either way.

    With ``max_lag``, the right side is dealt out to its lags, so the join is by
    equality, and sums are formed before the shuffle; all lags are summed series
    by series.
    """
    if max_lag is None:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t", kind="stable")
            x, y = (pdf["value"].to_numpy(float)[pdf["side"] == i] for i in (0, 1))
            if not len(x) or not len(y):
                return pd.DataFrame(columns=["series_id", "lag", "total", "overlap"])
            lag = np.arange(1 - len(y), len(x))
            overlap = np.minimum(len(x), lag + len(y)) - np.maximum(0, lag)
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "lag": lag, "total": _products(x, y), "overlap": overlap})

        sides = [s.select("series_id", "t", "value", F.lit(i).alias("side")) for i, s in enumerate((left, right))]
        return sides[0].unionByName(sides[1]).groupBy("series_id").applyInPandas(run, "series_id string, lag bigint, total double, overlap bigint")
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    moved = right.select("series_id", "t", F.col("value").alias("y"), lags).select("series_id", (F.col("t") + F.col("lag")).alias("t"), "lag", "y")
    return left.join(moved, ["series_id", "t"]).groupBy("series_id", F.col("lag").cast("bigint").alias("lag")).agg(F.sum(F.col("value") * F.col("y")).alias("total"), F.count("*").alias("overlap"))


def cross_correlation(left: DataFrame, right: DataFrame, max_lag: int | None = None, unbias: bool = False) -> DataFrame:
    """(series_id, lag, r): lagged products over the length, or over the overlap if ``unbias``."""
    n = lengths(left)
    by = F.col("overlap") if unbias else F.col("n")
    return lagged_products(left, right, max_lag).join(n, "series_id").select("series_id", "lag", (F.col("total") / by).alias("r"))


def pearson(left: DataFrame, right: DataFrame) -> DataFrame:
    """(series_id, r) of two signals at the same samples."""
    other = right.select("series_id", "t", F.col("value").alias("y"))
    return left.join(other, ["series_id", "t"]).groupBy("series_id").agg(F.corr("value", "y").alias("r"))


def autocorrelation(signal: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(series_id, lag, r) for lags from 0 to ``max_lag``, or to n // 2: mean-removed products over variance and n - lag.

    One window of ``max_lag`` samples gives every product, without a join; lags
    to n // 2 are summed series by series.
    """
    if max_lag is None:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("t", kind="stable")["value"].to_numpy(float)
            n, lag = len(x), np.arange(len(x) // 2 + 1)
            x = x - x.mean()
            var = x.var()
            r = _products(x, x)[n - 1 + lag] / var / (n - lag) if var > 0 else None
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "lag": lag, "r": r})

        return signal.select("series_id", "t", "value").groupBy("series_id").applyInPandas(run, "series_id string, lag bigint, r double")
    stats = signal.groupBy("series_id").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("var"), F.count("*").alias("n"))
    centred = signal.join(stats, "series_id").withColumn("value", F.col("value") - F.col("mu"))
    ahead = local(centred, 0, max_lag, y=lambda w: F.collect_list("value").over(w.rowsBetween(0, max_lag)))
    pairs = ahead.select("series_id", "var", "n", "value", F.posexplode("y").alias("lag", "y"))
    total = pairs.groupBy("series_id", F.col("lag").cast("bigint").alias("lag")).agg(F.sum(F.col("value") * F.col("y")).alias("s"), F.first("var").alias("var"), F.first("n").alias("n"))
    return total.select("series_id", "lag", (F.col("s") / F.col("var") / (F.col("n") - F.col("lag"))).alias("r"))


def trajectory(signal: DataFrame, lags: int) -> DataFrame:
    """(series_id, row, v): each run of ``lags`` samples as an array."""
    made = local(signal, 0, lags - 1, v=lambda w: F.collect_list("value").over(w.rowsBetween(0, lags - 1)))
    return made.where(F.size("v") == lags).select("series_id", F.col("t").alias("row"), "v")


def lag_matrix(signal: DataFrame, lags: int) -> DataFrame:
    """(series_id, row, col, value): the trajectory matrix in long form."""
    return trajectory(signal, lags).select("series_id", "row", F.posexplode("v").alias("col", "value")).withColumn("col", F.col("col").cast("bigint"))


def lag_covariance(signal: DataFrame, lags: int) -> DataFrame:
    """(series_id, i, j, value): products of the trajectory matrix's columns, summed over its rows.

    Columns i and i + m share the products x[t] x[t + m]: a sample makes one row
    for each m, and each i sums those of its own stretch of samples.
    """
    ahead = local(signal, 0, lags - 1, v=lambda w: F.collect_list("value").over(w.rowsBetween(0, lags - 1)))
    each = ahead.join(lengths(signal), "series_id").where(F.col("n") >= lags).select("series_id", "t", "n", "value", F.posexplode("v").alias("m", "y"))
    t, m, last = F.col("t"), F.col("m"), F.col("n") - lags
    product = F.col("value") * F.col("y")
    sums = [F.sum(F.when((t >= i) & (t <= last + i) & (m < lags - i), product)).alias(f"s{i}") for i in range(lags)]
    stretched = each.groupBy("series_id", "m").agg(*sums).select("series_id", "m", F.posexplode(F.array(*[f"s{i}" for i in range(lags)])).alias("i", "value")).where(F.col("value").isNotNull())
    i, j = F.col("i").cast("bigint"), (F.col("i") + F.col("m")).cast("bigint")
    upper = stretched.select("series_id", i.alias("i"), j.alias("j"), "value")
    return upper.unionByName(stretched.where("m > 0").select("series_id", j.alias("i"), i.alias("j"), "value"))


def diagonal_average(matrix: DataFrame, reverse: bool = True) -> DataFrame:
    """(series_id, d, value) from (series_id, row, col, value): means over antidiagonals (row + col), or diagonals (col - row)."""
    d = F.col("row") + F.col("col") if reverse else F.col("col") - F.col("row")
    return matrix.groupBy("series_id", d.alias("d")).agg(F.avg("value").alias("value"))


def correlated_kurtosis(signal: DataFrame, period: int, shifts: int = 2) -> DataFrame:
    """(series_id, ck): sum of squared products of samples whole periods apart, over the energy to the power shifts + 1."""

    def product(w):
        out = F.col("value")
        for m in range(1, shifts + 1):
            out = out * F.coalesce(shifted("value", -m * period, w), F.lit(0.0))
        return out

    made = local(signal, period * shifts, 0, p=product)
    return made.groupBy("series_id").agg((F.sum(F.col("p") ** 2) / F.pow(F.sum(F.col("value") ** 2), F.lit(shifts + 1.0))).alias("ck"))


def convolution(left: DataFrame, kernel: tuple[float, ...]) -> DataFrame:
    """(series_id, t, value): the full convolution of every series with a short kernel, t from 0."""
    taps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(k)).alias("k")) for i, k in enumerate(kernel)]))
    parts = left.select("series_id", "t", "value", taps.alias("tap"))
    return parts.groupBy("series_id", (F.col("t") + F.col("tap.i")).alias("t")).agg(F.sum(F.col("value") * F.col("tap.k")).alias("value"))


def lag_kernel(signal: DataFrame, lags: int, width: float) -> DataFrame:
    """(series_id, i, j, value): Gaussian kernel between the trajectory matrix's columns, doubly centred."""
    inner = lag_covariance(signal, lags)
    own = inner.where("i = j").select("series_id", F.col("i").alias("k"), F.col("value").alias("s"))
    d = (
        inner.join(own.select("series_id", F.col("k").alias("i"), F.col("s").alias("si")), ["series_id", "i"])
        .join(own.select("series_id", F.col("k").alias("j"), F.col("s").alias("sj")), ["series_id", "j"])
        .select("series_id", "i", "j", F.exp(-(F.col("si") + F.col("sj") - 2 * F.col("value")) / (2 * width * width)).alias("k"))
    )
    rows = d.groupBy("series_id", "i").agg(F.avg("k").alias("ri"))
    columns = rows.select("series_id", F.col("i").alias("j"), F.col("ri").alias("rj"))
    whole = d.groupBy("series_id").agg(F.avg("k").alias("m"))
    centred = d.join(rows, ["series_id", "i"]).join(columns, ["series_id", "j"]).join(whole, "series_id")
    return centred.select("series_id", "i", "j", (F.col("k") - F.col("ri") - F.col("rj") + F.col("m")).alias("value"))
