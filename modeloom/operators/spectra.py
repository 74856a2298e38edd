"""Spectra as relations, and Hilbert spectra of modes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.operators.frames import lengths


def dft(signal: DataFrame, bins: int | None = None) -> DataFrame:
    """(series_id, bin, re, im, power) of the discrete Fourier bins 0 to n // 2, by an FFT of each series; or of the first ``bins``, by partial sums: for few bins of long series."""
    if bins is None:
        from modeloom.operators.decompose import transform

        sums = transform(signal, "fft").join(lengths(signal), "series_id").where(F.col("bin") <= F.floor(F.col("n") / 2)).drop("n")
    else:
        at = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
        e = signal.join(lengths(signal), "series_id").select("series_id", "n", "t", "value", at)
        angle = F.lit(2 * math.pi) * ((F.col("bin") * F.col("t")) % F.col("n")) / F.col("n")
        sums = e.groupBy("series_id", F.col("bin").cast("bigint").alias("bin")).agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), (-F.sum(F.col("value") * F.sin(angle))).alias("im"))
    return sums.withColumn("power", F.col("re") ** 2 + F.col("im") ** 2)


def amplitude_spectrum(signal: DataFrame, bins: int | None = None, fs: float = 1.0) -> DataFrame:
    """(series_id, bin, freq, amplitude): single-sided amplitudes, 2 |X| / n, of all bins or the first ``bins``."""
    d = dft(signal, bins).join(lengths(signal), "series_id")
    return d.select("series_id", "bin", (F.col("bin") * fs / F.col("n")).alias("freq"), (2 * F.sqrt("power") / F.col("n")).alias("amplitude"))


def bandpass(signal: DataFrame, first: int, last: int) -> DataFrame:
    """(series_id, t, value): the part of a signal in Fourier bins ``first`` to ``last``, from their coefficients; 1 <= first, last < n / 2."""
    coef = dft(signal, last + 1).where(F.col("bin") >= first)
    packed = coef.groupBy("series_id").agg(F.collect_list(F.struct("bin", "re", "im")).alias("c"))  # last - first + 1 entries
    angle = lambda b: F.lit(2 * math.pi) * ((b * F.col("t")) % F.col("n")) / F.col("n")
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x["re"] * F.cos(angle(x["bin"])) - x["im"] * F.sin(angle(x["bin"])))
    return signal.join(lengths(signal), "series_id").join(packed, "series_id").select("series_id", "t", (2 * total / F.col("n")).alias("value"))


def hilbert_spectrum(attributes: DataFrame, freq_min: float, freq_max: float, resolution: float, time_scale: int = 1) -> DataFrame:
    """(series_id, t_bin, f_bin, energy) from (series_id, mode, t, inst_freq, inst_amp).

    Energy is squared amplitude, summed in bins; frequencies below the range
    count in bin 0, those beyond it go, as do missing ones.
    """
    top = round((freq_max - freq_min) / resolution)
    at = F.greatest(F.round((F.col("inst_freq") - freq_min) / resolution), F.lit(0)).cast("bigint")
    binned = attributes.where(F.col("inst_freq").isNotNull() & ~F.isnan("inst_freq")).select("series_id", F.floor(F.col("t") / time_scale).alias("t_bin"), at.alias("f_bin"), "inst_amp")
    return binned.where(F.col("f_bin") < top).groupBy("series_id", "t_bin", "f_bin").agg(F.sum(F.col("inst_amp") ** 2).alias("energy"))


def marginal_spectrum(spectrum: DataFrame) -> DataFrame:
    """(series_id, f_bin, energy) summed over time."""
    return spectrum.groupBy("series_id", "f_bin").agg(F.sum("energy").alias("energy"))


def fftshift(spectrum: DataFrame, inverse: bool = False) -> DataFrame:
    """Bins (series_id, bin, ...) with the zero frequency moved to the middle, or back."""
    n = spectrum.groupBy("series_id").agg(F.count("*").alias("n"))
    half = F.floor((F.col("n") + int(inverse)) / 2)
    return spectrum.join(n, "series_id").withColumn("bin", (F.col("bin") + half) % F.col("n")).drop("n")


def local_peaks(spectrum: DataFrame, k: int) -> DataFrame:
    """(series_id, bin, power, rank): the k largest inner maxima of each spectrum; of equal ones the lower bin."""
    from pyspark.sql import Window as W

    w = W.partitionBy("series_id").orderBy("bin")
    peaks = spectrum.select("series_id", "bin", "power", F.lag("power").over(w).alias("a"), F.lead("power").over(w).alias("b")).where("power > a and power > b")
    rank = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("power"), "bin"))
    return peaks.select("series_id", "bin", "power", rank.cast("bigint").alias("rank")).where(F.col("rank") <= k)
