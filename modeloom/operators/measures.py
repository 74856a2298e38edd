"""Small measures and selections on modes, matrices (row, col, value) and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modeloom.operators import correlation, spectra


def orthogonality_of_sums(modes: DataFrame) -> DataFrame:
    """(series_id, io) from (series_id, mode, t, value): absolute values of the modes' inner products, each pair once, over the energy of their sum."""
    pair = modes.select("series_id", "t", F.col("mode").alias("other"), F.col("value").alias("y"))
    inner = modes.join(pair, ["series_id", "t"]).where("mode < other").groupBy("series_id", "mode", "other").agg(F.sum(F.col("value") * F.col("y")).alias("p"))
    total = modes.groupBy("series_id", "t").agg(F.sum("value").alias("x")).groupBy("series_id").agg(F.sum(F.col("x") ** 2).alias("e"))
    cross = inner.groupBy("series_id").agg(F.sum(F.abs("p")).alias("p"))
    return total.join(cross, "series_id", "left").select("series_id", (F.coalesce("p", F.lit(0.0)) / F.col("e")).alias("io"))


def mean_squared_error(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("series_id", "t"), group: str = "series_id") -> DataFrame:
    """(group, mse) of two tables' values at the same keys."""
    other = right.select(*keys, F.col("value").alias("of"))
    return left.join(other, list(keys)).groupBy(group).agg(F.avg((F.col("value") - F.col("of")) ** 2).alias("mse"))


def strongest_cell(matrix: DataFrame) -> DataFrame:
    """(series_id, row, col, value): the largest cell; of equal ones the leftmost column's, and there the topmost."""
    best = F.max(F.struct("value", (-F.col("col")).alias("c"), (-F.col("row")).alias("r"))).alias("b")
    return matrix.groupBy("series_id").agg(best).select("series_id", (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.value").alias("value"))


def binary_digits(number: Column, bits: int) -> Column:
    """The ``bits`` binary digits of a number, the highest first; null if it has more or is negative."""
    digits = F.array(*[F.shiftright(number, k).bitwiseAND(F.lit(1)).cast("int") for k in reversed(range(bits))])
    return F.when((number >= 0) & (number < 2**bits), digits)


def diagonal(matrix: DataFrame, index: int = 0, reverse: bool = False) -> DataFrame:
    """(series_id, k, value): the cells with row - col = index, by row; reversed, those of the matrix read from its last column."""
    last = matrix.groupBy("series_id").agg(F.max("col").alias("last"))
    col = F.col("last") - F.col("col") if reverse else F.col("col")
    cells = matrix.join(last, "series_id").where(F.col("row") - col == index)
    return cells.select("series_id", (F.col("row") - max(index, 0)).alias("k"), "value")


def band_minima(curve: DataFrame, bands: int) -> DataFrame:
    """(series_id, k, bin) of the cuts between bands of (series_id, bin, value).

    The ``bands`` - 1 largest inner maxima stand for bands; before each, back to
    the one before it, the lowest inner minimum is a cut (the middle one of
    equal minima). A maximum without a minimum before it has none.
    """
    w = W.partitionBy("series_id").orderBy("bin")
    e = curve.select("series_id", "bin", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"))
    tops = e.where("value > a AND value > b").withColumn("rank", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("value"), "bin"))).where(F.col("rank") < bands)
    tops = tops.withColumn("k", F.row_number().over(w) - 1).withColumn("from", F.coalesce(F.lag("bin").over(w), F.lit(0))).select("series_id", "k", "from", F.col("bin").alias("upto"))
    dips = e.where("value < a AND value < b").select("series_id", "bin", "value")
    near = dips.join(F.broadcast(tops), "series_id").where("bin >= from AND bin < upto")  # bands - 1 rows a series
    low = W.partitionBy("series_id", "k")
    least = near.withColumn("least", F.min("value").over(low)).where("value = least")
    placed = least.withColumn("place", F.row_number().over(low.orderBy("bin"))).withColumn("n", F.count("*").over(low))
    return placed.where("place = floor(n / 2) + 1").select("series_id", "k", "bin")


def paired_correlations(left: DataFrame, right: DataFrame, mode: str = "R12", max_lag: int | None = None) -> DataFrame:
    """(series_id, lag, first, second): two correlations of two real signals.

    R12: the right with the left, the left with itself; R21: the other way
    round; Rfb: right with left, left with right; Rfb12 and Rfb21 multiply those
    by the left's and the right's own, in that order and in turn.
    """

    def r(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return correlation.cross_correlation(a, b, max_lag).withColumnRenamed("r", name)

    if mode in ("R12", "R21"):
        a, b = (left, right) if mode == "R12" else (right, left)
        return r(b, a, "first").join(r(a, a, "second"), ["series_id", "lag"])
    both = r(right, left, "first").join(r(left, right, "second"), ["series_id", "lag"])
    if mode == "Rfb":
        return both
    own = r(left, left, "one").join(r(right, right, "two"), ["series_id", "lag"])
    one, two = ("one", "two") if mode == "Rfb12" else ("two", "one")
    return both.join(own, ["series_id", "lag"]).select("series_id", "lag", (F.col("first") * F.col(one)).alias("first"), (F.col("second") * F.col(two)).alias("second"))


def mode_amplitude_spectra(modes: DataFrame, fs: float = 1.0) -> DataFrame:
    """(series_id, mode, bin, freq, amplitude) of every mode, amplitudes moved to the range 0 to 1 in each mode."""
    named = modes.select(F.concat_ws("\x1f", "series_id", "mode").alias("series_id"), "t", "value")
    s = spectra.amplitude_spectrum(named, fs=fs)
    span = s.groupBy("series_id").agg(F.min("amplitude").alias("lo"), F.max("amplitude").alias("hi"))
    scaled = F.try_divide(F.col("amplitude") - F.col("lo"), F.col("hi") - F.col("lo"))
    parts = F.split("series_id", "\x1f")
    return s.join(span, "series_id").select(parts[0].alias("series_id"), parts[1].cast("int").alias("mode"), "bin", "freq", F.coalesce(scaled, F.lit(0.0)).alias("amplitude"))
