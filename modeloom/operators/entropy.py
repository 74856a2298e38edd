"""Entropies and other scalar features of signals (series_id, t, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modeloom.operators.correlation import trajectory
from modeloom.operators.frames import local, shifted


def ordinal_patterns(signal: DataFrame, m: int, delay: int = 1) -> DataFrame:
    """(series_id, t, pattern): the order of m samples ``delay`` apart; of equal samples the earlier comes first."""

    def pattern(w):
        values = [shifted("value", i * delay, w) for i in range(m)]
        ordered = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)]))
        return F.when(values[-1].isNotNull(), F.array_join(F.transform(ordered, lambda s: s["i"].cast("string")), ""))

    return local(signal, 0, (m - 1) * delay, pattern=pattern).where("pattern is not null")


def permutation_entropy(signal: DataFrame, m: int = 2, delay: int = 1) -> DataFrame:
    """(series_id, entropy): natural-log entropy of the ordinal patterns."""
    counts = ordinal_patterns(signal, m, delay).groupBy("series_id", "pattern").agg(F.count("*").alias("c"))
    total = counts.groupBy("series_id").agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return counts.join(total, "series_id").groupBy("series_id").agg((-F.sum(p * F.log(p))).alias("entropy"))


def coarse_grain(signal: DataFrame, scale: int) -> DataFrame:
    """(series_id, t, value): means of ``scale`` consecutive samples; an incomplete last group goes."""
    grouped = signal.groupBy("series_id", F.floor(F.col("t") / scale).alias("t")).agg(F.avg("value").alias("value"), F.count("*").alias("c"))
    return grouped.where(F.col("c") == scale).drop("c")


def multiscale_permutation_entropy(signal: DataFrame, m: int, delay: int, scale: int) -> DataFrame:
    """(series_id, scale, entropy) for scales from 1."""
    parts = [permutation_entropy(coarse_grain(signal, s) if s > 1 else signal, m, delay).withColumn("scale", F.lit(s).cast("bigint")) for s in range(1, scale + 1)]
    return reduce(DataFrame.unionByName, parts)


def _matches(signal: DataFrame, m: int, radius: DataFrame, strict: bool) -> DataFrame:
    """(series_id, c): pairs of m-sample runs within each series' radius ``r`` in every sample.

    Runs are joined by squares of width r of their first and last samples and
    the eight around, so only runs near in both meet, and a dense series is
    dealt over many keys.
    """
    r = F.col("r")
    runs = trajectory(signal, m).join(radius, "series_id").where("r > 0")
    runs = runs.withColumn("cell", F.floor(F.element_at("v", 1) / r)).withColumn("side", F.floor(F.element_at("v", -1) / r))
    about = F.array(*[F.struct((F.col("cell") + i).alias("cell"), (F.col("side") + j).alias("side")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = runs.select("series_id", F.col("row").alias("row2"), F.col("v").alias("v2"), F.explode(about).alias("at")).select("series_id", "row2", "v2", "at.cell", "at.side")
    far = F.aggregate(F.zip_with("v", "v2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: F.greatest(x, y))
    near = far < r if strict else far <= r
    return runs.join(other, ["series_id", "cell", "side"]).where((F.col("row") < F.col("row2")) & near).groupBy("series_id").agg(F.count("*").alias("c"))


def sample_entropy(signal: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """(series_id, entropy): minus the log of the share of m-sample matches that last another sample; r in population deviations.

    Without matches it is minus the log of 2 / ((n - m - 1) (n - m)).
    """
    radius = signal.groupBy("series_id").agg((F.stddev_pop("value") * r).alias("r"), F.count("*").alias("n"))
    rad = radius.select("series_id", "r")
    b = _matches(signal, m, rad, False).withColumnRenamed("c", "b")
    a = _matches(signal, m + 1, rad, False).withColumnRenamed("c", "a")
    n = F.col("n")
    ratio = F.col("a") / F.col("b") * (n - m + 1) / (n - m - 1)
    plain = F.when((F.coalesce("a", F.lit(0)) > 0) & (F.coalesce("b", F.lit(0)) > 0), -F.log(ratio)).otherwise(-F.log(2 / ((n - m - 1) * (n - m))))
    return radius.join(b, "series_id", "left").join(a, "series_id", "left").select("series_id", plain.alias("entropy"))


def kurtosis(signal: DataFrame) -> DataFrame:
    """(series_id, kurt): fourth absolute moment over the squared second, minus 3."""
    return signal.groupBy("series_id").agg((F.avg(F.pow(F.abs("value"), F.lit(4.0))) / F.pow(F.avg(F.pow("value", F.lit(2.0))), F.lit(2.0)) - 3).alias("kurt"))


def gini(signal: DataFrame) -> DataFrame:
    """(series_id, gini) of absolute values: 1 - 2 sum(x / total * (n - k + 1/2) / n), k their rank from the smallest."""
    ranked = signal.select("series_id", F.abs("value").alias("x")).withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy("x")))
    total = signal.groupBy("series_id").agg(F.sum(F.abs("value")).alias("total"), F.count("*").alias("n"))
    share = F.col("x") / F.col("total") * (F.col("n") - F.col("k") + 0.5) / F.col("n")
    return ranked.join(total, "series_id").groupBy("series_id").agg((1 - 2 * F.sum(share)).alias("gini"))


def pq_mean(signal: DataFrame, p: float = 2.0, q: float = 1.0) -> DataFrame:
    """(series_id, ratio): the p-mean of absolute values over their q-mean."""
    x = F.abs("value")
    return signal.groupBy("series_id").agg((F.pow(F.avg(F.pow(x, F.lit(p))), F.lit(1 / p)) / F.pow(F.avg(F.pow(x, F.lit(q))), F.lit(1 / q))).alias("ratio"))


def renyi_entropy(energy: DataFrame, alpha: float = 2.5) -> DataFrame:
    """(series_id, entropy) of non-negative values as shares of their total, in bits."""
    total = energy.groupBy("series_id").agg(F.sum("value").alias("total"))
    share = F.pow(F.col("value") / F.col("total"), F.lit(alpha))
    return energy.join(total, "series_id").groupBy("series_id").agg((F.log2(F.sum(share)) / (1 - alpha)).alias("entropy"))


def orthogonality_index(modes: DataFrame) -> DataFrame:
    """(series_id, io) from (series_id, mode, t, value): absolute products of different modes over the energy of their sum.

    Per sample, pair products follow from the sums of absolute values and of
    squares, so no mode is joined with another.
    """
    per = modes.groupBy("series_id", "t").agg(F.sum(F.abs("value")).alias("a"), F.sum(F.col("value") ** 2).alias("s"), F.sum("value").alias("x"))
    return per.groupBy("series_id").agg((F.sum((F.col("a") ** 2 - F.col("s")) / 2) / F.sum(F.col("x") ** 2)).alias("io"))


def multiscale_sample_entropy(signal: DataFrame, m: int = 2, r: float = 0.15, tau: int = 1) -> DataFrame:
    """(series_id, entropy, a, b): log of the share of matches, strictly within r sample deviations of the series, of its means over tau samples (the last filled up with zeros)."""
    grouped = signal.groupBy("series_id", F.floor(F.col("t") / tau).alias("t")).agg((F.sum("value") / tau).alias("value"))
    radius = signal.groupBy("series_id").agg((F.stddev_samp("value") * r).alias("r"))
    b = _matches(grouped, m, radius, True).withColumnRenamed("c", "b")
    a = _matches(grouped, m + 1, radius, True).withColumnRenamed("c", "a")
    met = radius.select("series_id").join(b, "series_id", "left").join(a, "series_id", "left").fillna(0, ["a", "b"])
    return met.select("series_id", F.when((F.col("a") > 0) & (F.col("b") > 0), F.log(F.col("b") / F.col("a"))).alias("entropy"), "a", "b")


def segment_sparsity(signal: DataFrame, segments: int = 10, exponent: float = -10.0, p: float = 2.0, q: float = 1.0) -> DataFrame:
    """(series_id, sparsity): the generalised mean, of the given exponent, of the segments' p-means over q-means."""
    n = signal.groupBy("series_id").agg(F.count("*").alias("n"))
    part = F.floor(F.col("t") * segments / F.col("n")).alias("part")
    x = F.abs("value")
    ratio = F.pow(F.avg(F.pow(x, F.lit(p))), F.lit(1 / p)) / F.pow(F.avg(F.pow(x, F.lit(q))), F.lit(1 / q))
    each = signal.join(n, "series_id").groupBy("series_id", part).agg(ratio.alias("r"))
    return each.groupBy("series_id").agg(F.pow(F.avg(F.pow("r", F.lit(exponent))), F.lit(1 / exponent)).alias("sparsity"))
