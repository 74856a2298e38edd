"""Catalogue queries that run decomposition kernels over tables.

Where the modes must sum to the signal, the query returns the sum and SQL the
signal; recovery of known modes is held by the tests. Others return a summary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from modeloom.functions import arrays
from modeloom.operators import correlation, entropy, features, scaling
from modeloom.operators import decompose as D
from modeloom.operators.frames import lengths
from modeloom.plans.catalogue import EVENTS, USERS, WINDOW, query, rounded
from modeloom.sources import generators, signals

#: Decompositions whose rows sum to the signal, with the parameters of their queries.
EXACT = {
    "emd": {"max_imfs": 6}, "ceemdan": {"trials": 8, "max_imfs": 4}, "remd": {"max_imfs": 6}, "esmd": {"max_imfs": 5, "max_sift": 16}, "itd": {}, "lmd": {}, "rlmd": {"max_modes": 5},
    "faemd": {}, "iterative_filtering": {"max_imfs": 8}, "alif": {"max_imfs": 4}, "ewt": {"K": 5}, "efd": {"max_imfs": 5}, "hvd": {"K": 3}, "sst": {"K": 4, "voices": 16}, "swd": {},
    "imd": {}, "stl": {"period": 24}, "mstl": {"periods": (12, 24)}, "osd": {},
    "tvf_emd": {"max_imfs": 4}, "apmd": {"n_modes": 4},
}
#: Decompositions that leave a rest, and their queries' parameters.
PARTIAL = {
    "vmd": {"K": 4}, "ovmd": {"K": 4}, "svmd": {"max_modes": 5}, "stvmd": {"K": 3}, "vme": {"omega": 1 / 24}, "jmd": {"K": 2, "max_iter": 100}, "ssa": {"K": 4, "lags": 48}, "fmd": {"max_iter": 5},
    "acmd": {"K": 2}, "incmd": {"K": 2}, "gdmd": {"K": 2},
    "sjmd": {"max_modes": 3, "max_iter": 60}, "vgnmd": {"max_modes": 2}, "ivgnmd": {"max_modes": 2}, "agncmd": {"max_modes": 2}, "ba_acmd": {"max_modes": 3}, "dd_acmd": {"K": 2}, "stnbmd": {"frequencies": (1 / 24, 1 / 12)}, "vtfmtd": {"omega": (0.04, 0.1, 0.3)},
}
SUM = f"WITH {EVENTS} SELECT series_id, t, round(value, 6) + 0.0::DOUBLE AS value FROM sig"


def _summed(modes):
    return modes.groupBy("series_id", "t").agg(F.sum("value").alias("value"))


for _name, _params in EXACT.items():
    query(f"decompose_{_name}", SUM)(lambda s, d, a=_name, p=_params: _summed(D.decompose(signals.events_hourly(s, d), a, **p)))
for _name, _params in PARTIAL.items():
    query(f"decompose_{_name}")(
        lambda s, d, a=_name, p=_params: D.decompose(signals.events_hourly(s, d), a, **p)
        .groupBy("series_id", "mode", "role")
        .agg(F.count("*").alias("n"), F.avg(F.col("value") ** 2).alias("power"))
    )


def _channels(spark, sf_dir):
    """Three channels of each series: the signal, and it moved by one and by two samples around its end."""
    s = signals.events_hourly(spark, sf_dir)
    s = s.join(lengths(s), "series_id").select("series_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"), "t", "n", "value")
    return s.select("series_id", "channel", ((F.col("t") + F.col("channel")) % F.col("n")).alias("t"), "value")


CHANNELS = f"""WITH {EVENTS} SELECT series_id, CAST(c AS INTEGER) AS channel, (t + c) % n AS t, round(value, 6) + 0.0::DOUBLE AS value
FROM sig JOIN len USING (series_id) CROSS JOIN range(0, 3) r(c)"""
for _name, _params in {"memd": {"n_dir": 16, "max_modes": 4, "max_iter": 10}, "apitmemd": {"n_dir": 16, "max_modes": 3, "max_iter": 8}, "nstemd": {"n_dir": 16, "max_modes": 3, "max_iter": 8}, "semd": {}, "faemd_channels": {}}.items():
    query(f"decompose_{_name}", CHANNELS)(
        lambda s, d, a=_name, p=_params: D.decompose(_channels(s, d), a, **p).groupBy("series_id", "channel", "t").agg(F.sum("value").alias("value"))
    )
for _name, _params in {"mvmd": {"K": 3}, "mjmd": {"K": 2, "max_iter": 50}}.items():
    query(f"decompose_{_name}")(
        lambda s, d, a=_name, p=_params: D.decompose(_channels(s, d), a, **p).groupBy("series_id", "mode", "channel").agg(F.count("*").alias("n"), F.avg(F.col("value") ** 2).alias("power"))
    )


@query("decompose_eemd")
def eemd(spark, sf_dir):
    return D.eemd(signals.events_hourly(spark, sf_dir), trials=8, max_imfs=4).groupBy("series_id", "mode").agg(F.max("trials").alias("trials"), F.avg("deviation").alias("deviation"))


@query("hilbert_huang")
def hilbert_huang(spark, sf_dir):
    return D.hilbert_huang(signals.events_hourly(spark, sf_dir), "emd", 24.0, max_imfs=4).groupBy("series_id", "mode").agg(F.avg("inst_freq").alias("freq"), F.avg("inst_amp").alias("amp"))


@query("decompose_vncmd")
def vncmd(spark, sf_dir):
    x = generators.generate(spark, "two_tones").select("series_id", "t", "value")
    start = generators.generate(spark, "two_tones").select("series_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("mode"), "t").withColumn("init_if", F.when(F.col("mode") == 0, 6.0).otherwise(23.0))
    return D.vncmd(x, start, 1000.0).groupBy("series_id", "mode").agg(F.avg("inst_freq").alias("freq"), F.avg("inst_amp").alias("amp"))


@query("kurtogram")
def kurtogram(spark, sf_dir):
    return D.kurtogram(signals.events_hourly(spark, sf_dir), 4)


@query("dtw")
def dtw(spark, sf_dir):
    rows = signals.embedding_features(spark, sf_dir)
    some = rows.where(F.col("id") % 20 == 0).select(F.col("id").alias("other_id"), F.col("features").alias("y"))
    pairs = rows.select("id", F.col("features").alias("x")).join(F.broadcast(some))
    return D.dtw(pairs, 4)


@query("knn_dtw")
def knn_dtw(spark, sf_dir):
    rows = signals.embedding_features(spark, sf_dir)
    return features.knn_dtw(rows.where(F.col("id") % 20 == 0), rows, 5, 16)


@query("sql_functions")
def sql_functions(spark, sf_dir):
    """The registered SQL functions: a vector's warping distance from its own reverse, and its envelope's peak."""
    arrays.register(spark)
    signals.embedding_features(spark, sf_dir).createOrReplaceTempView("embedding_rows")
    return spark.sql("SELECT id, dtw_distance(features, reverse(features)) AS distance, array_max(hilbert_envelope(features)) AS peak FROM embedding_rows")


IMAGE_SUM = """WITH l AS (SELECT vec_id AS image_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
SELECT image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, round(value, 6) + 0.0::DOUBLE AS value FROM l"""


@query("decompose_ewt2d", IMAGE_SUM)
def ewt2d(spark, sf_dir):
    m = D.decompose_images(signals.embedding_images(spark, sf_dir), "ewt2d", K=2, sigma=0)
    return m.groupBy("image_id", "y", "x").agg(F.sum("value").alias("value"))


for _name, _params in {"emd2d": {}, "faemd2d": {}}.items():
    query(f"decompose_{_name}", IMAGE_SUM)(
        lambda s, d, a=_name, p=_params: D.decompose_images(signals.embedding_images(s, d), a, **p).groupBy("image_id", "y", "x").agg(F.sum("value").alias("value"))
    )
for _name, _params in {"vmd2d": {"K": 2, "max_iter": 50}, "cvmd2d": {"K": 2, "max_iter": 50}}.items():
    query(f"decompose_{_name}")(
        lambda s, d, a=_name, p=_params: D.decompose_images(signals.embedding_images(s, d), a, **p).groupBy("image_id", "mode").agg(F.avg(F.col("value") ** 2).alias("power"))
    )


@query("decompose_bmemd")
def bmemd(spark, sf_dir):
    one = signals.embedding_images(spark, sf_dir)
    stacks = one.select("image_id", F.posexplode(F.array("value", -F.col("value"))).alias("channel", "value"), "y", "x")
    return D.decompose_stacks(stacks, n_dir=4, max_imfs=1, max_iter=2).groupBy("image_id", "channel", "mode").agg(F.avg(F.col("value") ** 2).alias("power"))


@query(
    "decompose_faemd3d",
    """WITH g AS (SELECT i // 100 AS z, (i // 10) % 10 AS y, i % 10 AS x FROM range(0, 1000) r(i)) SELECT 'cube' AS vol_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
round(sin(x * 10 / 9.0::DOUBLE) + cos(y * 10 / 9.0::DOUBLE) * sin(z * 10 / 9.0::DOUBLE), 6) + 0.0::DOUBLE AS value FROM g""",
)
def faemd3d(spark, sf_dir):
    return D.decompose_volumes(generators.generate_cube(spark, sampling_rate=10)).groupBy("vol_id", "z", "y", "x").agg(F.sum("value").alias("value"))


@query(
    "hilbert_transform_real",
    f"WITH {EVENTS} SELECT series_id, t AS bin, round(value, 6) + 0.0::DOUBLE AS re FROM sig",
)
def hilbert_transform_real(spark, sf_dir):
    return D.transform(signals.events_hourly(spark, sf_dir), "hilbert").select("series_id", "bin", "re")


@query(
    "hilbert_transform",
    f"""WITH {USERS}, hk AS (SELECT n, k, CASE WHEN k = 0 OR n % 2 = 0 AND k % 2 = 0 THEN 0 WHEN n % 2 = 0 THEN 2 * cos(pi() * k / n) / sin(pi() * k / n) / n ELSE (cos(pi() * k / n) - cos(pi() * k)) / sin(pi() * k / n) / n END AS h
FROM (SELECT DISTINCT n FROM len) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS k))
SELECT a.series_id, a.t AS bin, round(ANY_VALUE(a.value), 6) + 0.0::DOUBLE AS re, round(SUM(b.value * hk.h), 6) + 0.0::DOUBLE AS im
FROM sig a JOIN len USING (series_id) JOIN sig b ON a.series_id = b.series_id JOIN hk ON hk.n = len.n AND hk.k = (a.t - b.t + len.n) % len.n GROUP BY 1, 2""",
)
def hilbert_transform(spark, sf_dir):
    return D.transform(signals.users_daily(spark, sf_dir), "hilbert")


@query(
    "fft",
    f"""WITH {USERS} SELECT series_id, k AS bin, round(SUM(value * cos(2 * pi() * ((k * t) % n) / n)), 6) + 0.0::DOUBLE AS re, round(-SUM(value * sin(2 * pi() * ((k * t) % n) / n)), 6) + 0.0::DOUBLE AS im
FROM sig JOIN len USING (series_id) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY 1, 2""",
)
def fft(spark, sf_dir):
    return D.transform(signals.users_daily(spark, sf_dir), "fft")


@query("prewhiten")
def prewhiten(spark, sf_dir):
    return D.prewhiten(signals.events_hourly(spark, sf_dir), 20)


@query("algorithms")
def algorithms(spark, sf_dir):
    return D.algorithms(spark)


@query(
    "multiscale_sample_entropy",
    f"""WITH {EVENTS}, g AS (SELECT series_id, t // 2 AS t, SUM(value) / 2 AS value FROM sig GROUP BY 1, 2), e AS (SELECT series_id, t, value AS a, lead(value, 1) {WINDOW} AS b, lead(value, 2) {WINDOW} AS c FROM g),
st AS (SELECT series_id, 0.15::DOUBLE * stddev_samp(value) AS r FROM sig GROUP BY 1),
m AS (SELECT p.series_id, CAST(SUM(CASE WHEN greatest(abs(p.a - q.a), abs(p.b - q.b)) < r THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(SUM(CASE WHEN p.c IS NOT NULL AND q.c IS NOT NULL AND greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) < r THEN 1 ELSE 0 END) AS BIGINT) AS a
FROM e p JOIN e q ON p.series_id = q.series_id AND p.t < q.t JOIN st ON st.series_id = p.series_id WHERE p.b IS NOT NULL AND q.b IS NOT NULL GROUP BY 1)
SELECT series_id, round(CASE WHEN a > 0 AND b > 0 THEN ln(b / a::DOUBLE) END, 6) + 0.0::DOUBLE AS entropy, a, b FROM m""",
)
def multiscale_sample_entropy(spark, sf_dir):
    return entropy.multiscale_sample_entropy(signals.events_hourly(spark, sf_dir), 2, 0.15, 2)


@query(
    "segment_sparsity",
    f"""WITH {EVENTS}, p AS (SELECT series_id, CAST(floor(t * 10 / n::DOUBLE) AS BIGINT) AS part, sqrt(AVG(value * value)) / AVG(abs(value)) AS r FROM sig JOIN len USING (series_id) GROUP BY 1, 2)
SELECT series_id, round(pow(AVG(pow(r, -10)), -0.1), 6) + 0.0::DOUBLE AS sparsity FROM p GROUP BY 1""",
)
def segment_sparsity(spark, sf_dir):
    return entropy.segment_sparsity(signals.events_hourly(spark, sf_dir))


@query(
    "convolution",
    f"WITH {USERS}, k AS (SELECT unnest([0, 1, 2]) AS i, unnest([0.5, -1.0, 0.25])::DOUBLE AS k) SELECT series_id, t + i AS t, round(SUM(value * k), 6) + 0.0::DOUBLE AS value FROM sig CROSS JOIN k GROUP BY 1, 2",
)
def convolution(spark, sf_dir):
    return correlation.convolution(signals.users_daily(spark, sf_dir), (0.5, -1.0, 0.25))


@query(
    "lag_kernel",
    f"""WITH {USERS}, l AS (SELECT a.series_id, a.t AS row, b.t - a.t AS col, b.value FROM sig a JOIN len USING (series_id) JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 3 WHERE a.t <= n - 4),
k AS (SELECT a.series_id, a.col AS i, b.col AS j, exp(-SUM((a.value - b.value) * (a.value - b.value)) / 800.0::DOUBLE) AS k FROM l a JOIN l b USING (series_id, row) GROUP BY 1, 2, 3)
SELECT series_id, i, j, round(k - AVG(k) OVER (PARTITION BY series_id, i) - AVG(k) OVER (PARTITION BY series_id, j) + AVG(k) OVER (PARTITION BY series_id), 6) + 0.0::DOUBLE AS value FROM k""",
)
def lag_kernel(spark, sf_dir):
    return correlation.lag_kernel(signals.users_daily(spark, sf_dir), 4, 20.0)


@query("rayleigh_inverse", "SELECT i / 100.0::DOUBLE AS p, round(2 * sqrt(-2 * ln(1 - i / 100.0::DOUBLE)), 6) + 0.0::DOUBLE AS x FROM range(0, 100) r(i)")
def rayleigh_inverse(spark, sf_dir):
    return scaling.rayleigh_inverse(spark.range(100).select((F.col("id") / 100).alias("p")), 2.0)


@query("normalize_time", "SELECT 'sin' AS series_id, round(i / 1000.0::DOUBLE, 6) + 0.0::DOUBLE AS time, round(i, 6)::DOUBLE + 0.0::DOUBLE AS scaled FROM range(0, 1000) r(i)", places=6)
def normalize_time(spark, sf_dir):
    out = scaling.normalize_time(generators.generate(spark, "sin"))
    return out.withColumn("scaled", F.round("scaled", 3))


query("generate_duffing")(lambda s, d: generators.duffing(s))
query("generate_logistic_am")(lambda s, d: generators.logistic_am(s))
query("generate_seasonal")(lambda s, d: generators.seasonal_series(s))
query("generate_noise")(lambda s, d: generators.add_noise(generators.generate(s, "sin"), 1.0, 0.5))
query(
    "generate_multichannel",
    "SELECT 'channels' AS series_id, CAST(c AS INTEGER) AS channel, i AS t, round(cos(2 * pi() * (CASE c WHEN 0 THEN 2 ELSE 24 END) * i / 1000) + 0.25::DOUBLE * cos(2 * pi() * 36 * i / 1000), 6) + 0.0::DOUBLE AS value FROM range(0, 1000) r(i) CROSS JOIN range(0, 2) s(c)",
)(lambda s, d: generators.multichannel(s))
query(
    "generate_cube",
    """WITH g AS (SELECT i // 900 AS z, (i // 30) % 30 AS y, i % 30 AS x FROM range(0, 27000) r(i)) SELECT 'cube' AS vol_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
round(sin(x * 10 / 29.0::DOUBLE) + cos(y * 10 / 29.0::DOUBLE) * sin(z * 10 / 29.0::DOUBLE), 6) + 0.0::DOUBLE AS value FROM g""",
)(lambda s, d: generators.generate_cube(s))

__all__ = ["EXACT", "PARTIAL", "rounded"]
