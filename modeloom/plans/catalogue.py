"""Queries over the driver's tables, each with independently written SQL.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.operators import correlation, entropy, extrema, features, images, scaling, smoothing, spectra
from modeloom.sources import generators, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS = """
h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM events GROUP BY 1, 2),
sig AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY hour) - 1 AS BIGINT) AS t, value FROM h),
len AS (SELECT series_id, COUNT(*) AS n FROM sig GROUP BY 1)"""
ORDERS = """
h AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM orders GROUP BY 1, 2),
sig AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS BIGINT) AS t, value FROM h),
len AS (SELECT series_id, COUNT(*) AS n FROM sig GROUP BY 1)"""
USERS = """
h AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS day, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
sig AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS BIGINT) AS t, value FROM h),
len AS (SELECT series_id, COUNT(*) AS n FROM sig GROUP BY 1)"""
WINDOW = "OVER (PARTITION BY series_id ORDER BY t)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, *, places: int | None = 6):
    """Registers a query; ``sql`` is its SQL. Without ``places`` the query rounds by itself."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f if places is None else lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _smooth(name: str, sql: str, **params):
    query(f"smooth_{name}", sql)(lambda s, d: smoothing.SMOOTHERS[name](signals.events_hourly(s, d), **params).select("series_id", "t", "smoothed"))


_smooth("simple", f"WITH {EVENTS} SELECT series_id, t, round(SUM(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) + 0.0::DOUBLE AS smoothed FROM sig", window_size=5)
_smooth(
    "weighted",
    f"""WITH {EVENTS} SELECT a.series_id, a.t, round(SUM(b.value * (CASE WHEN 1 - (b.t - a.t) BETWEEN 0 AND 3 THEN 2 - (b.t - a.t) END) / 10.0::DOUBLE), 6) + 0.0::DOUBLE AS smoothed
FROM sig a JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 2 AND a.t + 1 GROUP BY 1, 2""",
    window_size=4,
)
_smooth(
    "gaussian",
    f"""WITH {EVENTS}, k AS (SELECT CAST(k AS BIGINT) AS k, exp(-k * k / 8.0::DOUBLE) AS g FROM range(-8, 9) r(k)), w AS (SELECT k, g / (SELECT SUM(g) FROM k) AS g FROM k)
SELECT a.series_id, a.t, round(SUM(b.value * w.g), 6) + 0.0::DOUBLE AS smoothed FROM sig a JOIN len USING (series_id) CROSS JOIN w
JOIN sig b ON b.series_id = a.series_id AND b.t = CASE WHEN a.t + w.k < 0 THEN -1 - a.t - w.k WHEN a.t + w.k >= n THEN 2 * n - 1 - a.t - w.k ELSE a.t + w.k END GROUP BY 1, 2""",
    sigma=2,
)
# least squares by the normal equations of a quadratic over eleven samples centred on the window: sums of powers are 11, 110 and 1958
_smooth(
    "savgol",
    f"""WITH {EVENTS}, a AS (SELECT series_id, t, n, least(greatest(t, 5), n - 6) AS c FROM sig JOIN len USING (series_id)),
m AS (SELECT a.series_id, a.t, a.t - a.c AS x, SUM(b.value) AS s0, SUM(b.value * (b.t - a.c)) AS s1, SUM(b.value * (b.t - a.c) * (b.t - a.c)) AS s2
FROM a JOIN sig b ON b.series_id = a.series_id AND b.t BETWEEN a.c - 5 AND a.c + 5 GROUP BY 1, 2, 3)
SELECT series_id, t, round((1958 * s0 - 110 * s2) / (11 * 1958 - 110 * 110)::DOUBLE + x * s1 / 110.0::DOUBLE + x * x * (11 * s2 - 110 * s0) / (11 * 1958 - 110 * 110)::DOUBLE, 6) + 0.0::DOUBLE AS smoothed FROM m""",
    window_length=11,
    poly_order=2,
)
_smooth(
    "exponential",
    f"""WITH RECURSIVE {EVENTS}, y AS (SELECT series_id, t, value AS y FROM sig WHERE t = 0 UNION ALL
SELECT sig.series_id, sig.t, 0.4::DOUBLE * sig.value + 0.6::DOUBLE * y.y FROM y JOIN sig ON sig.series_id = y.series_id AND sig.t = y.t + 1)
SELECT series_id, t, round(y, 6) + 0.0::DOUBLE AS smoothed FROM y""",
    alpha=0.4,
)


@query(
    "moving_decomposition",
    f"""WITH {ORDERS}, m AS (SELECT series_id, t, value, SUM(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS trend FROM sig)
SELECT series_id, t, round(value, 6) + 0.0::DOUBLE AS value, round(trend, 6) + 0.0::DOUBLE AS trend, round(value - trend, 6) + 0.0::DOUBLE AS seasonality FROM m""",
)
def moving_decomposition(spark, sf_dir):
    return smoothing.moving_decomposition(signals.orders_daily(spark, sf_dir), window_size=7).select("series_id", "t", "value", "trend", "seasonality")


def _scale(name: str, expr: str):
    f = getattr(scaling, name)
    sql = f"""WITH {EVENTS}, st AS (SELECT series_id, MIN(value) lo, MAX(value) hi, AVG(value) mu, stddev_pop(value) sd, MAX(abs(value)) top FROM sig GROUP BY 1)
SELECT series_id, t, round({expr}, 6) + 0.0::DOUBLE AS scaled FROM sig JOIN st USING (series_id)"""
    query(name, sql)(lambda s, d: f(signals.events_hourly(s, d)).select("series_id", "t", "scaled"))


_scale("max_min_normalization", "(value - lo) / (hi - lo)")
_scale("z_score_normalization", "(value - mu) / sd")
_scale("max_absolute_normalization", "value / top")
_scale("log_transformation", "ln(1 + value)")
_scale("decimal_scaling_normalization", "value / pow(10, ceil(log10(top + 1)))")
_scale("centralize", "value - mu")


@query(
    "differ",
    f"""WITH {EVENTS}, d AS (SELECT series_id, t, value, lag(value) {WINDOW} AS a, lead(value) {WINDOW} AS b FROM sig)
SELECT series_id, t, round(CASE WHEN a IS NULL THEN (b - value) / 0.5::DOUBLE WHEN b IS NULL THEN (value - a) / 0.5::DOUBLE ELSE (b - a) / 1.0::DOUBLE END, 6) + 0.0::DOUBLE AS derivative FROM d""",
)
def differ(spark, sf_dir):
    return scaling.differ(signals.events_hourly(spark, sf_dir), 0.5).select("series_id", "t", "derivative")


@query("soft_threshold", f"WITH {EVENTS} SELECT series_id, t, round(CASE WHEN abs(value) > 2000 THEN sign(value) * (abs(value) - 2000) ELSE 0 END, 6) + 0.0::DOUBLE AS shrunk FROM sig")
def soft_threshold(spark, sf_dir):
    return scaling.soft_threshold(signals.events_hourly(spark, sf_dir), 2000.0).select("series_id", "t", "shrunk")


@query(
    "finite_set_prox",
    f"WITH {EVENTS}, v AS (SELECT unnest([0.0, 1000.0, 2500.0, 6000.0])::DOUBLE AS v) SELECT series_id, t, round(arg_min(v, abs(value - v) + v * 1e-12), 6) + 0.0::DOUBLE AS nearest FROM sig CROSS JOIN v GROUP BY 1, 2",
)
def finite_set_prox(spark, sf_dir):
    return scaling.finite_set_prox(signals.events_hourly(spark, sf_dir), (0.0, 1000.0, 2500.0, 6000.0)).select("series_id", "t", "nearest")


@query(
    "snr",
    f"""WITH {EVENTS}, s AS (SELECT series_id, t, value, SUM(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM sig), m AS (SELECT series_id, AVG(value) mu FROM sig GROUP BY 1)
SELECT series_id, round(10 * log10(SUM((value - mu) * (value - mu)) / SUM((value - e) * (value - e))), 6) + 0.0::DOUBLE AS snr FROM s JOIN m USING (series_id) GROUP BY 1""",
)
def snr(spark, sf_dir):
    s = smoothing.simple_moving_average(signals.events_hourly(spark, sf_dir), 5)
    return scaling.snr(s.select("series_id", F.col("value").alias("clean"), F.col("smoothed").alias("estimate")))


# runs of equal values by the difference of two row numbers
RUNS = f"""c AS (SELECT series_id, t, value, CASE WHEN value = lag(value) {WINDOW} THEN 0 ELSE 1 END AS f FROM x), g AS (SELECT *, SUM(f) {WINDOW} AS run FROM c),
r AS (SELECT series_id, run, MIN(t) AS first, MAX(t) AS last, ANY_VALUE(value) AS value FROM g GROUP BY 1, 2),
p AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY run) AS a, lead(value) OVER (PARTITION BY series_id ORDER BY run) AS b FROM r)"""
EXTREMA = """e AS (SELECT series_id, CAST(round_even((first + last) / 2.0::DOUBLE, 0) AS BIGINT) AS t, CASE WHEN value > a THEN 'max' ELSE 'min' END AS kind, value FROM p WHERE (value > a AND value > b) OR (value < a AND value < b))"""


@query("find_extrema", f"WITH {USERS}, x AS (SELECT series_id, t, value FROM sig), {RUNS}, {EXTREMA} SELECT series_id, t, kind, round(value, 6) + 0.0::DOUBLE AS value FROM e")
def find_extrema(spark, sf_dir):
    return extrema.find_extrema(signals.users_daily(spark, sf_dir))


@query(
    "find_zero_crossings",
    f"""WITH {USERS}, x AS (SELECT series_id, t, value - 2 AS value FROM sig), {RUNS}, y AS (SELECT series_id, t, value * lead(value) {WINDOW} AS q FROM x)
SELECT series_id, t FROM y WHERE q < 0 UNION ALL SELECT series_id, CAST(round_even((first + last) / 2.0::DOUBLE, 0) AS BIGINT) AS t FROM r WHERE value = 0""",
)
def find_zero_crossings(spark, sf_dir):
    s = signals.users_daily(spark, sf_dir).withColumn("value", F.col("value") - 2)
    return extrema.find_zero_crossings(s)


@query(
    "parabolic_extrema",
    f"""WITH {EVENTS}, d AS (SELECT series_id, t, value AS y1, lag(value) {WINDOW} AS y0, lead(value) {WINDOW} AS y2 FROM sig)
SELECT series_id, round(t + (y0 - y2) / (2 * (y0 - 2 * y1 + y2)), 6) + 0.0::DOUBLE AS at, CASE WHEN y1 > y0 THEN 'max' ELSE 'min' END AS kind,
round(y1 - (y0 - y2) * (y0 - y2) / (8 * (y0 - 2 * y1 + y2)), 6) + 0.0::DOUBLE AS value FROM d WHERE (y1 - y0) * (y2 - y1) < 0""",
    places=6,
)
def parabolic_extrema(spark, sf_dir):
    return extrema.parabolic_extrema(signals.events_hourly(spark, sf_dir))


@query(
    "not_duplicate",
    f"WITH {USERS}, d AS (SELECT series_id, t, value, lag(value) {WINDOW} AS a, lead(value) {WINDOW} AS b FROM sig) SELECT series_id, t, round(value, 6) + 0.0::DOUBLE AS value FROM d WHERE NOT coalesce(a = value AND b = value, false)",
)
def not_duplicate(spark, sf_dir):
    return extrema.not_duplicate(signals.users_daily(spark, sf_dir))


@query(
    "mirror_extend",
    f"""WITH {EVENTS} SELECT series_id, t + 10 AS t, round(value, 6) + 0.0::DOUBLE AS value FROM sig UNION ALL SELECT series_id, 9 - t, round(value, 6) + 0.0::DOUBLE FROM sig WHERE t < 10
UNION ALL SELECT series_id, 2 * n - 1 - t + 10, round(value, 6) + 0.0::DOUBLE FROM sig JOIN len USING (series_id) WHERE t >= n - 10""",
)
def mirror_extend(spark, sf_dir):
    return extrema.mirror_extend(signals.events_hourly(spark, sf_dir), 10)


@query(
    "rolling_envelopes",
    f"""WITH {EVENTS} SELECT series_id, t, round(value, 6) + 0.0::DOUBLE AS value, round(MAX(value) OVER w, 6) + 0.0::DOUBLE AS upper, round(MIN(value) OVER w, 6) + 0.0::DOUBLE AS lower
FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
)
def rolling_envelopes(spark, sf_dir):
    return extrema.rolling_envelopes(signals.events_hourly(spark, sf_dir), 9)


@query(
    "filter_sift",
    f"""WITH {EVENTS}, e AS (SELECT series_id, t, value, (MAX(value) OVER w + MIN(value) OVER w) / 2 AS mid FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
m AS (SELECT a.series_id, a.t, a.value, SUM(b.mid) / 9 AS mean FROM e a JOIN len USING (series_id) CROSS JOIN range(-4, 5) k(k)
JOIN e b ON b.series_id = a.series_id AND b.t = CASE WHEN a.t + k.k < 0 THEN -1 - a.t - k.k WHEN a.t + k.k >= n THEN 2 * n - 1 - a.t - k.k ELSE a.t + k.k END GROUP BY 1, 2, 3)
SELECT series_id, t, round(value, 6) + 0.0::DOUBLE AS value, round(mean, 6) + 0.0::DOUBLE AS mean, round(value - mean, 6) + 0.0::DOUBLE AS mode FROM m""",
)
def filter_sift(spark, sf_dir):
    return extrema.filter_sift(signals.events_hourly(spark, sf_dir), 9)


@query(
    "itd_baseline",
    f"""WITH {EVENTS}, x AS (SELECT series_id, t, value FROM sig), {RUNS}, {EXTREMA},
k AS (SELECT series_id, t, value FROM e UNION ALL SELECT series_id, t, value FROM sig JOIN len USING (series_id) WHERE t = 0 OR t = n - 1),
k2 AS (SELECT *, lag(t) {WINDOW} t0, lag(value) {WINDOW} x0, lead(t) {WINDOW} t2, lead(value) {WINDOW} x2 FROM k),
k3 AS (SELECT series_id, t, value, CASE WHEN t0 IS NULL OR t2 IS NULL THEN value ELSE 0.5::DOUBLE * (x0 + (t - t0)::DOUBLE / (t2 - t0) * (x2 - x0)) + 0.5::DOUBLE * value END AS l FROM k2),
k4 AS (SELECT *, lead(t) {WINDOW} nt, lead(value) {WINDOW} nx, lead(l) {WINDOW} nl FROM k3),
b AS (SELECT s.series_id, s.t, s.value, CASE WHEN nt IS NULL OR nx = k.value THEN l ELSE l + (nl - l) / (nx - k.value) * (s.value - k.value) END AS baseline
FROM sig s JOIN k4 k ON s.series_id = k.series_id AND s.t >= k.t AND (s.t < k.nt OR k.nt IS NULL))
SELECT series_id, t, round(value, 6) + 0.0::DOUBLE AS value, round(baseline, 6) + 0.0::DOUBLE AS baseline, round(value - baseline, 6) + 0.0::DOUBLE AS rotation FROM b""",
)
def itd_baseline(spark, sf_dir):
    return extrema.itd_baseline(signals.events_hourly(spark, sf_dir))


@query(
    "lmd_local_mean",
    f"""WITH {EVENTS}, x AS (SELECT series_id, t, value FROM sig), {RUNS}, {EXTREMA}, q AS (SELECT series_id, t AS first, lead(t) {WINDOW} AS last, value, lead(value) {WINDOW} AS nx FROM e)
SELECT series_id, first, last, round((value + nx) / 2, 6) + 0.0::DOUBLE AS mean, round(abs(value - nx) / 2, 6) + 0.0::DOUBLE AS amplitude FROM q WHERE last IS NOT NULL""",
)
def lmd_local_mean(spark, sf_dir):
    return extrema.lmd_local_mean(signals.events_hourly(spark, sf_dir))


@query(
    "autocorrelation",
    f"""WITH {EVENTS}, m AS (SELECT series_id, AVG(value) mu, var_pop(value) v, COUNT(*) n FROM sig GROUP BY 1)
SELECT a.series_id, b.t - a.t AS lag, round(SUM((a.value - mu) * (b.value - mu)) / ANY_VALUE(v) / (ANY_VALUE(n) - (b.t - a.t)), 6) + 0.0::DOUBLE AS r
FROM sig a JOIN m USING (series_id) JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + n // 2 GROUP BY 1, 2""",
)
def autocorrelation(spark, sf_dir):
    return correlation.autocorrelation(signals.events_hourly(spark, sf_dir))


PAIR = "y AS (SELECT series_id, t, lag(value, 1, 0.0::DOUBLE) OVER (PARTITION BY series_id ORDER BY t) + t * 0.5::DOUBLE AS value FROM sig)"


def _pair(spark, sf_dir):
    from modeloom.operators.frames import local

    s = signals.events_hourly(spark, sf_dir)
    other = local(s, 1, 0, y=lambda w: F.coalesce(F.lag("value").over(w), F.lit(0.0)) + F.col("t") * 0.5)
    return s, other.select("series_id", "t", F.col("y").alias("value"))


@query("pearson", f"WITH {EVENTS}, {PAIR} SELECT series_id, round(corr(s.value, y.value), 6) + 0.0::DOUBLE AS r FROM sig s JOIN y USING (series_id, t) GROUP BY 1")
def pearson(spark, sf_dir):
    return correlation.pearson(*_pair(spark, sf_dir))


@query(
    "cross_correlation",
    f"""WITH {EVENTS}, {PAIR} SELECT s.series_id, s.t - y.t AS lag, round(SUM(s.value * y.value) / ANY_VALUE(n), 1) + 0.0::DOUBLE AS r
FROM sig s JOIN len USING (series_id) JOIN y ON y.series_id = s.series_id GROUP BY 1, 2""",
    places=1,
)
def cross_correlation(spark, sf_dir):
    return correlation.cross_correlation(*_pair(spark, sf_dir))


@query("lag_matrix", f"WITH {USERS} SELECT a.series_id, a.t AS row, b.t - a.t AS col, round(b.value, 6) + 0.0::DOUBLE AS value FROM sig a JOIN len USING (series_id) JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 4 WHERE a.t <= n - 5")
def lag_matrix(spark, sf_dir):
    return correlation.lag_matrix(signals.users_daily(spark, sf_dir), 5)


LAGGED = "l AS (SELECT a.series_id, a.t AS row, b.t - a.t AS col, b.value FROM sig a JOIN len USING (series_id) JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 4 WHERE a.t <= n - 5)"


@query("lag_covariance", f"WITH {USERS}, {LAGGED} SELECT a.series_id, a.col AS i, b.col AS j, round(SUM(a.value * b.value), 6) + 0.0::DOUBLE AS value FROM l a JOIN l b USING (series_id, row) GROUP BY 1, 2, 3")
def lag_covariance(spark, sf_dir):
    return correlation.lag_covariance(signals.users_daily(spark, sf_dir), 5)


@query("diagonal_average", f"WITH {USERS}, {LAGGED} SELECT series_id, row + col AS d, round(AVG(value * (col + 1)), 6) + 0.0::DOUBLE AS value FROM l GROUP BY 1, 2")
def diagonal_average(spark, sf_dir):
    m = correlation.lag_matrix(signals.users_daily(spark, sf_dir), 5)
    return correlation.diagonal_average(m.withColumn("value", F.col("value") * (F.col("col") + 1)))


@query(
    "correlated_kurtosis",
    f"""WITH {EVENTS}, c AS (SELECT series_id, value / 1000 AS v, coalesce(lag(value, 24) {WINDOW}, 0) / 1000 AS a, coalesce(lag(value, 48) {WINDOW}, 0) / 1000 AS b FROM sig)
SELECT series_id, round(SUM((v * a * b) * (v * a * b)) / pow(SUM(v * v), 3) * 1e6, 6) + 0.0::DOUBLE AS ck FROM c GROUP BY 1""",
)
def correlated_kurtosis(spark, sf_dir):
    s = signals.events_hourly(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    return correlation.correlated_kurtosis(s, 24).withColumn("ck", F.col("ck") * 1e6)


def _pe(source: str) -> str:
    return f"""pat AS (SELECT series_id, scale, CASE WHEN c IS NULL THEN NULL WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102'
WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS p FROM (SELECT series_id, scale, value AS a, lead(value, 1) OVER q AS b, lead(value, 2) OVER q AS c FROM {source} WINDOW q AS (PARTITION BY series_id, scale ORDER BY t))),
cnt AS (SELECT series_id, scale, p, COUNT(*) AS c FROM pat WHERE p IS NOT NULL GROUP BY 1, 2, 3), tot AS (SELECT series_id, scale, SUM(c) AS n FROM cnt GROUP BY 1, 2)"""


@query("permutation_entropy", f"WITH {EVENTS}, src AS (SELECT *, 1 AS scale FROM sig), {_pe('src')} SELECT series_id, round(-SUM(c / n::DOUBLE * ln(c / n::DOUBLE)), 6) + 0.0::DOUBLE AS entropy FROM cnt JOIN tot USING (series_id, scale) GROUP BY 1")
def permutation_entropy(spark, sf_dir):
    return entropy.permutation_entropy(signals.events_hourly(spark, sf_dir), 3)


@query("coarse_grain", f"WITH {EVENTS} SELECT series_id, t // 4 AS t, round(AVG(value), 6) + 0.0::DOUBLE AS value FROM sig GROUP BY 1, 2 HAVING COUNT(*) = 4")
def coarse_grain(spark, sf_dir):
    return entropy.coarse_grain(signals.events_hourly(spark, sf_dir), 4)


@query(
    "multiscale_permutation_entropy",
    f"""WITH {EVENTS}, src AS (SELECT series_id, s AS scale, t // s AS t, AVG(value) AS value FROM sig CROSS JOIN range(1, 5) r(s) GROUP BY series_id, s, t // s HAVING COUNT(*) = s), {_pe('src')}
SELECT series_id, scale, round(-SUM(c / n::DOUBLE * ln(c / n::DOUBLE)), 6) + 0.0::DOUBLE AS entropy FROM cnt JOIN tot USING (series_id, scale) GROUP BY 1, 2""",
)
def multiscale_permutation_entropy(spark, sf_dir):
    return entropy.multiscale_permutation_entropy(signals.events_hourly(spark, sf_dir), 3, 1, 4).select("series_id", "scale", "entropy")


@query(
    "sample_entropy",
    f"""WITH {EVENTS}, e AS (SELECT series_id, t, value AS a, lead(value, 1) {WINDOW} AS b, lead(value, 2) {WINDOW} AS c FROM sig), st AS (SELECT series_id, 0.2::DOUBLE * stddev_pop(value) AS r, COUNT(*) AS n FROM sig GROUP BY 1),
m AS (SELECT p.series_id, SUM(CASE WHEN greatest(abs(p.a - q.a), abs(p.b - q.b)) <= r THEN 1 ELSE 0 END) AS b, SUM(CASE WHEN p.c IS NOT NULL AND q.c IS NOT NULL AND greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) <= r THEN 1 ELSE 0 END) AS a
FROM e p JOIN e q ON p.series_id = q.series_id AND p.t < q.t JOIN st ON st.series_id = p.series_id WHERE p.b IS NOT NULL AND q.b IS NOT NULL GROUP BY 1)
SELECT series_id, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b::DOUBLE * (n - 1) / (n - 3)::DOUBLE) ELSE -ln(2.0::DOUBLE / ((n - 3) * (n - 2))) END, 6) + 0.0::DOUBLE AS entropy FROM m JOIN st USING (series_id)""",
)
def sample_entropy(spark, sf_dir):
    return entropy.sample_entropy(signals.events_hourly(spark, sf_dir), 2, 0.2)


@query("kurtosis", f"WITH {EVENTS} SELECT series_id, round(AVG(pow(abs(value), 4)) / pow(AVG(value * value), 2) - 3, 6) + 0.0::DOUBLE AS kurt FROM sig GROUP BY 1")
def kurtosis(spark, sf_dir):
    return entropy.kurtosis(signals.events_hourly(spark, sf_dir))


@query(
    "gini",
    f"""WITH {EVENTS}, k AS (SELECT series_id, abs(value) AS x, row_number() OVER (PARTITION BY series_id ORDER BY abs(value)) AS k FROM sig), s AS (SELECT series_id, SUM(abs(value)) AS total, COUNT(*) AS n FROM sig GROUP BY 1)
SELECT series_id, round(1 - 2 * SUM(x / total * (n - k + 0.5::DOUBLE) / n), 6) + 0.0::DOUBLE AS gini FROM k JOIN s USING (series_id) GROUP BY 1""",
)
def gini(spark, sf_dir):
    return entropy.gini(signals.events_hourly(spark, sf_dir))


@query("pq_mean", f"WITH {EVENTS} SELECT series_id, round(sqrt(AVG(value * value)) / AVG(abs(value)), 6) + 0.0::DOUBLE AS ratio FROM sig GROUP BY 1")
def pq_mean(spark, sf_dir):
    return entropy.pq_mean(signals.events_hourly(spark, sf_dir))


@query("renyi_entropy", f"WITH {EVENTS}, s AS (SELECT series_id, SUM(value) AS total FROM sig GROUP BY 1) SELECT series_id, round(log2(SUM(pow(value / total, 2.5))) / -1.5::DOUBLE, 6) + 0.0::DOUBLE AS entropy FROM sig JOIN s USING (series_id) GROUP BY 1")
def renyi_entropy(spark, sf_dir):
    return entropy.renyi_entropy(signals.events_hourly(spark, sf_dir))


@query(
    "orthogonality_index",
    f"""WITH {EVENTS}, m AS (SELECT series_id, t, value, SUM(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS trend FROM sig)
SELECT series_id, round(SUM(abs(trend * (value - trend))) / SUM(value * value), 6) + 0.0::DOUBLE AS io FROM m GROUP BY 1""",
)
def orthogonality_index(spark, sf_dir):
    d = smoothing.moving_decomposition(signals.events_hourly(spark, sf_dir), window_size=5)
    modes = d.select("series_id", "t", F.posexplode(F.array("seasonality", "trend")).alias("mode", "value"))
    return entropy.orthogonality_index(modes)


#: Fourier sums of every bin of whole series.
COEFFICIENTS = """SUM(value * cos(2 * pi() * ((k * t) % n) / n)) AS re, -SUM(value * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM sig JOIN len USING (series_id)
CROSS JOIN LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) GROUP BY 1, 2"""


@query(
    "dft",
    f"""WITH {USERS}, c AS (SELECT series_id, k, {COEFFICIENTS}) SELECT series_id, k AS bin, round(re, 6) + 0.0::DOUBLE AS re, round(im, 6) + 0.0::DOUBLE AS im, round(re * re + im * im, 6) + 0.0::DOUBLE AS power FROM c""",
)
def dft(spark, sf_dir):
    return spectra.dft(signals.users_daily(spark, sf_dir))


@query(
    "amplitude_spectrum",
    f"""WITH {EVENTS}, c AS (SELECT series_id, k, ANY_VALUE(n) AS n, {COEFFICIENTS}) SELECT series_id, k AS bin, round(k * 24.0::DOUBLE / n, 6) + 0.0::DOUBLE AS freq, round(2 * sqrt(re * re + im * im) / n, 6) + 0.0::DOUBLE AS amplitude FROM c""",
)
def amplitude_spectrum(spark, sf_dir):
    return spectra.amplitude_spectrum(signals.events_hourly(spark, sf_dir), fs=24.0)


@query(
    "bandpass",
    f"""WITH {USERS}, c AS (SELECT series_id, k, ANY_VALUE(n) AS n, SUM(value * cos(2 * pi() * k * t / n)) AS re, -SUM(value * sin(2 * pi() * k * t / n)) AS im FROM sig JOIN len USING (series_id) CROSS JOIN range(1, 4) r(k) GROUP BY 1, 2)
SELECT s.series_id, s.t, round(2 * SUM(re * cos(2 * pi() * k * s.t / n) - im * sin(2 * pi() * k * s.t / n)) / ANY_VALUE(n), 6) + 0.0::DOUBLE AS value FROM sig s JOIN c USING (series_id) GROUP BY 1, 2""",
)
def bandpass(spark, sf_dir):
    return spectra.bandpass(signals.users_daily(spark, sf_dir), 1, 3)


@query(
    "hilbert_spectrum",
    f"""WITH {EVENTS}, a AS (SELECT series_id, t, value, abs(coalesce(value - lag(value) {WINDOW}, 0)) / 5000 AS f FROM sig), b AS (SELECT series_id, t // 24 AS t_bin, CAST(greatest(round((f - 0.05::DOUBLE) / 0.01::DOUBLE), 0) AS BIGINT) AS f_bin, value FROM a)
SELECT series_id, t_bin, f_bin, round(SUM(value * value), 6) + 0.0::DOUBLE AS energy FROM b WHERE f_bin < 45 GROUP BY 1, 2, 3""",
)
def hilbert_spectrum(spark, sf_dir):
    from modeloom.operators.frames import local

    s = local(signals.events_hourly(spark, sf_dir), 1, 0, inst_freq=lambda w: F.abs(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))) / 5000)
    return spectra.hilbert_spectrum(s.withColumn("inst_amp", F.col("value")), 0.05, 0.5, 0.01, 24)


@query(
    "local_peaks",
    f"""WITH {EVENTS}, c AS (SELECT series_id, k, {COEFFICIENTS}), p AS (SELECT series_id, k AS bin, re * re + im * im AS power FROM c),
q AS (SELECT *, lag(power) OVER (PARTITION BY series_id ORDER BY bin) AS a, lead(power) OVER (PARTITION BY series_id ORDER BY bin) AS b FROM p), z AS (SELECT series_id, bin, power, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, bin) AS rank FROM q WHERE power > a AND power > b)
SELECT series_id, bin, round(power / 1e6, 3) + 0.0::DOUBLE AS power, rank FROM z WHERE rank <= 5""",
    places=3,
)
def local_peaks(spark, sf_dir):
    return spectra.local_peaks(spectra.dft(signals.events_hourly(spark, sf_dir)), 5).withColumn("power", F.col("power") / 1e6)


@query(
    "fftshift",
    f"WITH {USERS} SELECT series_id, (t + n // 2) % n AS bin, round(value, 6) + 0.0::DOUBLE AS power FROM sig JOIN len USING (series_id)",
)
def fftshift(spark, sf_dir):
    s = signals.users_daily(spark, sf_dir).select("series_id", F.col("t").alias("bin"), F.col("value").alias("power"))
    return spectra.fftshift(s).select("series_id", "bin", "power")


FEATURES = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE id % 20 = 0)"


def _features(spark, sf_dir):
    rows = signals.embedding_features(spark, sf_dir)
    return rows, rows.where(F.col("id") % 20 == 0)


@query("kernel_linear", f"WITH {FEATURES} SELECT e.id, q.id AS other_id, round(list_dot_product(e.v, q.v), 6) + 0.0::DOUBLE AS value FROM e CROSS JOIN q", places=None)
def kernel_linear(spark, sf_dir):
    return features.kernel_matrix(*_features(spark, sf_dir), places=6)


@query("kernel_rbf", f"WITH {FEATURES} SELECT e.id, q.id AS other_id, round(exp(-pow(list_distance(e.v, q.v), 2) / 2), 6) + 0.0::DOUBLE AS value FROM e CROSS JOIN q", places=None)
def kernel_rbf(spark, sf_dir):
    return features.kernel_matrix(*_features(spark, sf_dir), "rbf", 1.0, places=6)


@query("euclidean_matrix", f"WITH {FEATURES} SELECT e.id, q.id AS other_id, round(pow(list_distance(e.v, q.v), 2), 6) + 0.0::DOUBLE AS value FROM e CROSS JOIN q", places=None)
def euclidean_matrix(spark, sf_dir):
    return features.kernel_matrix(*_features(spark, sf_dir), "euclidean", places=6)


@query(
    "pca_covariance",
    "WITH l AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0.0::DOUBLE AS value FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2",
)
def pca_covariance(spark, sf_dir):
    return features.covariance(signals.embedding_features(spark, sf_dir))


@query("pca")
def pca(spark, sf_dir):
    return features.pca(signals.embedding_features(spark, sf_dir), 3).select("id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query(
    "knn_euclidean",
    f"""WITH {FEATURES}, d AS (SELECT q.id, e.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(e.v, q.v), e.id) AS k FROM q CROSS JOIN e), c AS (SELECT id, label, COUNT(*) AS c FROM d WHERE k <= 7 GROUP BY 1, 2)
SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS r FROM c) WHERE r = 1""",
)
def knn_euclidean(spark, sf_dir):
    rows, some = _features(spark, sf_dir)
    return features.knn_classify(some, rows, 7)


IMAGES = "l AS (SELECT vec_id AS image_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), g AS (SELECT image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, value FROM l)"


def _around(reach: int, what: str) -> str:
    return f"WITH {IMAGES} SELECT a.image_id, a.y, a.x, {what} FROM g a JOIN g b ON a.image_id = b.image_id AND abs(a.y - b.y) <= {reach} AND abs(a.x - b.x) <= {reach} GROUP BY 1, 2, 3"


@query("image_extrema", _around(1, "ANY_VALUE(a.value) >= MAX(b.value) AS is_max, ANY_VALUE(a.value) <= MIN(b.value) AS is_min"))
def image_extrema(spark, sf_dir):
    return images.image_extrema(signals.embedding_images(spark, sf_dir))


@query("local_variance", _around(2, "round(pow(ANY_VALUE(a.value) - AVG(b.value), 2), 6) + 0.0::DOUBLE AS value"))
def local_variance(spark, sf_dir):
    return images.local_variance(signals.embedding_images(spark, sf_dir))


@query("rank_filter", _around(1, "round(MAX(b.value), 6) + 0.0::DOUBLE AS value"))
def rank_filter(spark, sf_dir):
    return images.rank_filter(signals.embedding_images(spark, sf_dir), 3)


SHAPES = {
    "sin": "sin(2 * pi() * 10 * x)", "cos": "cos(2 * pi() * 10 * x)", "am": "(1 + cos(2 * pi() * 5 * x)) * cos(2 * pi() * 100 * x)", "exponential": "exp(-x)",
    "chirp_trend": "cos(22 * pi() * x * x) + 2 * x * x", "two_tones": "cos(2 * pi() * 5 * x) + 0.5 * cos(2 * pi() * 24 * x)",
    "three_tones": "4 / pi() * (sin(2 * pi() * 10 * x) + sin(2 * pi() * 30 * x) / 3 + sin(2 * pi() * (50 * x + 20 * x * x)) / 2)",
    "nested": "3 * pow(2, -x) * sin(sin(2 * pi() * x)) + cos(2 * pi() * 5 * x) + sin(2 * pi() * (x + 2 * x * x)) + sin(2 * pi() * 30 * x)",
    "square": "sign(sin(62.83185307179586::DOUBLE * x))", "sawtooth": "2 * (62.83185307179586::DOUBLE * x / 6.283185307179586::DOUBLE - floor(62.83185307179586::DOUBLE * x / 6.283185307179586::DOUBLE)) - 1",
    "triangle": "2 * abs(1 - 4 * abs((62.83185307179586::DOUBLE * x / 6.283185307179586::DOUBLE - floor(62.83185307179586::DOUBLE * x / 6.283185307179586::DOUBLE)) - 0.5)) - 1",
    "linear_chirp": "cos(2 * pi() * (5 * x + 7.5 * x * x))", "gauss_am_quadratic_fm": "exp(-(x - 3) * (x - 3) / 2) * cos(2 * pi() * (2 * x + 0.8 * x * x)) + cos(2 * pi() * x)",
    "cubic_quadratic": "cos(2 * pi() * (4 * x + 0.1 * x * x * x)) + 0.5 * cos(2 * pi() * (x + 0.2 * x * x))", "nonlinear_chirps": "cos(2 * pi() * (40 * x + 20 * x * x)) + cos(2 * pi() * (120 * x + 10 * sin(2 * pi() * x)))",
}
for _form, _sql in SHAPES.items():
    query(f"generate_{_form}", f"SELECT '{_form}' AS series_id, i AS t, round(i / 1000.0::DOUBLE, 6) + 0.0::DOUBLE AS time, round({_sql.replace('x', '(i / 1000.0::DOUBLE)').replace('e(i / 1000.0::DOUBLE)p', 'exp')}, 6) + 0.0::DOUBLE AS value FROM range(0, 1000) r(i)")(
        lambda s, d, form=_form: generators.generate(s, form)
    )


@query("generate_image", "SELECT 'case1' AS image_id, CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x, round(sin(2 * pi() * 0.2 * (i % 64) * 10 / 63) + cos(2 * pi() * 0.3 * (i // 64) * 10 / 63), 6) + 0.0::DOUBLE AS value FROM range(0, 4096) r(i)")
def generate_image(spark, sf_dir):
    return generators.generate_image(spark, 1, sampling_rate=64)
