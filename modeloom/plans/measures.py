"""Catalogue queries of filter banks, short-time spectra, transforms, selections and further generators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from modeloom.operators import decompose as D
from modeloom.operators import features, measures, smoothing, spectra
from modeloom.operators.frames import local
from modeloom.operators.kernels import packets
from modeloom.plans.catalogue import COEFFICIENTS, EVENTS, FEATURES, ORACLES, USERS, WINDOW, query
from modeloom.plans.recovery import scene
from modeloom.sources import generators, signals

# --- correlations and matrices ---

LAGGED = f"y AS (SELECT series_id, t, lag(value, 1, 0.0::DOUBLE) {WINDOW} + t * 0.5::DOUBLE AS value FROM sig)"


def _pair(spark, sf_dir):
    s = signals.users_daily(spark, sf_dir)
    other = local(s, 1, 0, y=lambda w: F.coalesce(F.lag("value").over(w), F.lit(0.0)) + F.col("t") * 0.5)
    return s, other.select("series_id", "t", F.col("y").alias("value"))


def _lags(a: str, b: str, name: str) -> str:
    return f"{name} AS (SELECT p.series_id, p.t - q.t AS lag, SUM(p.value * q.value) / ANY_VALUE(n) AS r FROM {a} p JOIN len USING (series_id) JOIN {b} q ON p.series_id = q.series_id GROUP BY 1, 2)"


for _mode, _a, _b, _c, _d in (("R12", "y", "sig", "sig", "sig"), ("R21", "sig", "y", "y", "y"), ("Rfb", "y", "sig", "sig", "y")):
    query(
        f"paired_correlations_{_mode.lower()}",
        f"WITH {USERS}, {LAGGED}, {_lags(_a, _b, 'f')}, {_lags(_c, _d, 'g')} SELECT f.series_id, f.lag, round(f.r, 6) + 0.0::DOUBLE AS first, round(g.r, 6) + 0.0::DOUBLE AS second FROM f JOIN g USING (series_id, lag)",
    )(lambda s, d, mode=_mode: measures.paired_correlations(*_pair(s, d), mode))
query(
    "paired_correlations_rfb12",
    f"""WITH {USERS}, {LAGGED}, {_lags("y", "sig", "f")}, {_lags("sig", "y", "g")}, {_lags("sig", "sig", "o")}, {_lags("y", "y", "w")}
SELECT f.series_id, f.lag, round(f.r * o.r, 6) + 0.0::DOUBLE AS first, round(g.r * w.r, 6) + 0.0::DOUBLE AS second FROM f JOIN g USING (series_id, lag) JOIN o USING (series_id, lag) JOIN w USING (series_id, lag)""",
)(lambda s, d: measures.paired_correlations(*_pair(s, d), "Rfb12"))

CELLS = f"{USERS}, m AS (SELECT a.series_id, a.t AS row, b.t - a.t AS col, b.value FROM sig a JOIN len USING (series_id) JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 4 WHERE a.t <= n - 5)"


def _cells(spark, sf_dir):
    from modeloom.operators import correlation

    return correlation.lag_matrix(signals.users_daily(spark, sf_dir), 5)


query("diagonal", f"WITH {CELLS} SELECT series_id, row - 2 AS k, round(value, 6) + 0.0::DOUBLE AS value FROM m WHERE row - col = 2")(lambda s, d: measures.diagonal(_cells(s, d), 2))
query("antidiagonal", f"WITH {CELLS} SELECT series_id, row AS k, round(value, 6) + 0.0::DOUBLE AS value FROM m WHERE row - (4 - col) = -1")(lambda s, d: measures.diagonal(_cells(s, d), -1, reverse=True))
query(
    "strongest_cell",
    f"WITH {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, col, row) AS place FROM m) SELECT series_id, row, col, round(value, 6) + 0.0::DOUBLE AS value FROM o WHERE place = 1",
)(lambda s, d: measures.strongest_cell(_cells(s, d)))
query("binary_digits", "SELECT i AS n, CASE WHEN i < 16 THEN concat((i >> 3) & 1, (i >> 2) & 1, (i >> 1) & 1, i & 1) END AS digits FROM range(0, 20) r(i)")(
    lambda s, d: s.range(20).select(F.col("id").alias("n"), F.array_join(measures.binary_digits(F.col("id"), 4), "").alias("digits"))
)

# --- modes ---

PARTS = f"{EVENTS}, p AS (SELECT series_id, t, value, SUM(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS trend FROM sig), modes AS (SELECT series_id, 0 AS mode, t, trend AS value FROM p UNION ALL SELECT series_id, 1, t, value - trend FROM p)"


def _modes(spark, sf_dir):
    parts = smoothing.moving_decomposition(signals.events_hourly(spark, sf_dir), window_size=5)
    return parts.select("series_id", "t", F.posexplode(F.array("trend", "seasonality")).alias("mode", "value"))


query("orthogonality_of_sums", f"WITH {PARTS} SELECT series_id, round(abs(SUM(trend * (value - trend))) / SUM(value * value), 6) + 0.0::DOUBLE AS io FROM p GROUP BY 1")(
    lambda s, d: measures.orthogonality_of_sums(_modes(s, d))
)
query("mean_squared_error", f"WITH {PARTS} SELECT series_id, round(AVG((value - trend) * (value - trend)), 4) + 0.0::DOUBLE AS mse FROM p GROUP BY 1", places=4)(
    lambda s, d: measures.mean_squared_error(signals.events_hourly(s, d), _modes(s, d).where("mode = 0"))
)
MODE_COEFFICIENTS = COEFFICIENTS.replace("FROM sig JOIN", "FROM modes JOIN")
query(
    "mode_amplitude_spectra",
    f"""WITH {PARTS}, c AS (SELECT series_id, mode, k, ANY_VALUE(n) AS n, {MODE_COEFFICIENTS}, 3), a AS (SELECT series_id, mode, k, n, 2 * sqrt(re * re + im * im) / n AS a FROM c),
s AS (SELECT series_id, mode, MIN(a) AS lo, MAX(a) AS hi FROM a GROUP BY 1, 2)
SELECT series_id, CAST(mode AS INTEGER) AS mode, k AS bin, round(k * 24.0::DOUBLE / n, 6) + 0.0::DOUBLE AS freq, round((a - lo) / (hi - lo), 6) + 0.0::DOUBLE AS amplitude FROM a JOIN s USING (series_id, mode)""",
)(lambda s, d: measures.mode_amplitude_spectra(_modes(s, d), 24.0))
query(
    "band_minima",
    f"""WITH {USERS}, e AS (SELECT series_id, t, value, lag(value) {WINDOW} AS a, lead(value) {WINDOW} AS b FROM sig),
tops AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, t) AS rank FROM e WHERE value > a AND value > b),
cuts AS (SELECT series_id, t AS upto, row_number() {WINDOW} - 1 AS k, lag(t, 1, 0) {WINDOW} AS start FROM tops WHERE rank < 4),
near AS (SELECT c.series_id, c.k, e.t, e.value, MIN(e.value) OVER (PARTITION BY c.series_id, c.k) AS least FROM cuts c JOIN e ON e.series_id = c.series_id AND e.t >= c.start AND e.t < c.upto WHERE e.value < e.a AND e.value < e.b),
o AS (SELECT series_id, k, t, row_number() OVER (PARTITION BY series_id, k ORDER BY t) AS place, COUNT(*) OVER (PARTITION BY series_id, k) AS n FROM near WHERE value = least)
SELECT series_id, CAST(k AS INTEGER) AS k, t AS bin FROM o WHERE place = n // 2 + 1""",
)(lambda s, d: measures.band_minima(signals.users_daily(s, d).select("series_id", F.col("t").alias("bin"), "value"), 4))
query(
    "marginal_spectrum",
    ORACLES["hilbert_spectrum"].replace("SELECT series_id, t_bin, f_bin, round(SUM", "SELECT series_id, f_bin, round(SUM").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2").replace(", 6) + 0.0::DOUBLE AS energy", ", 2) + 0.0::DOUBLE AS energy"),
    places=2,
)(lambda s, d: spectra.marginal_spectrum(_hilbert(s, d)))


def _hilbert(spark, sf_dir):
    s = local(signals.events_hourly(spark, sf_dir), 1, 0, inst_freq=lambda w: F.abs(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))) / 5000)
    return spectra.hilbert_spectrum(s.withColumn("inst_amp", F.col("value")), 0.05, 0.5, 0.01, 24)


# --- transforms ---

query(
    "ifft",
    f"""WITH {USERS} SELECT series_id, k AS bin, round(SUM(value * cos(2 * pi() * ((k * t) % n) / n)) / ANY_VALUE(n), 6) + 0.0::DOUBLE AS re, round(SUM(value * sin(2 * pi() * ((k * t) % n) / n)) / ANY_VALUE(n), 6) + 0.0::DOUBLE AS im
FROM sig JOIN len USING (series_id) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY 1, 2""",
)(lambda s, d: D.transform(signals.users_daily(s, d), "ifft"))
GRID = "l AS (SELECT vec_id AS image_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
for _name, _sign, _by in (("fft2d", "-", 1), ("ifft2d", "", 64)):
    query(
        _name,
        f"""WITH {GRID} SELECT image_id, CAST(u // 8 AS INTEGER) AS y, CAST(u % 8 AS INTEGER) AS x, round(SUM(value * cos(2 * pi() * (((i // 8) * (u // 8) + (i % 8) * (u % 8)) % 8) / 8)) / {_by}, 6) + 0.0::DOUBLE AS re,
round({_sign}SUM(value * sin(2 * pi() * (((i // 8) * (u // 8) + (i % 8) * (u % 8)) % 8) / 8)) / {_by}, 6) + 0.0::DOUBLE AS im FROM l CROSS JOIN range(0, 64) r(u) GROUP BY 1, 2, 3, u""",
    )(lambda s, d, inverse=_by > 1: D.transform_images(signals.embedding_images(s, d), inverse))
query("local_frequency", "SELECT 'cos' AS series_id, i AS t, 1.0::DOUBLE AS inst_amp, 0.01::DOUBLE AS inst_freq FROM range(0, 1000) r(i)")(
    lambda s, d: D.local_frequency(generators.generate(s, "cos"))
)


@query("two_tones", "SELECT * FROM (VALUES ('one', 1.0::DOUBLE, 0.1::DOUBLE), ('two', 0.5::DOUBLE, 0.12::DOUBLE)) v(part, amplitude, frequency)", places=2)
def two_tones(spark, sf_dir):
    """The medians, over the middle, of the amplitudes and frequencies that two tones' beat is split into."""
    beat = spark.range(1000).select(F.lit("beat").alias("series_id"), F.col("id").alias("t"), (F.cos(0.2 * math.pi * F.col("id")) + 0.5 * F.cos(0.24 * math.pi * F.col("id"))).alias("value"))
    found = D.two_tones(beat).where("t BETWEEN 100 AND 900").agg(*[F.median(c).alias(c) for c in ("a1", "f1", "a2", "f2")])
    each = F.explode(F.array(F.struct(F.lit("one").alias("part"), F.col("a1").alias("amplitude"), F.col("f1").alias("frequency")), F.struct(F.lit("two").alias("part"), F.col("a2").alias("amplitude"), F.col("f2").alias("frequency"))))
    return found.select(each.alias("r")).select("r.*")


@query("ridges", "SELECT i AS t, round(0.05 + 0.0003::DOUBLE * i, 2) AS freq FROM range(100, 900, 100) r(i)", places=2)
def ridges(spark, sf_dir):
    """A linear chirp's ridge at some samples: its frequency there."""
    chirp = spark.range(1000).select(F.lit("chirp").alias("series_id"), F.col("id").alias("t"), F.cos(2 * math.pi * (0.05 * F.col("id") + 0.00015 * F.col("id") * F.col("id"))).alias("value"))
    return D.ridges(chirp, 512, 64, 5).where("t BETWEEN 100 AND 899 AND t % 100 = 0").select("t", "freq")


query("short_time", "SELECT i AS t, CAST(256 + 51 AS BIGINT) AS bin FROM range(100, 900, 100) r(i)")(
    lambda s, d: D.short_time(generators.generate(s, "cos", frequency=100.0), 512, 64).where("t BETWEEN 100 AND 899 AND t % 100 = 0").groupBy("t").agg(F.max_by("bin", F.col("re") ** 2 + F.col("im") ** 2).alias("bin"))
)
query("phase_crossings", "SELECT i AS k, 8 * i AS t FROM range(0, 125) r(i)")(
    lambda s, d: D.phase_crossings(s.range(1000).select(F.lit("phase").alias("series_id"), F.col("id").alias("t"), (F.col("id") * (2 * math.pi / 7.75)).alias("value"))).select("k", "t")
)

# --- filter banks ---

#: A low-pass under Hamming's window in SQL: l(name, k, taps, h), its taps scaled to one.
PROTOTYPES = """w AS (SELECT name, k, taps, (CASE WHEN 2 * k = taps - 1 THEN cut ELSE sin(pi() * cut * (k - (taps - 1) / 2.0::DOUBLE)) / (pi() * (k - (taps - 1) / 2.0::DOUBLE)) END) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / (taps - 1))) AS h
FROM (VALUES ('half', 17, 0.4::DOUBLE), ('third', 25, 0.8::DOUBLE / 3)) v(name, taps, cut) CROSS JOIN LATERAL (SELECT unnest(range(0, taps)) AS k)),
l AS (SELECT name, k, taps, h / SUM(h) OVER (PARTITION BY name) AS h FROM w),
f AS (SELECT 'h' AS filter, k, h * cos(pi() * k / 4) AS re, h * sin(pi() * k / 4) AS im FROM l WHERE name = 'half'
UNION ALL SELECT 'g', 15 - k, (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * h * cos(pi() * k / 4), (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * h * sin(pi() * k / 4) FROM l WHERE name = 'half' AND k < 16
UNION ALL SELECT concat('h', j), k, h * cos(pi() * k * (2 * j - 1) / 6), h * sin(pi() * k * (2 * j - 1) / 6) FROM l CROSS JOIN range(1, 4) r(j) WHERE name = 'third')"""


@query("analytic_filters", f"WITH {PROTOTYPES} SELECT filter, CAST(k AS BIGINT) AS k, round(re, 6) + 0.0::DOUBLE AS re, round(im, 6) + 0.0::DOUBLE AS im FROM f")
def analytic_filters(spark, sf_dir):
    rows = [(name, k, float(z.real), float(z.imag)) for name, taps in packets.analytic_filters().items() for k, z in enumerate(taps)]
    return spark.createDataFrame(rows, "filter string, k bigint, re double, im double")


for _parts, _filters, _turn in ((2, "('h', 0), ('g', 1)", "CASE WHEN band = 1 AND (t // 2) % 2 = 0 THEN -1 ELSE 1 END"), (3, "('h1', 0), ('h2', 1), ('h3', 2)", "1")):
    query(
        f"split_bands_{_parts}",
        f"""WITH {USERS}, {PROTOTYPES}, b AS (SELECT filter, CAST(band AS INTEGER) AS band, k, re, im FROM f JOIN (VALUES {_filters}) v(filter, band) USING (filter)),
y AS (SELECT s.series_id, b.band, s.t + b.k AS t, SUM(s.value * b.re) AS re, SUM(s.value * b.im) AS im FROM sig s CROSS JOIN b JOIN len USING (series_id) WHERE s.t + b.k < n GROUP BY 1, 2, 3)
SELECT series_id, band, t // {_parts} AS k, round(re * ({_turn}), 6) + 0.0::DOUBLE AS re, round(im * ({_turn}), 6) + 0.0::DOUBLE AS im FROM y WHERE t % {_parts} = {_parts - 1}""",
    )(lambda s, d, parts=_parts: D.split_bands(signals.users_daily(s, d), parts))


@query("kurtogram_peak", "SELECT 'impulses' AS series_id, TRUE AS has_carrier, FALSE AS has_hum, TRUE AS same_kurtosis")
def kurtogram_peak(spark, sf_dir):
    """Bursts of 3,000 Hz over a hum of 200 Hz and noise, at 12,800 Hz: whether the sharpest band has either, and whether its envelope, taken alone, is as sharp."""
    noise = F.sin(F.col("t") * 12.9898) * 43758.5453  # its fraction is spread evenly
    x = scene(spark, "impulses").withColumn("value", F.col("value") + 0.3 * (noise - F.floor(noise) - 0.5))
    bands = D.kurtogram(x, 4, 12800.0).where("level >= 1")
    top = bands.orderBy(F.desc("kurtosis"), "level", "band").limit(1)
    found = top.first()  # one row
    envelope = D.band_envelope(x, found["level"], found["centre"] / 12800)
    z = envelope.where(F.col("k") >= packets.ORDER).groupBy("series_id").agg(F.avg("re").alias("mr"), F.avg("im").alias("mi"))
    power = ((F.col("re") - F.col("mr")) ** 2 + (F.col("im") - F.col("mi")) ** 2).alias("p")
    sharp = envelope.where(F.col("k") >= packets.ORDER).join(z, "series_id").select("series_id", power).groupBy("series_id").agg((F.avg(F.col("p") ** 2) / F.avg("p") ** 2 - 2).alias("own"))
    reach = F.col("width") / 2
    return top.join(sharp, "series_id").select(
        "series_id", (F.abs(F.col("centre") - 3000) <= reach).alias("has_carrier"), (F.abs(F.col("centre") - 200) <= reach).alias("has_hum"), (F.abs(F.col("own") - F.col("kurtosis")) < 1e-6).alias("same_kurtosis")
    )


# --- feature kernels ---

DISTANCE = "pow(list_distance(e.v, q.v), 2)"
for _kernel, _par, _sql in (
    ("polynomial", 2.0, "pow(list_dot_product(e.v, q.v) + 1, 2)"), ("exponential", 2.0, "exp(-list_distance(e.v, q.v) / 8)"), ("laplacian", 2.0, "exp(-list_distance(e.v, q.v) / 2)"), ("cauchy", 2.0, f"1 / (1 + {DISTANCE} / 4)"),
    ("multiquadric", 2.0, f"sqrt({DISTANCE} + 4)"), ("sigmoid", 0.5, "(exp(list_dot_product(e.v, q.v)) - 1) / (exp(list_dot_product(e.v, q.v)) + 1)"),
):
    query(f"kernel_{_kernel}", f"WITH {FEATURES} SELECT e.id, q.id AS other_id, round({_sql}, 6) + 0.0::DOUBLE AS value FROM e CROSS JOIN q", places=None)(
        lambda s, d, kernel=_kernel, par=_par: features.kernel_matrix(signals.embedding_features(s, d), signals.embedding_features(s, d).where(F.col("id") % 20 == 0), kernel, par, places=6)
    )


@query(
    "kernel_rational",
    f"WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e) SELECT e.id, q.id AS other_id, round(1 - {DISTANCE} / ({DISTANCE} + 2), 6) + 0.0::DOUBLE AS value FROM e CROSS JOIN q",
    places=None,
)
def kernel_rational(spark, sf_dir):
    return features.gram_matrix(signals.embedding_features(spark, sf_dir), "rational", 2.0, places=6)


# --- generators ---

_AXIS = "(i % 32) * 10 / 31.0::DOUBLE"
_ROW = "(i // 32) * 10 / 31.0::DOUBLE"
IMAGES = {
    "waves1": f"sin(4 * {_AXIS}) + sin(4 * {_ROW}) + sin({_AXIS}) + sin({_ROW}) + cos({_AXIS} / 24) + cos({_ROW} / 24)",
    "waves2": f"sin({_AXIS}) + sin({_ROW}) + sin(3.5::DOUBLE * {_AXIS}) + sin(3.5::DOUBLE * {_ROW}) + cos({_AXIS} / 16) + cos({_ROW} / 16)",
    "waves3": f"sin({_AXIS} / 24) + sin({_ROW} / 24) + sin({_AXIS} / 5) + sin({_ROW} / 5) + sin({_AXIS}) + sin({_ROW})",
}
query(
    "generate_image_stack",
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT {c} AS channel, i, {f} AS v FROM range(0, 1024) r(i)" for c, f in enumerate(IMAGES.values()))
    + "), m AS (SELECT channel, AVG(v) AS mu, stddev_pop(v) AS sd FROM s GROUP BY 1) SELECT 'stack' AS image_id, CAST(channel AS INTEGER) AS channel, CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x, round((v - mu) / sd, 6) + 0.0::DOUBLE AS value FROM s JOIN m USING (channel)",
)(lambda s, d: generators.image_stack(s, (1, 2, 3), sampling_rate=32))
_C = [f"({e}) * 10 / 15.0::DOUBLE" for e in ("i % 16", "(i // 16) % 16", "i // 256")]
CUBES = [
    " + ".join(f"sin({a}::DOUBLE * {c}) + sin({b}::DOUBLE * {c}) + cos({c} / {d})" for c in _C) for a, b, d in ((3.5, 1, 24), (5, 1, 16), (2, 4, 24))
]
query(
    "generate_cube_stack",
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT {c} AS channel, i, {f} AS v FROM range(0, 4096) r(i)" for c, f in enumerate(CUBES))
    + "), m AS (SELECT channel, AVG(v) AS mu, stddev_pop(v) AS sd FROM s GROUP BY 1) SELECT 'stack' AS vol_id, CAST(channel AS INTEGER) AS channel, CAST(i // 256 AS INTEGER) AS z, CAST((i // 16) % 16 AS INTEGER) AS y, CAST(i % 16 AS INTEGER) AS x, round((v - mu) / sd, 6) + 0.0::DOUBLE AS value FROM s JOIN m USING (channel)",
)(lambda s, d: generators.cube_stack(s, (1, 2, 3), sampling_rate=16))


@query("generate_points", "SELECT CAST(2 AS BIGINT) AS dim, CAST(500 AS BIGINT) AS n, TRUE AS centred, TRUE AS turned")
def generate_points(spark, sf_dir):
    """Rotated Gaussian points: how many, whether their mean is near 0, and whether their two features go together."""
    p = generators.points(spark, 500, 2)
    x, y = F.get("features", F.lit(0)), F.get("features", F.lit(1))
    return p.agg(F.max(F.size("features")).cast("bigint").alias("dim"), F.count("*").alias("n"), (F.abs(F.avg(x)) < 0.2).alias("centred"), (F.abs(F.corr(x, y)) > 0.2).alias("turned"))
