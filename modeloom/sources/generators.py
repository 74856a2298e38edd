"""Analytic signals, images and volumes from spark.range: (series_id, t, time, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PI = math.pi


def _chirp(t: Column, f0: float, t1: float, f1: float) -> Column:
    return F.cos(2 * PI * (f0 * t + (f1 - f0) / (2 * t1) * t * t))


def _saw(phase: Column, width: float = 1.0) -> Column:
    """A saw tooth of period 2 pi that rises from -1 to 1 over ``width`` of it."""
    u = phase / (2 * PI) - F.floor(phase / (2 * PI))
    return F.when(u < width, 2 * u / width - 1).otherwise(1 - 2 * (u - width) / (1 - width)) if width < 1 else 2 * u - 1


#: Formulas of time t (seconds); parameters are frequencies in Hz, rates and amplitudes.
FORMS = {
    "sin": lambda t, frequency=10.0: F.sin(2 * PI * frequency * t),
    "cos": lambda t, frequency=10.0: F.cos(2 * PI * frequency * t),
    "square": lambda t, frequency=10.0: F.signum(F.sin(2 * PI * frequency * t)),
    "triangle": lambda t, frequency=10.0: 2 * F.abs(_saw(2 * PI * frequency * t, 0.5)) - 1,
    "sawtooth": lambda t, frequency=10.0: _saw(2 * PI * frequency * t),
    "am": lambda t, carrier=100.0, modulating=5.0, index=1.0: (1 + index * F.cos(2 * PI * modulating * t)) * F.cos(2 * PI * carrier * t),
    "exponential": lambda t, rate=1.0, amplitude=1.0: amplitude * F.exp(-rate * t),
    "chirp_trend": lambda t: F.cos(22 * PI * t * t) + 2 * t * t,
    "three_tones": lambda t: 4 / PI * (F.sin(2 * PI * 10 * t) + F.sin(2 * PI * 30 * t) / 3 + F.sin(2 * PI * (50 * t + 20 * t * t)) / 2),
    "nested": lambda t: 3 * F.pow(F.lit(2.0), -t) * F.sin(F.sin(2 * PI * t)) + F.cos(2 * PI * 5 * t) + F.sin(2 * PI * (t + 2 * t * t)) + F.sin(2 * PI * 30 * t),
    "two_tones": lambda t: F.cos(2 * PI * 5 * t) + 0.5 * F.cos(2 * PI * 24 * t),
    "gauss_am_quadratic_fm": lambda t: F.exp(-((t - 3) ** 2) / 2) * F.cos(2 * PI * (2 * t + 0.8 * t * t)) + F.cos(2 * PI * t),
    "cubic_quadratic": lambda t: F.cos(2 * PI * (4 * t + 0.1 * t**3)) + 0.5 * F.cos(2 * PI * (t + 0.2 * t * t)),
    "nonlinear_chirps": lambda t: F.cos(2 * PI * (40 * t + 20 * t * t)) + F.cos(2 * PI * (120 * t + 10 * F.sin(2 * PI * t))),
    "linear_chirp": lambda t, f0=5.0, t1=1.0, f1=20.0: _chirp(t, f0, t1, f1),
}


def generate(spark: SparkSession, form: str, duration: float = 1.0, sampling_rate: int = 1000, noise_level: float = 0.0, seed: int = 42, **params: float) -> DataFrame:
    """A signal of the named form, one sample each 1 / sampling_rate seconds; noise is Gaussian, by seed and partition."""
    n = int(duration * sampling_rate)
    time = F.col("id") / sampling_rate
    value = FORMS[form](time, **params)
    value = value + noise_level * F.randn(seed) if noise_level else value
    return spark.range(n).select(F.lit(form).alias("series_id"), F.col("id").alias("t"), time.alias("time"), value.cast("double").alias("value"))


IMAGE_FORMS = {
    1: lambda x, y: F.sin(2 * PI * 0.2 * x) + F.cos(2 * PI * 0.3 * y),
    2: lambda x, y: F.sin(x) * F.cos(y),
    3: lambda x, y: F.sin(x * x / 10) + y / 10,
}


def generate_image(spark: SparkSession, case: int = 1, low: float = 0.0, high: float = 10.0, sampling_rate: int = 256) -> DataFrame:
    """(image_id, y, x, value) on a square grid that includes both ends."""
    step = (high - low) / (sampling_rate - 1)
    cells = spark.range(sampling_rate * sampling_rate)
    y, x = F.floor(F.col("id") / sampling_rate), F.col("id") % sampling_rate
    return cells.select(F.lit(f"case{case}").alias("image_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), IMAGE_FORMS[case](low + x * step, low + y * step).alias("value"))


def generate_cube(spark: SparkSession, low: float = 0.0, high: float = 10.0, sampling_rate: int = 30) -> DataFrame:
    """(vol_id, z, y, x, value): a product of sines on a cube's grid."""
    n, step = sampling_rate, (high - low) / (sampling_rate - 1)
    z, y, x = F.floor(F.col("id") / (n * n)), F.floor(F.col("id") / n) % n, F.col("id") % n
    value = F.sin(low + x * step) + F.cos(low + y * step) * F.sin(low + z * step)
    return spark.range(n**3).select(F.lit("cube").alias("vol_id"), z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), value.alias("value"))


def _recurrence(spark: SparkSession, name: str, duration: float, sampling_rate: int, step) -> DataFrame:
    """A signal whose samples follow from those before, made by one task."""
    import pandas as pd

    n = int(duration * sampling_rate)

    def run(frames):
        for _ in frames:
            values = step(n, 1 / sampling_rate)
            yield pd.DataFrame({"series_id": name, "t": range(n), "time": [k / sampling_rate for k in range(n)], "value": values})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "series_id string, t bigint, time double, value double")


def duffing(spark: SparkSession, duration: float = 6.0, sampling_rate: int = 128, damping: float = 0.2, force: float = 0.3, rate: float = 1.0) -> DataFrame:
    """A Duffing oscillator, x'' + damping x' - x + x^3 = force cos(rate t), by fourth-order Runge-Kutta steps."""

    def step(n: int, dt: float) -> list[float]:
        def slope(t, x, v):
            return v, force * math.cos(rate * t) - damping * v + x - x**3

        x, v, out = 1.0, 0.0, []
        for k in range(n):
            out.append(x)
            t = k * dt
            a = slope(t, x, v)
            b = slope(t + dt / 2, x + dt / 2 * a[0], v + dt / 2 * a[1])
            c = slope(t + dt / 2, x + dt / 2 * b[0], v + dt / 2 * b[1])
            d = slope(t + dt, x + dt * c[0], v + dt * c[1])
            x += dt / 6 * (a[0] + 2 * b[0] + 2 * c[0] + d[0])
            v += dt / 6 * (a[1] + 2 * b[1] + 2 * c[1] + d[1])
        return out

    return _recurrence(spark, "duffing", duration, sampling_rate, step)


def logistic_am(spark: SparkSession, duration: float = 6.0, sampling_rate: int = 128, growth: float = 3.9, carrier: float = 8.0) -> DataFrame:
    """A carrier whose amplitude follows a logistic map, smoothed by a moving mean of eight samples."""

    def step(n: int, dt: float) -> list[float]:
        x, amps = 0.3, []
        for _ in range(n + 8):
            x = growth * x * (1 - x)
            amps.append(x)
        return [(1 + sum(amps[k : k + 8]) / 8) * math.cos(2 * PI * carrier * k * dt) for k in range(n)]

    return _recurrence(spark, "logistic_am", duration, sampling_rate, step)


def add_noise(signal: DataFrame, mean: float = 0.0, deviation: float = 1.0, seed: int = 42) -> DataFrame:
    """``signal`` with Gaussian noise on its values."""
    return signal.withColumn("value", F.col("value") + mean + deviation * F.randn(seed))


def seasonal_series(spark: SparkSession, length: int = 300, periods: tuple[int, ...] = (10, 30, 50), harmonics: tuple[int, ...] = (3, 2, 2), seed: int = 42) -> DataFrame:
    """A trend and harmonics of each period with amplitudes that fall with their order, and noise."""
    t = F.col("id")
    value = 0.01 * t
    for p, k in zip(periods, harmonics, strict=True):
        for h in range(1, k + 1):
            value = value + F.sin(2 * PI * h * t / p + h) / h
    return spark.range(length).select(F.lit("seasonal").alias("series_id"), t.alias("t"), (value + 0.1 * F.randn(seed)).alias("value"))


def multichannel(spark: SparkSession, duration: float = 1.0, sampling_rate: int = 1000) -> DataFrame:
    """(series_id, channel, t, value): two channels that share a tone of 36 Hz, beside tones of 2 and 24 Hz."""
    time = F.col("id") / sampling_rate
    shared = 0.25 * F.cos(2 * PI * 36 * time)
    forms = F.array(F.cos(2 * PI * 2 * time) + shared, F.cos(2 * PI * 24 * time) + shared)
    return spark.range(int(duration * sampling_rate)).select(F.lit("channels").alias("series_id"), F.col("id").alias("t"), F.posexplode(forms).alias("channel", "value")).select("series_id", "channel", "t", "value")


#: Sums of waves along the axes: (first rate, second rate, third rate, whether the third is a cosine).
WAVES = {
    1: (4.0, 1.0, 1 / 24, True), 2: (1.0, 3.5, 1 / 16, True), 3: (1 / 24, 1 / 5, 1.0, False), 4: (1 / 60, 1 / 16, 1 / 32, False), 5: (8.0, 16.0, 1 / 32, False), 6: (2.0, 6.0, 1 / 12, True), 7: (3.0, 9.0, 1 / 8, True),
}
CUBE_WAVES = {1: (3.5, 1.0, 1 / 24), 2: (5.0, 1.0, 1 / 16), 3: (2.0, 4.0, 1 / 24), 4: (6.0, 2.0, 1 / 24), 5: (1.5, 5.0, 1 / 24), 6: (8.0, 3.0, 1 / 16)}


def _standard(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values less their mean over their deviation, each channel for itself."""
    stats = df.groupBy(*keys).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return df.join(F.broadcast(stats), keys).withColumn("value", (F.col("value") - F.col("mu")) / F.col("sd")).drop("mu", "sd")  # a row a channel


def image_stack(spark: SparkSession, cases: tuple[int, ...] = (1, 2, 3), low: float = 0.0, high: float = 10.0, sampling_rate: int = 256) -> DataFrame:
    """(image_id, channel, y, x, value): a channel for each case of WAVES, standardised."""
    step = (high - low) / (sampling_rate - 1)
    y, x = F.floor(F.col("id") / sampling_rate), F.col("id") % sampling_rate

    def wave(case: int) -> Column:
        a, b, c, cosine = WAVES[case]
        third = F.cos if cosine else F.sin
        return sum((F.sin(a * (low + v * step)) + F.sin(b * (low + v * step)) + third(c * (low + v * step)) for v in (x, y)), F.lit(0.0))

    cells = spark.range(sampling_rate**2).select(F.lit("stack").alias("image_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), F.posexplode(F.array(*map(wave, cases))).alias("channel", "value"))
    return _standard(cells, ["image_id", "channel"]).select("image_id", "channel", "y", "x", "value")


def cube_stack(spark: SparkSession, cases: tuple[int, ...] = (1, 2, 3), low: float = 0.0, high: float = 10.0, sampling_rate: int = 30) -> DataFrame:
    """(vol_id, channel, z, y, x, value): a channel for each case of CUBE_WAVES, standardised."""
    n, step = sampling_rate, (high - low) / (sampling_rate - 1)
    z, y, x = F.floor(F.col("id") / (n * n)), F.floor(F.col("id") / n) % n, F.col("id") % n

    def wave(case: int) -> Column:
        a, b, c = CUBE_WAVES[case]
        return sum((F.sin(a * (low + v * step)) + F.sin(b * (low + v * step)) + F.cos(c * (low + v * step)) for v in (x, y, z)), F.lit(0.0))

    cells = spark.range(n**3).select(F.lit("stack").alias("vol_id"), z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), F.posexplode(F.array(*map(wave, cases))).alias("channel", "value"))
    return _standard(cells, ["vol_id", "channel"]).select("vol_id", "channel", "z", "y", "x", "value")


def points(spark: SparkSession, number: int = 200, dim: int = 2, seed: int = 42) -> DataFrame:
    """(id, features): Gaussian points under a random linear map, which is the same for all."""
    import random

    r = random.Random(seed)
    rows = [[r.random() for _ in range(dim)] for _ in range(dim)]
    drawn = spark.range(number).select("id", F.array(*[F.randn(seed + k) for k in range(dim)]).alias("z"))
    return drawn.select("id", F.array(*[sum((w * F.get("z", F.lit(k)) for k, w in enumerate(row)), F.lit(0.0)) for row in rows]).alias("features"))


def wind_record(spark: SparkSession, path: str, step: float = 0.05) -> DataFrame:
    """(series_id, t, time, value): the first column of a headless CSV file, a sample each ``step`` seconds, in the file's order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("t", "line")).where(F.trim("line") != "")
    value = F.split("line", ",")[0].cast("double")
    return lines.select(F.lit("wind").alias("series_id"), F.col("t").cast("bigint").alias("t"), (F.col("t") * step).alias("time"), value.alias("value"))
