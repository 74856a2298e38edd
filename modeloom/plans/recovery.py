"""Queries that run a decomposition over a signal of known parts and say what it recovers.

A scene is a signal made as the sum of named parts, each a formula of the sample's
number i. For every part the query takes the mode nearest to it and returns
its strongest Fourier bin, whether it is alike (the correlation reaches
the algorithm's mark) and whether its power is within a share of the part's. SQL
makes the parts from their formulas, finds their strongest bins by direct sums,
and expects every part to be recovered: a kernel that leaves the signal as it is
fails, as a test holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.operators import decompose as D
from modeloom.plans.catalogue import query

#: Scenes: samples, and the parts' formulas, which Spark and DuckDB both read.
SCENES: dict[str, tuple[int, dict[str, str]]] = {
    "tones": (1000, {"slow": "cos(2 * pi() * 5 * i / 1e3)", "fast": "0.5 * cos(2 * pi() * 24 * i / 1e3)"}),
    "high": (1000, {"slow": "cos(2 * pi() * 50 * i / 1e3)", "fast": "cos(2 * pi() * 200 * i / 1e3)"}),
    "uneven": (1000, {"slow": "cos(2 * pi() * 50 * i / 1e3)", "fast": "0.5 * cos(2 * pi() * 200 * i / 1e3)"}),
    "jump": (1000, {"step": "CASE WHEN i > 700 THEN 0.4 WHEN i > 400 THEN 1.0 ELSE 0.0 END", "fast": "0.5 * cos(2 * pi() * 24 * i / 1e3)"}),
    "daily": (1344, {"day": "2 * sin(2 * pi() * i / 24)", "trend": "1e-2 * i"}),
    "weekly": (1344, {"day": "2 * sin(2 * pi() * i / 24)", "week": "3 * sin(2 * pi() * i / 168)", "trend": "1e-2 * i"}),
    "square": (1000, {"square": "sign(sin(2 * pi() * 15e-1 * i / 1e3 + 1e-1))", "sine": "sin(2 * pi() * 3 * i / 1e3)"}),
    "line": (1000, {"line": "3 * i / 1e3", "fast": "0.5 * cos(2 * pi() * 24 * i / 1e3)"}),
    "impulses": (
        3000,
        {"bursts": "exp(-800 * ((i + 200) % 400) / 12800) * sin(2 * pi() * 3000 * ((i + 200) % 400) / 12800)", "hum": "0.3 * sin(2 * pi() * 200 * i / 12800)"},
    ),
    "crossing": (1000, {"up": "cos(2 * pi() * (0.05 * i + 1e-4 * i * i))", "down": "cos(2 * pi() * (0.25 * i - 1e-4 * i * i))"}),
    "pulse": (1000, {"chirp": "cos(2 * pi() * (0.04 * i + 15e-6 * i * i))", "pulse": "2 * exp(-(i - 500) * (i - 500) / 128) * cos(2 * pi() * 0.33 * i)"}),
    "pulses": (
        1000,
        {"early": "exp(-(i - 300) * (i - 300) / 128) * cos(2 * pi() * 0.2 * i)", "late": "exp(-(i - 700) * (i - 700) / 3200) * cos(2 * pi() * (0.25 * i + 1e-3 * (i - 700) * (i - 700)))"},
    ),
    "waves": (1600, {"fine": "cos(2 * pi() * 8 * (i % 40) / 40)", "coarse": "cos(2 * pi() * 2 * floor(i / 40) / 40)"}),
    "bumps": (
        1600,
        {
            "fine": "cos(2 * pi() * 8 * (i % 40) / 40) * cos(2 * pi() * 8 * floor(i / 40) / 40) + 0.3 * sin(2 * pi() * 8 * (i % 40) / 40) * sin(2 * pi() * 8 * floor(i / 40) / 40)",
            "coarse": "cos(2 * pi() * 2 * (i % 40) / 40) * cos(2 * pi() * 2 * floor(i / 40) / 40) + 0.3 * sin(2 * pi() * 2 * (i % 40) / 40) * sin(2 * pi() * 2 * floor(i / 40) / 40)",
        },
    ),
    "volume": (4096, {"fine": "cos(2 * pi() * 4 * (i % 16) / 16)", "coarse": "2 * cos(2 * pi() * floor(i / 256) / 16)"}),
}


@dataclass(frozen=True)
class Trial:
    """How an algorithm is tried: its scene and parameters, which parts it must find, the least correlation and the most that a mode's power may be off."""

    scene: str
    params: dict = field(default_factory=dict)
    parts: tuple[str, ...] = ()
    alike: float = 0.95
    off: float = 0.25
    #: Whether parts have a strongest bin; sweeps have none, and -1 stands for it.
    tonal: bool = True

    def formulas(self) -> dict[str, str]:
        every = SCENES[self.scene][1]
        return {k: v for k, v in every.items() if not self.parts or k in self.parts}


def scene(spark: SparkSession, name: str) -> DataFrame:
    """(series_id, t, value): the sum of a scene's parts."""
    n, parts = SCENES[name]
    return spark.range(n).selectExpr("CAST(id AS DOUBLE) AS i", "id AS t").selectExpr(f"'{name}' AS series_id", "t", f"CAST({' + '.join(f'({p})' for p in parts.values())} AS DOUBLE) AS value")


def recovered(spark: SparkSession, modes: DataFrame, trial: Trial) -> DataFrame:
    """(part, bin, alike, strong) of each part from modes (mode, t, value)."""
    n, _ = SCENES[trial.scene]
    at = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS i", "id AS t")
    formulas = trial.formulas()
    parts = at.select("t", F.explode(F.create_map(*[c for k, v in formulas.items() for c in (F.lit(k), F.expr(v).cast("double"))])).alias("part", "of"))
    met = modes.select("mode", F.col("t").cast("long").alias("t"), "value").join(F.broadcast(parts), "t")  # a few thousand rows
    how = met.groupBy("part", "mode").agg(F.abs(F.try_divide(F.covar_pop("value", "of"), F.stddev_pop("value") * F.stddev_pop("of"))).alias("r"), F.sum(F.col("value") ** 2).alias("power"), F.sum(F.col("of") ** 2).alias("want"), F.sum((F.col("value") - F.col("of")) ** 2).alias("apart"))
    best = how.groupBy("part").agg(F.min_by(F.struct("mode", "r", "power", "want"), "apart").alias("b"))
    best = best.select("part", "b.*")
    spectrum = D.transform(modes.select(F.col("mode").cast("string").alias("series_id"), "t", "value"), "fft").where(F.col("bin") <= n // 2)
    top = spectrum.groupBy(F.col("series_id").cast("int").alias("mode")).agg(F.max_by("bin", F.col("re") ** 2 + F.col("im") ** 2).alias("bin"))
    strong = F.abs(F.col("power") / F.col("want") - 1) <= trial.off
    return best.join(F.broadcast(top), "mode").select("part", (F.col("bin") if trial.tonal else F.lit(-1).cast("bigint")).alias("bin"), F.coalesce(F.col("r") >= trial.alike, F.lit(False)).alias("alike"), strong.alias("strong"))


def expected(trial: Trial) -> str:
    n, _ = SCENES[trial.scene]
    parts = " UNION ALL ".join(f"SELECT '{k}' AS part, i, CAST({v} AS DOUBLE) AS v FROM r" for k, v in trial.formulas().items())
    return f"""WITH r AS (SELECT CAST(range AS DOUBLE) AS i FROM range(0, {n})), p AS ({parts}),
f AS (SELECT part, k, pow(SUM(v * cos(2 * pi() * ((k * i) % {n}) / {n})), 2) + pow(SUM(v * sin(2 * pi() * ((k * i) % {n}) / {n})), 2) AS power FROM p CROSS JOIN range(0, {n // 2 + 1}) t(k) GROUP BY 1, 2)
SELECT part, CAST({"arg_max(k, power)" if trial.tonal else "-1"} AS BIGINT) AS bin, TRUE AS alike, TRUE AS strong FROM f GROUP BY 1"""


TRIALS: dict[str, Trial] = {
    **{name: Trial("tones") for name in ("emd", "remd", "esmd", "lmd", "rlmd", "faemd", "iterative_filtering", "alif", "tvf_emd", "swd", "svmd")},
    **{name: Trial("tones", {"K": 2}) for name in ("vmd", "ovmd", "sst")},
    "itd": Trial("tones", alike=0.89),
    "ceemdan": Trial("tones", {"trials": 8}, off=0.5),
    "ewt": Trial("tones", {"K": 2, "sigma": 0}),
    "efd": Trial("tones", {"max_imfs": 2}),
    "vme": Trial("tones", {"omega": 24, "fs": 1000}, ("fast",)),
    "ssa": Trial("tones", {"K": 4, "lags": 200}, alike=0.9, off=0.8),
    "stnbmd": Trial("tones", {"frequencies": (6, 23), "fs": 1000.0}),
    "hvd": Trial("high", {"K": 2}),
    "stvmd": Trial("high", {"K": 2}, off=0.3),
    "vtfmtd": Trial("high", {"omega": (0.06, 0.19)}),
    "incmd": Trial("high", {"K": 2}),
    "acmd": Trial("high", {"K": 2, "fs": 1000.0}),
    "ba_acmd": Trial("high", {"fs": 1000.0}),
    "apmd": Trial("uneven", {"n_modes": 3}),
    "jmd": Trial("jump", {"K": 1}),
    "sjmd": Trial("jump", {"max_modes": 3}),
    "gdmd": Trial("pulses", {"K": 2}, alike=0.9, tonal=False),
    "dd_acmd": Trial("line", {"fs": 1000.0}),
    "stl": Trial("daily", {"period": 24}),
    "mstl": Trial("weekly", {"periods": (24, 168)}),
    "osd": Trial("square", {"parts": (("values", (-1.0, 1.0)), ("smooth", 1e3))}),
    "imd": Trial("impulses", alike=0.9),
    "vgnmd": Trial("pulse", {"max_modes": 2}, tonal=False),
    "ivgnmd": Trial("crossing", alike=0.92, tonal=False),
    "agncmd": Trial("pulses", {"max_modes": 2}, tonal=False),
}
#: Of channels: the first has all parts, the second the last part and the third the first.
CHANNEL_TRIALS: dict[str, Trial] = {
    "memd": Trial("tones", {"n_dir": 16, "max_modes": 4}), "apitmemd": Trial("tones", {"n_dir": 16, "max_modes": 4}), "nstemd": Trial("tones", {"n_dir": 16, "max_modes": 4}),
    "semd": Trial("tones"), "mvmd": Trial("tones", {"K": 2}), "mjmd": Trial("jump", {"K": 1, "max_iter": 100}),
}
IMAGE_TRIALS: dict[str, Trial] = {
    "ewt2d": Trial("waves", {"K": 2, "sigma": 0}), "faemd2d": Trial("waves"), "vmd2d": Trial("waves", {"K": 2}), "cvmd2d": Trial("waves", {"K": 2}), "emd2d": Trial("bumps", alike=0.9, off=0.5),
}
#: A stack's first image has all parts, its second the first; volumes are cubes.
STACK_TRIAL = Trial("bumps", {"n_dir": 6, "max_imfs": 2, "max_iter": 4}, alike=0.9, off=0.5)
VOLUME_TRIAL = Trial("volume", {}, ("coarse",), alike=0.93)


def _channels(spark: SparkSession, trial: Trial) -> DataFrame:
    n, parts = SCENES[trial.scene]
    forms = list(parts.values())
    channels = ["+".join(f"({p})" for p in forms), forms[-1], forms[0]]
    at = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS i", "id AS t")
    return at.select(F.lit(trial.scene).alias("series_id"), "t", F.posexplode(F.array(*[F.expr(c).cast("double") for c in channels])).alias("channel", "value")).select("series_id", "channel", "t", "value")


def _image(spark: SparkSession, trial: Trial) -> DataFrame:
    t = F.col("t")
    return scene(spark, trial.scene).select(F.lit(trial.scene).alias("image_id"), (t / 40).cast("int").alias("y"), (t % 40).cast("int").alias("x"), "value")


def _add(name: str, trial: Trial, run: Callable[[SparkSession], DataFrame]) -> None:
    query(f"recovers_{name}", expected(trial))(lambda spark, sf_dir: recovered(spark, run(spark), trial))


def _by_series(name: str, trial: Trial) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: D.decompose(scene(spark, trial.scene), name, **trial.params)


def _by_channels(name: str, trial: Trial) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: D.decompose(_channels(spark, trial), name, **trial.params).where("channel = 0")


def _by_image(name: str, trial: Trial) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: D.decompose_images(_image(spark, trial), name, **trial.params).select("mode", (F.col("y") * 40 + F.col("x")).alias("t"), "value")


def _stack(spark: SparkSession) -> DataFrame:
    whole = _image(spark, STACK_TRIAL).withColumn("channel", F.lit(0))
    first = next(iter(SCENES[STACK_TRIAL.scene][1].values()))
    i = F.col("y") * 40 + F.col("x")
    fine = whole.select("image_id", "y", "x", i.cast("double").alias("i")).select("image_id", "y", "x", F.expr(first).cast("double").alias("value"), F.lit(1).alias("channel"))
    modes = D.decompose_stacks(whole.unionByName(fine), **STACK_TRIAL.params)
    return modes.where("channel = 0").select("mode", i.alias("t"), "value")


def _volume(spark: SparkSession) -> DataFrame:
    t = F.col("t")
    cells = scene(spark, VOLUME_TRIAL.scene).select(F.lit("cube").alias("vol_id"), (t / 256).cast("int").alias("z"), ((t / 16).cast("int") % 16).alias("y"), (t % 16).cast("int").alias("x"), "value")
    return D.decompose_volumes(cells).select("mode", (F.col("z") * 256 + F.col("y") * 16 + F.col("x")).alias("t"), "value")


for _trials, _by in ((TRIALS, _by_series), (CHANNEL_TRIALS, _by_channels), (IMAGE_TRIALS, _by_image)):
    for _name, _trial in _trials.items():
        _add(_name, _trial, _by(_name, _trial))
def _joint(adaptive: bool) -> Callable[[SparkSession], DataFrame]:
    """Crossing chirps from first frequencies that are off by a tenth."""

    def run(spark: SparkSession) -> DataFrame:
        x = scene(spark, "crossing")
        first = F.posexplode(F.array(0.055 + 19e-5 * F.col("t"), 0.235 - 19e-5 * F.col("t"))).alias("mode", "init_if")
        return D.vncmd(x, scene(spark, "crossing").select("series_id", "t", first), adaptive=adaptive).select("mode", "t", "value")

    return run


_add("vncmd", Trial("crossing", alike=0.9, tonal=False), _joint(False))
_add("avncmd", Trial("crossing", alike=0.9, tonal=False), _joint(True))
_add("bmemd", STACK_TRIAL, _stack)
_add("faemd3d", VOLUME_TRIAL, _volume)
