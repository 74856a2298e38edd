"""Decompositions of tables of series: one kernel call for each series, in parallel.

``decompose`` returns long rows (series_id, mode, role, channel, t, value). Filters
on series belong before it: they can't be pushed through a kernel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.operators.kernels import chirp, fields, generalized, packets, seasonal, sifting, spectral, timefreq, variational
from modeloom.operators.kernels.numeric import analytic
from modeloom.schema import MODES


def _rows(f):
    """A kernel whose rows are modes and, last, the residue."""
    return lambda x, **p: (f(x, **p), "residue")


def _first(f):
    """A kernel whose first result is the modes, without a residue."""
    return lambda x, **p: (f(x, **p)[0], None)


def _jmd(x, **p):
    modes, jump, _ = variational.jmd(x, **p)
    return np.concatenate([modes, jump[None]]), "jump"


def _sjmd(x, **p):
    modes, jump, _ = fields.sjmd(x, **p)
    return np.concatenate([modes, jump[None]]), "jump"


def _stl(x, **p):
    return seasonal.stl(x, **p)[0], "residue"


#: Kernels of one channel: name to a function that returns modes (K, T) and the last row's role.
KERNELS: dict[str, Callable] = {
    "emd": _rows(sifting.emd), "ceemdan": _rows(sifting.ceemdan), "remd": _rows(sifting.remd), "esmd": _rows(sifting.esmd),
    "itd": _rows(sifting.itd), "lmd": _rows(sifting.lmd), "rlmd": _rows(sifting.rlmd), "faemd": _rows(sifting.faemd),
    "iterative_filtering": _rows(sifting.iterative_filtering), "alif": _rows(sifting.alif),
    "vmd": _first(variational.vmd), "ovmd": _first(variational.ovmd), "svmd": _first(variational.svmd), "stvmd": _first(variational.stvmd),
    "vme": lambda x, **p: (variational.vme(x, **p)[0][None], None), "jmd": _jmd,
    "ewt": _first(spectral.ewt), "efd": _first(spectral.efd), "ssa": _first(spectral.ssa), "hvd": _rows(spectral.hvd), "sst": _rows(spectral.sst_modes),
    "fmd": lambda x, **p: (spectral.fmd(x, **p), None), "swd": _rows(spectral.swd), "imd": _rows(spectral.imd),
    "stl": _stl, "mstl": _rows(seasonal.mstl),
    "acmd": _first(chirp.acmd), "incmd": _first(chirp.incmd), "gdmd": _first(generalized.gdmd), "osd": _rows(chirp.osd),
    "tvf_emd": _rows(fields.tvf_emd), "apmd": _rows(fields.apmd), "sjmd": _sjmd, "ba_acmd": _first(fields.ba_acmd), "dd_acmd": _first(fields.dd_acmd),
    "stnbmd": lambda x, **p: (fields.stnbmd(x, **p)[0].real, None), "vtfmtd": _first(fields.vtfmtd),
    "vgnmd": _first(generalized.vgnmd), "ivgnmd": _first(generalized.ivgnmd), "agncmd": _first(generalized.agncmd),
}
#: Kernels of (C, T), which return (K, C, T).
MULTI: dict[str, Callable] = {
    "memd": _rows(sifting.memd), "apitmemd": _rows(lambda x, adapt=0.3, **p: sifting.memd(x, adapt=adapt, **p)), "semd": _rows(sifting.semd),
    "nstemd": _rows(fields.nstemd), "mvmd": _first(variational.mvmd), "faemd": _rows(sifting.faemd), "stvmd": _first(variational.stvmd), "mjmd": _jmd,
}
MULTI["faemd_channels"] = MULTI["faemd"]


def _long(series: str, modes: np.ndarray, last: str | None, t: np.ndarray) -> pd.DataFrame:
    """Long rows of (K, T) or (K, C, T) modes; kernels of even lengths may lose the last sample."""
    modes = modes[:, None] if modes.ndim == 2 else modes
    k, c, n = modes.shape
    roles = np.array(["mode"] * (k - (last is not None)) + [last] * (last is not None), object)
    return pd.DataFrame({
        "series_id": series,
        "mode": np.repeat(np.arange(k, dtype=np.int32), c * n),
        "role": np.repeat(roles, c * n),
        "channel": np.tile(np.repeat(np.arange(c, dtype=np.int32), n), k),
        "t": np.tile(t[:n], k * c),
        "value": modes.reshape(-1),
    })


def decompose(signal: DataFrame, algorithm: str, **params) -> DataFrame:
    """Modes of every series (series_id, t, value), or of all its channels together (series_id, channel, t, value) for multivariate algorithms.

    Null values are missing (NaN) for ``osd``; other algorithms raise on them.
    Series too short for a kernel come back as one residue.
    """
    multi = algorithm in MULTI and "channel" in signal.columns
    kernel = MULTI[algorithm] if multi else KERNELS[algorithm]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["series_id"].iloc[0]
        pdf = pdf.sort_values(["channel", "t"] if multi else ["t"], kind="stable")
        x = pdf["value"].to_numpy(float)
        t = pdf["t"].to_numpy(np.int64)
        if np.isnan(x).any() and algorithm != "osd":
            raise ValueError(f"{algorithm}: missing values in series {name}")
        if multi:
            x = x.reshape(pdf["channel"].nunique(), -1)
            t = t[: x.shape[1]]
        if x.shape[-1] < 4:
            return _long(name, x[None], "residue", t)
        modes, last = kernel(x, **params)
        return _long(name, np.asarray(modes), last, t)

    columns = ["series_id", "channel", "t", "value"] if multi else ["series_id", "t", "value"]
    return signal.select(*columns).groupBy("series_id").applyInPandas(run, MODES)


def eemd(signal: DataFrame, trials: int = 100, noise_width: float = 0.05, seed: int = 42, **params) -> DataFrame:
    """(series_id, mode, t, value, deviation, trials): means and deviations of a mode over the trials that have it.

    Every trial is a group of its own, so a series' trials run in parallel; means are combined before the shuffle.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        modes = sifting.emd_trial(pdf["value"].to_numpy(float), int(pdf["trial"].iloc[0]), noise_width, seed, **params)
        return _long(pdf["series_id"].iloc[0], modes, "residue", pdf["t"].to_numpy(np.int64))

    each = signal.select("series_id", "t", "value", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    modes = each.groupBy("series_id", "trial").applyInPandas(run, MODES)
    return modes.groupBy("series_id", "mode", "t").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("deviation"), F.count("*").alias("trials"))


def mode_attributes(modes: DataFrame, fs: float = 1.0) -> DataFrame:
    """(series_id, mode, t, inst_freq, inst_amp) of every mode, by its analytic signal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        a = analytic(pdf["value"].to_numpy(float))
        step = np.angle(a[1:] * np.conj(a[:-1])) * fs / (2 * np.pi)
        freq = np.r_[step, step[-1:]] if len(step) else np.zeros(len(a))
        return pd.DataFrame({"series_id": pdf["series_id"], "mode": pdf["mode"], "t": pdf["t"], "inst_freq": freq, "inst_amp": np.abs(a)})

    return modes.select("series_id", "mode", "t", "value").groupBy("series_id", "mode").applyInPandas(run, "series_id string, mode int, t bigint, inst_freq double, inst_amp double")


def hilbert_huang(signal: DataFrame, algorithm: str = "emd", fs: float = 1.0, **params) -> DataFrame:
    """Frequencies and amplitudes of a sifter's modes."""
    return mode_attributes(decompose(signal, algorithm, **params), fs)


def vncmd(signal: DataFrame, initial: DataFrame, fs: float = 1.0, adaptive: bool = False, **params) -> DataFrame:
    """Joint chirp modes (series_id, mode, t, value, inst_freq, inst_amp) from first frequencies (series_id, mode, t, init_if); ``adaptive`` learns bandwidths from the signal (AVNCMD)."""
    kernel = generalized.avncmd if adaptive else chirp.vncmd

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("t", kind="stable")
        first = right.sort_values(["mode", "t"], kind="stable")
        names = first["mode"].unique()
        if left.empty or not len(names):
            return pd.DataFrame(columns=["series_id", "mode", "t", "value", "inst_freq", "inst_amp"])
        start = first["init_if"].to_numpy(float).reshape(len(names), -1)
        modes, freq, amp = kernel(left["value"].to_numpy(float), start, fs, **params)
        t = left["t"].to_numpy(np.int64)
        return pd.DataFrame({"series_id": key[0], "mode": np.repeat(names, len(t)), "t": np.tile(t, len(names)), "value": modes.reshape(-1), "inst_freq": freq.reshape(-1), "inst_amp": amp.reshape(-1)})

    pair = signal.select("series_id", "t", "value").groupBy("series_id").cogroup(initial.select("series_id", "mode", "t", "init_if").groupBy("series_id"))
    return pair.applyInPandas(run, "series_id string, mode int, t bigint, value double, inst_freq double, inst_amp double")


def _by_series(signal: DataFrame, run: Callable[[np.ndarray, np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """Columns that ``run`` makes of a series' samples and their times, beside its id."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        found = run(pdf["value"].to_numpy(float), pdf["t"].to_numpy(np.int64))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], **found})

    return signal.select("series_id", "t", "value").groupBy("series_id").applyInPandas(one, f"series_id string, {schema}")


def kurtogram(signal: DataFrame, levels: int = 5, fs: float = 1.0) -> DataFrame:
    """(series_id, level, band, centre, width, kurtosis) of every band of the half-and-third packet tree."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        level, band, centre, width, k = zip(*packets.kurtogram(x, levels), strict=True)
        return {"level": level, "band": band, "centre": np.array(centre) * fs, "width": np.array(width) * fs, "kurtosis": k}

    return _by_series(signal, run, "level double, band int, centre double, width double, kurtosis double")


def band_envelope(signal: DataFrame, level: float, frequency: float) -> DataFrame:
    """(series_id, k, re, im): the envelope of the kurtogram's band at a level and frequency (cycles a sample), thinned."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        z = packets.band_envelope(x, level, frequency)[0]
        return {"k": np.arange(len(z)), "re": z.real, "im": z.imag}

    return _by_series(signal, run, "k bigint, re double, im double")


def split_bands(signal: DataFrame, parts: int = 2) -> DataFrame:
    """(series_id, band, k, re, im): two half bands or three third bands of the analytic filter bank, thinned as much."""
    cut = {2: packets.halves, 3: packets.thirds}[parts]

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        bands = cut(x, packets.analytic_filters())
        z = np.concatenate(bands)
        return {"band": np.repeat(np.arange(parts, dtype=np.int32), [len(b) for b in bands]), "k": np.concatenate([np.arange(len(b)) for b in bands]), "re": z.real, "im": z.imag}

    return _by_series(signal, run, "band int, k bigint, re double, im double")


def local_frequency(signal: DataFrame) -> DataFrame:
    """(series_id, t, inst_amp, inst_freq): amplitude and frequency (cycles a sample) by central phase differences."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        amp, freq = timefreq.local_frequency(x)
        return {"t": t, "inst_amp": amp, "inst_freq": freq}

    return _by_series(signal, run, "t bigint, inst_amp double, inst_freq double")


def two_tones(signal: DataFrame) -> DataFrame:
    """(series_id, t, a1, f1, a2, f2): amplitudes and frequencies of the two parts of a beat."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        return {"t": t, **dict(zip(("a1", "f1", "a2", "f2"), timefreq.two_tones(x), strict=True))}

    return _by_series(signal, run, "t bigint, a1 double, f1 double, a2 double, f2 double")


def short_time(signal: DataFrame, bins: int = 512, window: int = 32) -> DataFrame:
    """(series_id, t, bin, re, im): the short-time spectrum; bin 0 is half the sampling rate below zero frequency, bin ``bins`` / 2 zero."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        z = timefreq.stft(x, bins, window)
        return {"t": np.tile(t, bins), "bin": np.repeat(np.arange(bins), len(t)), "re": z.real.ravel(), "im": z.imag.ravel()}

    return _by_series(signal, run, "t bigint, bin bigint, re double, im double")


def ridges(signal: DataFrame, bins: int = 512, window: int = 32, jump: int = 5) -> DataFrame:
    """(series_id, t, freq): the strongest ridge of each short-time spectrum, in cycles a sample."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        return {"t": t, "freq": (timefreq.ridge(timefreq.stft(x, bins, window), jump) - bins // 2) / bins}

    return _by_series(signal, run, "t bigint, freq double")


def phase_crossings(phases: DataFrame) -> DataFrame:
    """(series_id, k, t): samples at which a phase (its value, in radians) has turned once more, to the nearest."""

    def run(x: np.ndarray, t: np.ndarray) -> dict[str, object]:
        at = timefreq.phase_crossings(x)
        return {"k": np.arange(len(at)), "t": t[at]}

    return _by_series(phases, run, "k bigint, t bigint")


#: Pairs warped at a time.
DTW_ROWS = 2_000


def dtw(pairs: DataFrame, window: int | None = None) -> DataFrame:
    """(id, other_id, distance) from rows (id, other_id, x, y) whose x and y are arrays of samples."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        size = pd.DataFrame({"x": x.map(len), "y": y.map(len)})
        for at in size.groupby(["x", "y"]).indices.values():
            for part in np.array_split(at, -(-len(at) // DTW_ROWS)):
                out[part] = spectral.dtw_rows(np.array(x.iloc[part].tolist(), float), np.array(y.iloc[part].tolist(), float), window)
        return pd.Series(out)

    return pairs.select("id", "other_id", distance("x", "y").alias("distance"))


IMAGE_KERNELS: dict[str, Callable] = {
    "vmd2d": lambda a, **p: variational.vmd2d(a, **p)[0], "ewt2d": spectral.ewt2d, "emd2d": fields.emd2d, "faemd2d": fields.faemd_field, "cvmd2d": lambda a, **p: fields.cvmd2d(a, **p)[0],
}


def _grid(pdf: pd.DataFrame, axes: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values as an array over the sorted coordinates of all axes; every cell must be there."""
    pdf = pdf.sort_values(axes, kind="stable")
    at = [np.sort(pdf[a].unique()) for a in axes]
    return pdf["value"].to_numpy(float).reshape([len(a) for a in at]), at


def _cells(name, id_column: str, modes: np.ndarray, axes: list[str], at: list[np.ndarray]) -> pd.DataFrame:
    index = np.meshgrid(np.arange(len(modes)), *at, indexing="ij")
    return pd.DataFrame({id_column: name, "mode": index[0].ravel(), **{a: i.ravel() for a, i in zip(axes, index[1:], strict=True)}, "value": modes.ravel()})


def decompose_images(images: DataFrame, algorithm: str, **params) -> DataFrame:
    """(image_id, mode, y, x, value) of every image (image_id, y, x, value)."""
    kernel = IMAGE_KERNELS[algorithm]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, at = _grid(pdf, ["y", "x"])
        return _cells(pdf["image_id"].iloc[0], "image_id", kernel(grid, **params), ["y", "x"], at)

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "y", "x", "value").groupBy("image_id").applyInPandas(run, f"image_id {kind}, mode int, y int, x int, value double")


def decompose_stacks(stacks: DataFrame, **params) -> DataFrame:
    """(image_id, mode, channel, y, x, value) of every stack (image_id, channel, y, x, value), its channels sifted together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, at = _grid(pdf, ["channel", "y", "x"])
        return _cells(pdf["image_id"].iloc[0], "image_id", fields.bmemd(grid, **params), ["channel", "y", "x"], at)

    kind = dict(stacks.dtypes)["image_id"]
    chosen = stacks.select("image_id", "channel", "y", "x", "value")
    return chosen.groupBy("image_id").applyInPandas(run, f"image_id {kind}, mode int, channel int, y int, x int, value double")


def decompose_volumes(volumes: DataFrame, **params) -> DataFrame:
    """(vol_id, mode, z, y, x, value) of every volume (vol_id, z, y, x, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, at = _grid(pdf, ["z", "y", "x"])
        return _cells(pdf["vol_id"].iloc[0], "vol_id", fields.faemd_field(grid, **params), ["z", "y", "x"], at)

    kind = dict(volumes.dtypes)["vol_id"]
    return volumes.select("vol_id", "z", "y", "x", "value").groupBy("vol_id").applyInPandas(run, f"vol_id {kind}, mode int, z int, y int, x int, value double")


def transform(signal: DataFrame, kind: str = "fft") -> DataFrame:
    """(series_id, bin, re, im) of whole series by FFT: kind is fft, ifft (of real values), or hilbert, the analytic signal by sample."""
    how = {"fft": np.fft.fft, "ifft": np.fft.ifft, "hilbert": analytic}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = how(pdf.sort_values("t", kind="stable")["value"].to_numpy(float))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "bin": np.arange(len(z)), "re": z.real, "im": z.imag})

    return signal.select("series_id", "t", "value").groupBy("series_id").applyInPandas(run, "series_id string, bin bigint, re double, im double")


def transform_images(images: DataFrame, inverse: bool = False) -> DataFrame:
    """(image_id, y, x, re, im): the two-dimensional Fourier transform of images, or the inverse one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, at = _grid(pdf, ["y", "x"])
        z = (np.fft.ifft2 if inverse else np.fft.fft2)(grid)
        y, x = np.meshgrid(*at, indexing="ij")
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y.ravel(), "x": x.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "y", "x", "value").groupBy("image_id").applyInPandas(run, f"image_id {kind}, y int, x int, re double, im double")


def prewhiten(signal: DataFrame, order: int = 100) -> DataFrame:
    """(series_id, t, value): what an autoregression of the given order, fitted by Yule and Walker's equations, doesn't foresee."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        x = pdf["value"].to_numpy(float)
        x = x - x.mean()
        p = min(order, len(x) - 1)
        r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: p + 1] / max(len(x), 1)
        system = r[np.abs(np.arange(p)[:, None] - np.arange(p)[None])] + 1e-9 * (r[0] if p else 0) * np.eye(p)
        a = np.linalg.solve(system, r[1:]) if p else np.zeros(0)
        return pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "value": np.convolve(x, np.r_[1.0, -a])[: len(x)]})

    return signal.select("series_id", "t", "value").groupBy("series_id").applyInPandas(run, "series_id string, t bigint, value double")


def algorithms(spark) -> DataFrame:
    """(name, kind) of every algorithm that can be named."""
    rows = [(k, "signal") for k in KERNELS] + [(k, "channels") for k in MULTI] + [(k, "image") for k in IMAGE_KERNELS] + [("bmemd", "stack"), ("faemd3d", "volume"), ("eemd", "ensemble"), ("vncmd", "joint"), ("avncmd", "joint"), ("online_emd", "stream")]
    return spark.createDataFrame(rows, "name string, kind string")
