"""Kernels recover the modes of analytic signals."""

import numpy as np
import pytest

from modeloom.operators.kernels import chirp, numeric, seasonal, sifting, spectral, variational

T = np.arange(1000) / 1000
LOW, HIGH = np.cos(2 * np.pi * 5 * T), 0.5 * np.cos(2 * np.pi * 24 * T)
TWO = LOW + HIGH


def best(modes, part):
    return max(abs(np.corrcoef(m, part)[0, 1]) for m in modes)


@pytest.mark.parametrize("name", ["emd", "remd", "esmd", "lmd", "rlmd", "faemd", "iterative_filtering", "alif", "ceemdan"])
def test_sifting_parts_two_tones(name):
    modes = getattr(sifting, name)(TWO)
    assert np.allclose(modes.sum(0), TWO, atol=1e-8)
    assert best(modes, LOW) > 0.98 and best(modes, HIGH) > 0.98


def test_itd_sums_to_the_signal():
    modes = sifting.itd(TWO)
    assert np.allclose(modes.sum(0), TWO, atol=1e-10) and best(modes, HIGH) > 0.9


def test_emd_parts_tone_and_trend():
    tone, trend = np.cos(2 * np.pi * 4 * T), 3 * (T - 0.5)
    modes = sifting.emd(tone + trend)
    assert np.abs(modes[0] - tone).max() < 0.2 and np.abs(modes[-1] - trend).max() < 0.2


@pytest.mark.parametrize("x", [np.zeros(50), np.arange(50.0), np.array([1.0, 2, 1, 2, 1]), np.repeat([0.0, 1, 0, 2], 5), np.arange(51) % 2])
@pytest.mark.parametrize("name", ["emd", "remd", "esmd", "itd", "lmd", "rlmd", "faemd", "iterative_filtering", "alif"])
def test_sifting_bears_plain_signals(name, x):
    assert np.allclose(getattr(sifting, name)(x).sum(0), x, atol=1e-8)


def test_multivariate():
    x = np.array([np.cos(2 * np.pi * 4 * T) + np.sin(2 * np.pi * 18 * T), np.cos(2 * np.pi * 18 * T), np.sin(2 * np.pi * 4 * T)])
    for f in (sifting.memd, sifting.semd, sifting.faemd):
        assert np.allclose(f(x).sum(0), x, atol=1e-8)
    modes, w, _ = variational.mvmd(np.array([TWO, LOW]), K=2)
    assert np.allclose(w * 1000, [5, 24], atol=0.5) and best(modes[:, 0], HIGH) > 0.95


@pytest.mark.parametrize(("name", "params"), [("vmd", {"K": 2}), ("ovmd", {"K": 2}), ("svmd", {})])
def test_variational(name, params):
    modes, w = getattr(variational, name)(TWO, **params)
    assert best(modes, LOW) > 0.98 and best(modes, HIGH) > 0.98
    assert np.linalg.norm(modes.sum(0) - TWO) / np.linalg.norm(TWO) < 0.1
    assert min(abs(w * 1000 - 24)) < 0.5


def test_vme():
    mode, w = variational.vme(TWO, omega=24, fs=1000)
    assert abs(w - 24) < 0.5 and best([mode], HIGH) > 0.95


def test_stvmd_sums_nearly_to_the_signal():
    modes, _ = variational.stvmd(TWO, K=2)
    assert np.linalg.norm(modes.sum(0) - TWO) / np.linalg.norm(TWO) < 0.3


def test_jmd_finds_the_jumps():
    jump = np.where(T > 0.4, 1.0, 0) - np.where(T > 0.7, 0.6, 0)
    x = HIGH + jump
    modes, found, _ = variational.jmd(x, K=1)
    assert np.corrcoef(found, jump)[0, 1] > 0.85 and best(modes, HIGH) > 0.9


def test_vmd2d():
    y, x = np.mgrid[:64, :64] / 64
    image = np.cos(2 * np.pi * (4 * x + 3 * y)) + np.cos(2 * np.pi * (12 * y - 5 * x))
    modes, centres = variational.vmd2d(image, K=2)
    assert np.allclose(sorted(np.abs(centres * 64).tolist()), [[3, 4], [12, 5]], atol=0.1)
    assert np.linalg.norm(modes.sum(0) - image) / np.linalg.norm(image) < 0.05


def test_spectral():
    for modes in (spectral.ewt(TWO, 2, sigma=0)[0], spectral.efd(TWO, 2)[0], spectral.sst_modes(TWO, 2), spectral.swd(TWO)):
        assert np.allclose(modes.sum(0), TWO, atol=1e-8) and best(modes, LOW) > 0.98 and best(modes, HIGH) > 0.98
    modes, values = spectral.ssa(TWO, 50, lags=50)
    assert np.allclose(modes.sum(0), TWO, atol=1e-8) and (np.diff(values) <= 1e-9).all()
    assert best(spectral.hvd(TWO, 2), LOW) > 0.95


def test_sst_peak():
    coefficients, freq = spectral.sst(np.cos(2 * np.pi * 0.1 * np.arange(1000)))
    assert abs(freq[np.abs(coefficients).sum(1).argmax()] - 0.1) < 0.003


def test_ewt2d_sums_to_the_image():
    image = np.random.default_rng(0).normal(size=(32, 24))
    assert np.allclose(spectral.ewt2d(image).sum(0), image, atol=1e-8)


def test_imd_finds_the_impulses():
    t = np.arange(4000) / 12800
    x = sum(np.where(t >= s, np.exp(-800 * (t - s)) * np.sin(2 * np.pi * 3000 * (t - s)), 0) for s in np.arange(0.01, 0.3, 0.03)) + 0.3 * np.sin(2 * np.pi * 200 * t)
    modes = spectral.imd(x)
    assert np.allclose(modes.sum(0), x, atol=1e-8) and len(modes) > 1


def test_seasonal():
    h = np.arange(24 * 7 * 8)
    day, week, trend = 2 * np.sin(2 * np.pi * h / 24), 3 * np.sin(2 * np.pi * h / 168), 0.01 * h
    x = day + week + trend + 0.1 * np.random.default_rng(0).normal(size=len(h))
    modes = seasonal.mstl(x, (24, 168))
    assert np.allclose(modes.sum(0), x, atol=1e-8)
    assert all(np.corrcoef(m, p)[0, 1] > 0.9 for m, p in zip(modes, (day, week, trend), strict=False))
    for robust in (False, True):
        assert np.allclose(seasonal.stl(x, 24, robust=robust)[0].sum(0), x, atol=1e-10)


def test_chirps():
    f1, f2 = 50 + 30 * T + 20 * np.sin(2 * np.pi * T), 150 + 40 * np.cos(2 * np.pi * T)
    a, b = np.cos(chirp._phase(f1, 1000)), 0.8 * np.cos(chirp._phase(f2, 1000))
    modes, freq, _ = chirp.acmd(a + b, 2, 1000)
    assert best(modes, a) > 0.98 and best(modes, b) > 0.98
    inner = slice(50, -50)
    assert min(np.abs(f - f1)[inner].max() for f in freq) < 1
    g1, g2 = 50 + 200 * T, 250 - 200 * T
    a, b = np.cos(chirp._phase(g1, 1000)), np.cos(chirp._phase(g2, 1000))
    modes, freq, _ = chirp.vncmd(a + b, [60 + 180 * T, 240 - 180 * T], 1000)
    assert best(modes, a) > 0.95 and best(modes, b) > 0.95


def test_osd_fills_gaps():
    square = np.sign(np.sin(2 * np.pi * 1.5 * T))
    x = np.sin(2 * np.pi * 3 * T) + square
    gaps = x.copy()
    gaps[100:110] = np.nan
    parts = chirp.osd(gaps, (("values", (-1.0, 1.0)), ("smooth", 1e3)))
    assert np.corrcoef(parts[0], square)[0, 1] > 0.95 and np.abs(parts[:2].sum(0) - x)[100:110].max() < 0.3


def test_splines():
    x = np.array([0.0, 1, 2.5, 3, 5, 6])
    at = np.linspace(0, 6, 50)
    assert np.allclose(numeric.cubic_spline(x, x**3 - x, at), at**3 - at)
    for f in numeric.SPLINES.values():
        assert np.allclose(f(x, 2 * x + 1, at), 2 * at + 1) and np.allclose(f(x, np.sin(x), x), np.sin(x))
    y = np.array([0.0, 0, 1, 1, 3, 3])
    assert (np.diff(numeric.pchip(x, y, at)) >= -1e-12).all()


def test_banded_solve():
    rng = np.random.default_rng(2)
    n, k = 12, 3
    a = np.zeros((n, n))
    for d in range(1, k):
        a += np.diag(rng.normal(size=n - d), -d)
    a = a + a.T + 8 * np.eye(n)
    bands = np.zeros((k, n))
    for d in range(k):
        bands[d, : n - d] = np.diag(a, -d)
    y = rng.normal(size=n)
    assert np.allclose(numeric.banded_solve(bands, y), np.linalg.solve(a, y))


def test_dtw():
    assert spectral.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == 0
    a, b = np.array([0.0, 1, 2, 1]), np.array([1.0, 1, 0, 2])
    table = np.full((5, 5), np.inf)
    table[0, 0] = 0
    for i in range(4):
        for j in range(4):
            table[i + 1, j + 1] = abs(a[i] - b[j]) + min(table[i, j], table[i, j + 1], table[i + 1, j])
    assert spectral.dtw(a, b) == table[4, 4]


def test_fields():
    from modeloom.operators.kernels import fields

    y, x = np.mgrid[:40, :40] / 40
    image = np.cos(2 * np.pi * 8 * x) + np.cos(2 * np.pi * 2 * y)
    for f in (fields.faemd_field, fields.emd2d):
        modes = f(image)
        assert np.allclose(modes.sum(0), image, atol=1e-8)
    assert max(abs(np.corrcoef(m.ravel(), np.cos(2 * np.pi * 8 * x).ravel())[0, 1]) for m in fields.faemd_field(image)) > 0.95
    stack = np.array([image[:16, :16], image[16:32, :16]])
    assert np.allclose(fields.bmemd(stack, 4, 1, 2).sum(0), stack, atol=1e-8)
    volume = np.random.default_rng(0).normal(size=(6, 7, 8))
    assert np.allclose(fields.faemd_field(volume).sum(0), volume, atol=1e-8)
    assert np.allclose(fields.faemd_field(np.ones((5, 5))).sum(0), 1)
    assert np.allclose(fields.fuse(np.array([image, image])), image)


def test_adaptive():
    from modeloom.operators.kernels import fields

    modes = fields.tvf_emd(TWO)
    assert np.allclose(modes.sum(0), TWO, atol=1e-8) and best(modes, LOW) > 0.95 and best(modes, HIGH) > 0.95
    x = np.array([TWO, LOW, HIGH])
    assert np.allclose(fields.nstemd(x, 16, max_modes=3).sum(0), x, atol=1e-8)
    _, jump, centres = fields.sjmd(TWO + (T > 0.5))
    assert np.corrcoef(jump, T > 0.5)[0, 1] > 0.85 and min(abs(centres * 1000 - 24)) < 1
    modes, freq = fields.stnbmd(TWO, (6, 23), 1000.0)
    assert best(modes.real, LOW) > 0.95 and abs(freq[0].mean() - 5) < 0.25
    assert best(fields.ba_acmd(TWO, 1000.0)[0], HIGH) > 0.95
    assert best(fields.dd_acmd(TWO + 3 * T, 1000.0)[0], HIGH) > 0.95
    fast = np.cos(2 * np.pi * 50 * T) + np.cos(2 * np.pi * 200 * T)
    assert best(fields.vtfmtd(fast, (0.06, 0.19))[0], np.cos(2 * np.pi * 50 * T)) > 0.95
    assert np.allclose(fields.apmd(fast).sum(0), fast, atol=1e-8)


def test_generalized_modes():
    from modeloom.operators.kernels import generalized

    g1, g2 = 50 + 200 * T, 250 - 200 * T
    a, b = np.cos(chirp._phase(g1, 1000)), np.cos(chirp._phase(g2, 1000))
    modes, freq, _ = generalized.avncmd(a + b, [60 + 180 * T, 240 - 180 * T], 1000)
    assert best(modes, a) > 0.98 and best(modes, b) > 0.98
    assert all(np.linalg.norm(f - g) / np.linalg.norm(g) < 0.05 for f, g in zip(freq, (g1, g2), strict=True))
    modes, kinds, _ = generalized.ivgnmd(a + b)
    assert all(kinds) and best(modes, a) > 0.93 and best(modes, b) > 0.93

    share = np.fft.rfftfreq(1000)

    def dispersed(delay, amplitude):
        s = np.fft.irfft(amplitude * np.exp(-2j * np.pi * np.cumsum(np.r_[0, (delay[1:] + delay[:-1]) / 2]) / 1000), 1000)
        return s / np.abs(s).max()

    low = np.cos(chirp._phase(40 + 30 * T, 1000))
    pulse = dispersed(500 + 1500 * (share - 0.33), np.exp(-(((share - 0.33) / 0.06) ** 2)))
    modes, kinds, _ = generalized.vgnmd(low + pulse, 2)
    assert sorted(kinds) == [False, True] and best(modes, low) > 0.99 and best(modes, pulse) > 0.95
    d1, d2 = 200 + 150 * np.sin(3 * np.pi * share), 650 + 200 * share
    wide = np.exp(-(((share - 0.25) / 0.12) ** 4))
    one, two = dispersed(d1, wide), 0.9 * dispersed(d2, wide)
    modes, delays, bands = generalized.agncmd(one + two, 2)
    assert best(modes, one) > 0.95 and best(modes, two) > 0.95
    assert all(best([d[150:350]], g[150:350]) > 0.9 for d, g in zip(sorted(delays, key=np.mean), (d1, d2), strict=True))
    assert all(np.all(np.diff(band) <= 1e-12) for band in bands)
