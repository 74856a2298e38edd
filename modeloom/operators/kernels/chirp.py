"""Chirp modes with their instantaneous frequencies, dispersive modes with their group delays, and signals of prescribed parts."""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels.numeric import smooth_curve, welch


def _smooth(u: np.ndarray, strength: float) -> np.ndarray:
    return smooth_curve(u.real, strength) + 1j * smooth_curve(u.imag, strength)


def _phase(freq: np.ndarray, fs: float) -> np.ndarray:
    """The phase of a frequency (Hz), by the trapezoidal rule, from 0."""
    return 2 * np.pi * np.r_[0.0, np.cumsum((freq[1:] + freq[:-1]) / 2)] / fs


def demodulate(x: np.ndarray, freq: np.ndarray, fs: float, strength: float, real: bool = True) -> np.ndarray:
    """The smooth complex amplitude u for which (the real part of) u e^{i phase} is near x.

    The conjugate image of a real signal turns at twice the phase, where the
    smoother leaves little of it, so a few fixed-point rounds remove it.
    """
    turn = np.exp(-1j * _phase(freq, fs))
    if not real:
        return _smooth(x * turn, strength)
    u = _smooth(2 * x * turn, strength)
    for _ in range(3):
        u = _smooth(2 * x * turn - np.conj(u) * turn**2, strength)
    return u


def _slope(u: np.ndarray, fs: float) -> np.ndarray:
    """The frequency (Hz) that a complex amplitude adds."""
    du = np.gradient(u)
    return (np.conj(u) * du).imag / np.maximum(np.abs(u) ** 2, 1e-12 * (np.abs(u) ** 2).max() + 1e-300) * fs / (2 * np.pi)


def follow(x: np.ndarray, freq: np.ndarray, fs: float, alpha: float, beta: float, tol: float, max_iter: int, real: bool = True):
    """One mode from a first frequency: (mode, frequency, amplitude)."""
    mode = np.zeros(len(x), complex if not real else float)
    u = np.zeros(len(x), complex)
    for _ in range(max_iter):
        u = demodulate(x, freq, fs, 1 / alpha, real)
        old, mode = mode, u * np.exp(1j * _phase(freq, fs))
        if real:
            mode = mode.real
        freq = freq + 0.5 * smooth_curve(_slope(u, fs), 1 / beta)
        if (np.abs(mode - old) ** 2).sum() < tol * max((np.abs(old) ** 2).sum(), 1e-300):
            break
    return mode, freq, np.abs(u)


def _start(x: np.ndarray, fs: float) -> np.ndarray:
    p = np.abs(np.fft.rfft(x))
    p[0] = 0
    return np.full(len(x), np.argmax(p) * fs / len(x))


def acmd(x, K: int = 2, fs: float = 1.0, alpha: float = 1e-5, beta: float = 1e-7, tol: float = 1e-8, max_iter: int = 300, energy_stop: float = 0.0):
    """Chirp modes one after the other, each from the strongest Fourier bin of what is left: modes, frequencies, amplitudes."""
    rest = np.asarray(x, float)
    power = (rest**2).sum() or 1.0
    out = []
    for _ in range(K):
        if (rest**2).sum() < energy_stop * power:
            break
        # a wide band first, so that the frequency can be followed; then the asked one
        f = _start(rest, fs)
        for wide in (1e3, 30, 1):
            mode, f, a = follow(rest, f, fs, alpha * wide, beta, tol, max_iter // 3 + 1)
        out.append((mode, f, a))
        rest = rest - mode
    return tuple(np.array(p) for p in zip(*out, strict=True)) if out else (np.zeros((0, len(rest))),) * 3


def vncmd(x, initial, fs: float = 1.0, alpha: float = 1e-5, beta: float = 1e-7, tol: float = 1e-8, max_iter: int = 300):
    """All chirp modes together from first frequencies (K, T): modes, frequencies, amplitudes. Modes may cross."""
    x = np.asarray(x, float)
    freq = np.array(initial, float)
    modes, amps = np.zeros_like(freq), np.zeros_like(freq)
    for _ in range(max_iter):
        moved = 0.0
        for k in range(len(freq)):
            u = demodulate(x - modes.sum(0) + modes[k], freq[k], fs, 1 / alpha)
            new = (u * np.exp(1j * _phase(freq[k], fs))).real
            moved += ((new - modes[k]) ** 2).sum()
            modes[k], amps[k] = new, np.abs(u)
            freq[k] = freq[k] + 0.5 * smooth_curve(_slope(u, fs), 1 / beta)
        if moved < tol * max((modes**2).sum(), 1e-300):
            break
    return modes, freq, amps


def incmd(x, K: int = 2, strength: float = 1e3, max_iter: int = 100, tol: float = 1e-6):
    """Chirp modes one after the other, each by itself from the strongest frequency of Welch's spectrum of what is left; a wide band first."""
    rest = np.asarray(x, float)
    out = []
    for _ in range(K):
        f, p = welch(rest)
        freq = np.full(len(rest), f[1 + int(np.argmax(p[1:]))])
        for wide in (1e3, 30, 1):
            mode, freq, amp = follow(rest, freq, 1.0, wide / strength / 100, 1e-6, tol, max_iter // 3 + 1)
        out.append((mode, freq, amp))
        rest = rest - mode
    return tuple(np.array(p) for p in zip(*out, strict=True))


def curve_prox(y: np.ndarray, kind: str, weight: float, rounds: int = 80) -> np.ndarray:
    """The curve nearest to y with a small penalty: smooth second differences, sparse first or second differences, small or sparse values, or one of a set of values."""
    if kind == "smooth":
        return smooth_curve(y, weight)
    if kind == "small":
        return y / (1 + 2 * weight)
    if kind == "values":
        allowed = np.asarray(weight, float)
        return allowed[np.abs(y[:, None] - allowed).argmin(1)]
    if kind == "sparse":
        return np.sign(y) * np.maximum(np.abs(y) - weight, 0)
    order = {"flat": 1, "straight": 2}[kind]
    n = len(y)
    theta = np.pi * np.arange(n + 1) / n
    v = y.copy()
    z = np.diff(v, order)
    dual = np.zeros_like(z)
    if order == 1:
        # first differences: the solve is diagonal under the cosine transform
        gain = 1 / (1 + (2 - 2 * np.cos(theta)))
        for _ in range(rounds):
            t = z - dual
            rhs = y + np.r_[-t, 0] + np.r_[0, t]
            v = np.fft.irfft(np.fft.rfft(np.r_[rhs, rhs[::-1]]) * gain, 2 * n)[:n]
            d = np.diff(v)
            z = np.sign(d + dual) * np.maximum(np.abs(d + dual) - weight, 0)
            dual = dual + d - z
        return v
    d2 = np.diff(np.eye(n), 2, axis=0)
    solve = np.linalg.inv(np.eye(n) + d2.T @ d2)
    for _ in range(rounds):
        v = solve @ (y + d2.T @ (z - dual))
        d = d2 @ v
        z = np.sign(d + dual) * np.maximum(np.abs(d + dual) - weight, 0)
        dual = dual + d - z
    return v


def osd(x, parts=(("smooth", 1e4), ("flat", 1.0)), max_iter: int = 100, tol: float = 1e-6):
    """A signal as parts of prescribed classes and a small rest, by block coordinate descent; missing samples (NaN) are filled by the parts.

    Rows are the parts and the rest; where a sample is known they sum to it.
    """
    x = np.asarray(x, float)
    known = ~np.isnan(x)
    at = np.arange(len(x))
    y = np.interp(at, at[known], x[known]) if known.any() else np.zeros(len(x))
    rows = np.zeros((len(parts), len(x)))
    for sweep in range(max_iter):
        before = rows.copy()
        for k, (kind, weight) in enumerate(parts):
            # the first sweep starts from interpolated gaps, later ones leave them to the parts
            target = np.where(known | (sweep == 0), y - rows.sum(0) + rows[k], rows[k])
            rows[k] = curve_prox(target, kind, weight)
        if ((rows - before) ** 2).sum() < tol * max((rows**2).sum(), 1e-300):
            break
    return np.array([*rows, np.where(known, y - rows.sum(0), 0.0)])
