"""Numerical building blocks: splines, analytic signals, banded solves, filters, extrema."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np


def thomas(low: np.ndarray, main: np.ndarray, high: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a tridiagonal system; low[0] and high[-1] are ignored."""
    n = len(main)
    c, d = [0.0] * n, [0.0] * n
    a_, b_, c_, r_ = low.tolist(), main.tolist(), high.tolist(), rhs.tolist()
    c[0], d[0] = c_[0] / b_[0], r_[0] / b_[0]
    for i in range(1, n):
        m = b_[i] - a_[i] * c[i - 1]
        c[i], d[i] = c_[i] / m, (r_[i] - a_[i] * d[i - 1]) / m
    out = [0.0] * n
    out[-1] = d[-1]
    for i in range(n - 2, -1, -1):
        out[i] = d[i] - c[i] * out[i + 1]
    return np.array(out)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The not-a-knot spline through (x, y); a line through two points, a parabola through three."""
    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    n = len(x)
    if n == 1:
        return np.full(len(at), y[0])
    if n < 4:
        return np.polynomial.Polynomial.fit(x, y, n - 1)(at)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    low, high = h[:-1].copy(), h[1:].copy()
    main, rhs = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
    r, s = h[0] / h[1], h[-1] / h[-2]
    main[0] += h[0] * (1 + r)
    high[0] -= h[0] * r
    main[-1] += h[-1] * (1 + s)
    low[-1] -= h[-1] * s
    inner = thomas(low, main, high, rhs)
    m = np.empty(n)
    m[1:-1] = inner
    m[0] = (1 + r) * m[1] - r * m[2]
    m[-1] = (1 + s) * m[-2] - s * m[-3]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, v, w = at - x[i], x[i + 1] - at, h[i]
    return (m[i] * v**3 + m[i + 1] * u**3) / (6 * w) + (y[i] / w - m[i] * w / 6) * v + (y[i + 1] / w - m[i + 1] * w / 6) * u


def hermite(x: np.ndarray, y: np.ndarray, slope: np.ndarray, at: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    w = x[i + 1] - x[i]
    u = (at - x[i]) / w
    return (1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * w * slope[i] + u * u * (3 - 2 * u) * y[i + 1] + u * u * (u - 1) * w * slope[i + 1]


def spline_through_three(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through three knots."""
    (h0, h1), (d0, d1) = np.diff(x), np.diff(y) / np.diff(x)
    bend = 3 * (d1 - d0) / (h0 + h1)  # the middle knot's second derivative; the outer ones have none
    right = at >= x[1]
    h, d = np.where(right, h1, h0), np.where(right, d1, d0)
    u = np.where(right, x[2] - at, at - x[0])  # from the outer knot
    start = np.where(right, y[2], y[0])
    slope = np.where(right, -d, d) - bend * h / 6
    return start + slope * u + bend * u**3 / (6 * h)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic pieces: slopes are weighted harmonic means, zero at turns."""
    if len(x) < 3:
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    turn = d[:-1] * d[1:] <= 0
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(turn, 0.0, (a + b) / (a / d[:-1] + b / d[1:]))

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    return hermite(x, y, np.r_[end(h[0], h[1], d[0], d[1]), inner, end(h[-1], h[-2], d[-1], d[-2])], at)


def akima(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return np.interp(at, x, y)
    d = np.diff(y) / np.diff(x)
    d = np.r_[3 * d[0] - 2 * d[1], 2 * d[0] - d[1], d, 2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]
    w = np.abs(np.diff(d))
    left, right = w[2:], w[:-2]
    total = left + right
    slope = np.where(total > 1e-12, (left * d[1:-2] + right * d[2:-1]) / np.where(total > 1e-12, total, 1), (d[1:-2] + d[2:-1]) / 2)
    return hermite(x, y, slope, at)


def cubic_hermite(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.interp(at, x, y) if len(x) < 3 else hermite(x, y, np.gradient(y, x), at)


SPLINES = {"cubic": cubic_spline, "pchip": pchip, "akima": akima, "cubic_hermite": cubic_hermite, "linear": lambda x, y, at: np.interp(at, x, y)}


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return first, np.r_[first[1:] - 1, len(x) - 1]


def extrema(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of maxima and minima; of a plateau its middle, none at the ends."""
    first, last = runs(x)
    v = x[first]
    rise = np.diff(v) > 0
    mid = np.round((first + last) / 2).astype(int)
    return mid[1:-1][rise[:-1] & ~rise[1:]], mid[1:-1][~rise[:-1] & rise[1:]]


def zero_crossings(x: np.ndarray) -> int:
    s = np.sign(x[x != 0])
    return int((s[1:] != s[:-1]).sum())


def analytic(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """The signal plus i times its Hilbert transform."""
    n = x.shape[axis]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    shape = [1] * x.ndim
    shape[axis] = n
    return np.fft.ifft(np.fft.fft(x, axis=axis) * gain.reshape(shape), axis=axis)


def envelope_frequency(x: np.ndarray, fs: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude and frequency of a mode, from the phase step between neighbours (the last one's is repeated)."""
    a = analytic(x)
    step = np.angle(a[1:] * np.conj(a[:-1])) * fs / (2 * np.pi)
    return np.abs(a), np.r_[step, step[-1:]] if len(step) else np.zeros(len(x))


def half_mirror(x: np.ndarray) -> np.ndarray:
    """A signal with half its length reflected at either end."""
    h = len(x) // 2
    return np.concatenate([x[..., :h][..., ::-1], x, x[..., len(x) - h :][..., ::-1]], axis=-1) if x.ndim == 1 else np.concatenate([x[..., : x.shape[-1] // 2][..., ::-1], x, x[..., x.shape[-1] - x.shape[-1] // 2 :][..., ::-1]], axis=-1)


def banded_solve(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive definite banded system; bands[k][i] is the entry (i + k, i). L D L', row by row."""
    width, n = bands.shape
    k = width - 1
    low = bands.astype(float).copy()
    d = np.empty(n)
    y = rhs.astype(float).copy()
    for j in range(n):
        lo = max(0, j - k)
        # L[j, i] for i in lo..j-1 lies at low[j - i, i]
        i = np.arange(lo, j)
        lj = low[j - i, i]
        d[j] = low[0, j] - (lj * lj * d[lo:j]).sum()
        y[j] = y[j] - lj @ y[lo:j]
        for r in range(1, min(k, n - 1 - j) + 1):
            row = j + r
            i = np.arange(max(0, row - k), j)
            low[r, j] = (low[r, j] - (low[row - i, i] * low[j - i, i] * d[i]).sum()) / d[j]
    y = (y.T / d).T
    for j in range(n - 1, -1, -1):
        hi = min(n - 1, j + k)
        r = np.arange(1, hi - j + 1)
        y[j] = y[j] - low[r, j] @ y[j + 1 : hi + 1]
    return y


def second_difference_gram(n: int) -> np.ndarray:
    """D'D of second differences with zero ends, dense: the operator whose rows are (1, -2, 1), cut at the borders."""
    d = np.diag(np.full(n, -2.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    d[0, :2], d[-1, -2:] = (-1, 1), (1, -1)
    return d.T @ d


def smooth_curve(y: np.ndarray, strength: float) -> np.ndarray:
    """The minimiser of |f - y|^2 + strength |second differences of f|^2."""
    n = len(y)
    if n < 3 or strength == 0:
        return y.copy()
    # with mirrored ends the differences are diagonal under the cosine transform
    theta = np.pi * np.arange(n) / n
    gain = 1 / (1 + strength * (2 - 2 * np.cos(theta)) ** 2)
    wide = np.concatenate([y, y[::-1]])
    spectrum = np.fft.rfft(wide)
    full = np.interp(np.arange(len(spectrum)), np.arange(n), gain) if len(spectrum) == n else np.r_[gain, gain[-1] * np.ones(len(spectrum) - n)]
    return np.fft.irfft(spectrum * full, 2 * n)[:n]


def welch(x: np.ndarray, fs: float = 1.0, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power by Hann windows that overlap by half."""
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, size // 2)]
    p = (np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * w, axis=1)) ** 2).mean(0) / (fs * (w**2).sum())
    p[1:-1] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def savgol_rows(window_length: int, poly_order: int) -> np.ndarray:
    """Row i has the weights that fit a polynomial to a window and read it at sample i."""
    x = np.arange(window_length) - window_length // 2
    a = np.vander(x, poly_order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(x: np.ndarray, size: int, order: int) -> np.ndarray:
    fit, half = savgol_rows(size, order), size // 2
    inner = np.lib.stride_tricks.sliding_window_view(x, size) @ fit[half]
    return np.concatenate([fit[:half] @ x[:size], inner, fit[half + 1 :] @ x[-size:]])


#: Digits of the largest double with decimal places.
_DIGITS = Context(prec=400)


def round_half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Doubles rounded by their shortest decimal digits, halves away from zero, as SQL's round."""
    size = np.abs(x)
    with np.errstate(all="ignore"):
        scaled = size * 10.0**places
        out = np.copysign(np.floor(scaled + 0.5) / 10.0**places, x)
        open_ = np.flatnonzero(np.isfinite(x) & ~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-15 * scaled + 1e-12))
    for i in open_:
        out.flat[i] = float(Decimal(repr(float(x.flat[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, _DIGITS))
    return np.where(np.isfinite(x), out, x)
