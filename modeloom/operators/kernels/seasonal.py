"""Seasonal-trend decomposition by local regression."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, at: np.ndarray, window: int, degree: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local constants or lines with tricube weights of the ``window`` nearest of equally spaced samples, read at ``at``."""
    n = len(y)
    weights = np.ones(n) if weights is None else weights
    q = min(window, n)
    x = np.arange(n, dtype=float)
    at = np.asarray(at, float)
    left = np.clip(np.round(at - (q - 1) / 2), 0, n - q).astype(int)
    idx = left[:, None] + np.arange(q)[None]
    dist = np.abs(x[idx] - at[:, None])
    reach = dist.max(1, keepdims=True)
    if window > n:
        reach = reach + (window - n) / 2
    u = np.clip(dist / np.maximum(reach * 1.0000001, 1e-12), 0, 1)
    w = (1 - u**3) ** 3 * weights[idx]
    total = w.sum(1)
    safe = np.where(total > 0, total, 1)
    v = y[idx]
    mean = (w * v).sum(1) / safe
    if degree:
        mx = (w * x[idx]).sum(1) / safe
        dx = x[idx] - mx[:, None]
        var = (w * dx**2).sum(1)
        slope = (w * dx * v).sum(1) / np.where(var > 1e-12, var, 1)
        mean = mean + np.where(var > 1e-12, slope * (at - mx), 0)
    return np.where(total > 0, mean, v.mean(1))


def _average(x: np.ndarray, size: int) -> np.ndarray:
    s = np.cumsum(np.r_[0.0, x])
    return (s[size:] - s[:-size]) / size


def stl(x, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, seasonal_deg: int = 1, trend_deg: int = 1, low_pass_deg: int = 1, robust: bool = False):
    """Rows seasonal, trend, residue, which sum to the signal, and the robustness weights."""
    y = np.asarray(x, float)
    n = len(y)
    if n < 2 * period:
        raise ValueError("a series needs two periods")
    trend = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    low_pass = low_pass or (period + 1) | 1
    t, s, weights = np.zeros(n), np.zeros(n), np.ones(n)
    every = np.arange(n)
    for _ in range(11 if robust else 1):
        for _ in range(1 if robust else 2):
            free = y - t
            cycle = np.empty(n + 2 * period)
            for k in range(period):
                part = free[k::period]
                cycle[k::period] = loess(part, np.arange(-1, len(part) + 1), seasonal, seasonal_deg, weights[k::period])
            low = _average(_average(_average(cycle, period), period), 3)
            s = cycle[period : period + n] - loess(low, every, low_pass, low_pass_deg)
            t = loess(y - s, every, trend, trend_deg, weights)
        if robust:
            r = np.abs(y - s - t)
            h = 6 * np.median(r)
            weights = np.ones(n) if h == 0 else (1 - np.clip(r / h, 0, 1) ** 2) ** 2
    return np.array([s, t, y - s - t]), weights


def box_cox(x: np.ndarray, power: float) -> np.ndarray:
    return np.log(x) if power == 0 else (x**power - 1) / power


def best_power(x: np.ndarray) -> float:
    """The Box-Cox power of greatest likelihood between -2 and 2, by golden section."""
    logs = np.log(x).sum()

    def like(p: float) -> float:
        return (p - 1) * logs - len(x) / 2 * np.log(max(box_cox(x, p).var(), 1e-300))

    a, b, g = -2.0, 2.0, (np.sqrt(5) - 1) / 2
    while b - a > 1e-6:
        c, d = b - g * (b - a), a + g * (b - a)
        if like(c) > like(d):
            b = d
        else:
            a = c
    return (a + b) / 2


def mstl(x, periods, windows=None, iterate: int = 2, power: float | str | None = None, **params):
    """Rows: a seasonal part for each period (rising), trend, residue; they sum to the (transformed) signal. Periods of half the series or more go."""
    y = np.asarray(x, float)
    if power is not None:
        y = box_cox(y, best_power(y) if power == "auto" else float(power))
    kept = sorted(p for p in set(periods) if p < len(y) / 2)
    windows = windows or [11 + 4 * i for i in range(len(kept))]
    parts = {p: np.zeros(len(y)) for p in kept}
    trend = np.zeros(len(y))
    free = y.copy()
    for _ in range(iterate if len(kept) > 1 else 1):
        for p, w in zip(kept, windows, strict=False):
            free = free + parts[p]
            (s, trend, _), _ = stl(free, p, seasonal=w, **params)
            parts[p] = s
            free = free - s
    if not kept:
        trend = loess(y, np.arange(len(y)), max(3, len(y) // 2) | 1, 1)
    return np.array([*parts.values(), trend, free - trend])
