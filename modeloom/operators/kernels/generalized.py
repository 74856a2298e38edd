"""Modes that are chirps along time or dispersed along frequency, found in the time-frequency plane; adaptive chirps and group delays.

The plane is the short-time spectrum's energy; where several windows agree,
cells belong to modes. A chirp has one frequency at each time, a dispersed mode
one time at each frequency; either is then followed by smooth demodulation, of
the signal or of its spectrum.
"""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels import chirp
from modeloom.operators.kernels.numeric import smooth_curve
from modeloom.operators.kernels.timefreq import stft


def plane(x: np.ndarray, windows: int = 5, bins: int = 256) -> np.ndarray:
    """(bins, n) energies at 0 to half the sampling rate: the geometric mean over windows of a sixteenth to a quarter of ``bins``, each scaled to a largest value of one."""
    total = np.zeros((bins, len(x)))
    for size in np.geomspace(bins / 8, bins / 2, windows):
        e = np.abs(stft(x, 2 * bins, int(size))[bins:]) ** 2
        total += np.log(e / max(e.max(), 1e-300) + 1e-12)
    return np.exp(total / windows)


def clusters(mask: np.ndarray) -> list[np.ndarray]:
    """Cells (row, column) of each connected part of a mask, neighbours along sides and corners; the largest first."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # every cell takes the largest label around it
        wide = np.pad(label, 1)
        best = np.max([wide[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(3) for b in range(3)], axis=0) * mask
        # then the label of the cell that its label names
        flat = np.r_[0, best.ravel()]
        best = flat[best]
        if np.array_equal(best, label):
            break
        label = best
    cells = np.argwhere(mask)
    names = label[mask]
    order = np.argsort(names, kind="stable")
    parts = np.split(cells[order], np.flatnonzero(np.diff(names[order])) + 1) if len(cells) else []
    return sorted(parts, key=len, reverse=True)


def is_chirp(cells: np.ndarray, shape: tuple[int, int]) -> bool:
    """Whether a part is thinner along frequency than along time, as shares of the plane."""
    high = len(cells) / max(len(np.unique(cells[:, 1])), 1) / shape[0]
    wide = len(cells) / max(len(np.unique(cells[:, 0])), 1) / shape[1]
    return high <= wide


def _centroids(cells: np.ndarray, weight: np.ndarray, along: int, size: int) -> np.ndarray:
    """The weighed mean of the other coordinate at each place along one, carried on beyond the part's ends."""
    at, of = cells[:, along], cells[:, 1 - along]
    total = np.bincount(at, weight, size)
    mean = np.bincount(at, weight * of, size) / np.maximum(total, 1e-300)
    known = np.flatnonzero(total > 0)
    return np.interp(np.arange(size), known, mean[known])


def _extract(rest: np.ndarray, chirped: bool, curve: np.ndarray, alpha: float, beta: float, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """A mode and its frequency (cycles a sample, by time) or delay (samples, by Fourier bin) from a first curve."""
    n = len(rest)
    if chirped:
        mode, freq, _ = chirp.follow(rest, curve, 1.0, alpha, beta, tol, max_iter)
        return mode, freq
    part, delay, _ = chirp.follow(np.fft.rfft(rest), -curve, n, alpha, beta, tol, max_iter, real=False)
    return np.fft.irfft(part, n), -delay


def _resolve(x: np.ndarray, found: list[tuple[bool, np.ndarray]], alpha: float, beta: float, tol: float, max_iter: int, sweeps: int = 3):
    """Modes, their kinds and curves: each is followed in what the others leave, some times over."""
    modes = np.zeros((len(found), len(x)))
    curves = [c for _, c in found]
    for _ in range(sweeps):
        for k, (chirped, _) in enumerate(found):
            modes[k], curves[k] = _extract(x - modes.sum(0) + modes[k], chirped, curves[k], alpha, beta, tol, max_iter)
    return modes, [c for c, _ in found], curves


def vgnmd(x, max_modes: int = 4, alpha: float = 1e-4, beta: float = 1e-7, tol: float = 1e-8, max_iter: int = 100, windows: int = 5, level: float = 0.02):
    """Modes (K, T), whether each is a chirp, and their curves: the connected parts of the plane above a level, each followed along time or along frequency."""
    x = np.asarray(x, float)
    e = plane(x, windows)
    bins = len(e)
    found = []
    for cells in clusters(e > level * e.max())[:max_modes]:
        if len(cells) < 0.0005 * e.size:
            break
        weight = e[cells[:, 0], cells[:, 1]]
        if is_chirp(cells, e.shape):
            found.append((True, smooth_curve(_centroids(cells, weight, 1, len(x)) / (2 * bins), 1e4)))
        else:
            late = _centroids(cells, weight, 0, bins)
            found.append((False, smooth_curve(np.interp(np.linspace(0, bins - 1, len(x) // 2 + 1), np.arange(bins), late), 1e4)))
    return _resolve(x, found, alpha, beta, tol, max_iter) if found else (np.zeros((0, len(x))), [], [])


def _track(e: np.ndarray, reach: int, memory: int) -> np.ndarray:
    """The row at each column of the strongest path, which goes on in its own direction and so passes through others."""
    rows, columns = e.shape
    top, start = np.unravel_index(int(e.argmax()), e.shape)
    # the direction at the start, where paths may cross: that of the straight line with most energy
    off = np.arange(-2 * memory, 2 * memory + 1)
    at = start + off
    lines = np.round(top + np.linspace(-2, 2, 161)[:, None] * off).astype(int)
    known = (at >= 0) & (at < columns) & (lines >= 0) & (lines < rows)
    held = np.where(known, e[np.clip(lines, 0, rows - 1), np.clip(at, 0, columns - 1)], 0).sum(1)
    lead = float(np.linspace(-2, 2, 161)[int(held.argmax())])
    out = np.full(columns, float(top))
    for step in (1, -1):
        trail = [top - lead * step * k for k in range(memory, -1, -1)]
        for j in range(start + step, columns if step > 0 else -1, step):
            slope = (trail[-1] - trail[-memory]) / (memory - 1)
            ahead = trail[-1] + slope
            low, high = max(0, int(ahead) - reach), min(rows, int(ahead) + reach + 2)
            if high <= low:
                trail.append(min(max(ahead, 0.0), rows - 1.0))
            else:
                w = e[low:high, j] * np.exp(-(((np.arange(low, high) - ahead) / reach) ** 2))
                trail.append(float((w * np.arange(low, high)).sum() / w.sum()) if w.sum() > 0 else ahead)
            out[j] = trail[-1]
    return out


def ivgnmd(x, max_modes: int = 2, alpha: float = 1e-4, beta: float = 1e-7, tol: float = 1e-8, max_iter: int = 100, windows: int = 5, reach: int = 3, memory: int = 80):
    """Like ``vgnmd`` for modes that cross: paths are tracked through the plane in their own direction, and each is erased before the next is looked for.

    A path is tracked along time and along frequency; the one that holds more
    energy a cell says whether the mode is a chirp.
    """
    x = np.asarray(x, float)
    e = plane(x, windows)
    bins, n = e.shape
    found = []
    for _ in range(max_modes):
        by_time, by_freq = _track(e, reach, memory), _track(e.T, reach * max(1, n // bins), memory)
        on_time = e[np.clip(np.round(by_time).astype(int), 0, bins - 1), np.arange(n)].mean()
        on_freq = e[np.arange(bins), np.clip(np.round(by_freq).astype(int), 0, n - 1)].mean()
        if max(on_time, on_freq) <= 0:
            break
        if on_time >= on_freq:
            found.append((True, smooth_curve(by_time / (2 * bins), 1e4)))
            e = e * (np.abs(np.arange(bins)[:, None] - by_time[None]) > reach)
        else:
            found.append((False, smooth_curve(np.interp(np.linspace(0, bins - 1, n // 2 + 1), np.arange(bins), by_freq), 1e4)))
            e = e * (np.abs(np.arange(n)[None] - by_freq[:, None]) > reach * max(1, n // bins))
    return _resolve(x, found, alpha, beta, tol, max_iter) if found else (np.zeros((0, n)), [], [])


def first_delay(x: np.ndarray, bins: int = 256) -> np.ndarray:
    """A group delay (samples, by Fourier bin): the plane's strongest path along frequency."""
    path = _track(plane(x, bins=bins).T, 3 * max(1, len(x) // bins), 24)
    return smooth_curve(np.interp(np.linspace(0, bins - 1, len(x) // 2 + 1), np.arange(bins), path), 1e3)


def gdmd(x, K: int = 2, alpha: float = 1.0, beta: float = 1e-3, tol: float = 1e-8, max_iter: int = 300):
    """Dispersed modes: chirps of the spectrum along frequency, whose slope of phase is the group delay (samples); modes, delays, amplitudes."""
    x = np.asarray(x, float)
    n = len(x)
    spectrum = np.fft.rfft(x)
    out = []
    for _ in range(K):
        delay = -first_delay(np.fft.irfft(spectrum, n))
        for wide in (30, 5, 1):
            part, delay, a = chirp.follow(spectrum, delay, n, alpha * wide, beta, tol, max_iter // 3 + 1, real=False)
        out.append((np.fft.irfft(part, n), -delay, a))
        spectrum = spectrum - part
    return tuple(np.array(p) for p in zip(*out, strict=True))


def agncmd(x, max_modes: int = 3, beta: float = 1e-7, tol: float = 1e-8, max_iter: int = 100, stop: float = 1e-3):
    """Dispersed modes one after the other: modes, group delays (samples, by Fourier bin) and bandwidth parameters.

    A first delay is the plane's strongest path along frequency. Turned back by
    it, the mode is a short pulse, whose length sets the band; while following,
    the band narrows as the delay settles.
    """
    rest = np.asarray(x, float).copy()
    n = len(rest)
    power = (rest**2).sum() or 1.0
    modes, delays, bands = [], [], []
    for _ in range(max_modes):
        if (rest**2).sum() < stop * power:
            break
        delay = first_delay(rest)
        spectrum = np.fft.rfft(rest)
        band = []
        for _ in range(4):
            pulse = np.abs(np.fft.irfft(spectrum * np.exp(-1j * chirp._phase(-delay, n)), n)) ** 2
            away = np.minimum(np.arange(n), n - np.arange(n))
            width = np.sqrt((pulse * away**2 * (away < n // 8)).sum() / max((pulse * (away < n // 8)).sum(), 1e-300))
            band.append(min((2 * np.pi * max(width, 1.0) / n) ** 4 * 10, band[-1] if band else 10.0))
            part, found, _ = chirp.follow(spectrum, -delay, n, band[-1], beta, tol, max_iter, real=False)
            delay = -found
        mode = np.fft.irfft(part, n)
        modes.append(mode)
        delays.append(delay)
        bands.append(band)
        rest = rest - mode
    return np.array(modes).reshape(-1, n), np.array(delays), bands


def avncmd(x, initial, fs: float = 1.0, beta: float = 1e-7, tol: float = 1e-8, max_iter: int = 100):
    """Chirp modes together from first frequencies (K, T), with bandwidths learnt from the signal: modes, frequencies, amplitudes.

    A mode's amplitude is a smooth curve in noise. How smooth is learnt as in a
    Bayesian model: the smoothing is the noise's variance over that of the
    amplitude's second differences, both as they stand in each round. Steps of
    the frequencies grow smoother from round to round up to ``beta``.
    """
    x = np.asarray(x, float)
    freq = np.array(initial, float).reshape(-1, np.shape(initial)[-1])
    freq = np.broadcast_to(freq, (len(freq), len(x))).copy()
    modes, amps = np.zeros_like(freq), np.zeros_like(freq)
    strength = np.full(len(freq), 1e4)
    for turn in range(max_iter):
        moved = 0.0
        noise = max(((x - modes.sum(0)) ** 2).mean(), 1e-12 * (x**2).mean())
        for k in range(len(freq)):
            u = chirp.demodulate(x - modes.sum(0) + modes[k], freq[k], fs, strength[k])
            bend = (np.abs(np.diff(u, 2)) ** 2).mean()
            strength[k] = np.clip(2 * noise / max(bend, 1e-300), 1e2, 1e7)
            new = (u * np.exp(1j * chirp._phase(freq[k], fs))).real
            moved += ((new - modes[k]) ** 2).sum()
            modes[k], amps[k] = new, np.abs(u)
            freq[k] = freq[k] + 0.5 * smooth_curve(chirp._slope(u, fs), min(10.0 ** (3 + turn / 4), 1 / beta))
        if moved < tol * max((modes**2).sum(), 1e-300):
            break
    return modes, freq, amps
