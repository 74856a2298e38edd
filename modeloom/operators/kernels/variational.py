"""Variational decompositions in the Fourier domain (alternating directions)."""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels.numeric import savgol


def _spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """One-sided spectrum of a signal with half of it reflected at either end, its frequencies, and the reflected length."""
    half = x.shape[-1] // 2
    wide = np.concatenate([x[..., :half][..., ::-1], x, x[..., x.shape[-1] - half :][..., ::-1]], axis=-1)
    return np.fft.rfft(wide, axis=-1), np.fft.rfftfreq(wide.shape[-1]), half


def _signal(u: np.ndarray, half: int, n: int) -> np.ndarray:
    return np.fft.irfft(u, n + 2 * half, axis=-1)[..., half : half + n]


def _centres(count: int, init: str, seed: int, dc: bool, limit: float = 0.5) -> np.ndarray:
    if init == "uniform":
        w = limit * np.arange(count) / count
    elif init == "random":
        w = np.sort(np.exp(np.log(1 / 1000) + np.log(500) * np.random.default_rng(seed).random(count)))
    else:
        w = np.zeros(count)
    if dc:
        w[0] = 0
    return w


def mvmd(x, alpha: float = 2000.0, K: int = 3, tau: float = 0.0, init: str = "uniform", dc: bool = False, tol: float = 1e-7, max_iter: int = 500, seed: int = 42):
    """Variational modes of (C, T) with centre frequencies that channels share: (K, C, T), centres, rounds."""
    x = np.atleast_2d(np.asarray(x, float))
    f, freq, half = _spectrum(x)
    u = np.zeros((K, *f.shape), complex)
    w = _centres(K, init, seed, dc)
    dual = np.zeros_like(f)
    total = u.sum(0)
    power = max((np.abs(f) ** 2).sum(), 1e-300)
    for rounds in range(1, max_iter + 1):
        moved = 0.0
        for k in range(K):
            new = (f - (total - u[k]) + dual / 2) / (1 + alpha * (freq - w[k]) ** 2)
            total = total - u[k] + new
            moved += (np.abs(new - u[k]) ** 2).sum()
            u[k] = new
            if not (dc and k == 0):
                p = (np.abs(new) ** 2).sum(0)
                w[k] = (freq * p).sum() / max(p.sum(), 1e-300)
        dual = dual + tau * (f - total)
        if moved / power < tol:
            break
    order = np.argsort(w, kind="stable")
    return _signal(u[order], half, x.shape[1]), w[order], rounds


def vmd(x, alpha: float = 2000.0, K: int = 3, **params):
    """Variational mode decomposition: modes (K, T) in the order of their centre frequencies, and these (cycles a sample)."""
    modes, w, _ = mvmd(x, alpha, K, **params)
    return modes[:, 0], w


def vme(x, alpha: float = 20000.0, omega: float = 0.0, fs: float = 1.0, tau: float = 0.0, tol: float = 1e-7, max_iter: int = 300):
    """The mode nearest to ``omega`` (Hz): compact about its centre, against a rest that is filtered away from it."""
    x = np.asarray(x, float)
    f, freq, half = _spectrum(x)
    w = omega / fs
    u, dual = np.zeros_like(f), np.zeros_like(f)
    for _ in range(max_iter):
        d = alpha * (freq - w) ** 2
        new = (f + u * d * d + dual / 2) / ((1 + d * d) * (1 + 2 * d))
        p = np.abs(new) ** 2
        w = (freq * p).sum() / max(p.sum(), 1e-300)
        rest = d * d * (f - new) / (1 + d * d)
        dual = dual + tau * (f - new - rest)
        change = (np.abs(new - u) ** 2).sum() / max((np.abs(u) ** 2).sum(), 1e-300)
        u = new
        if change < tol:
            break
    return _signal(u, half, len(x)), w * fs


def ovmd(x, alpha: float = 100.0, K: int = 5, tau: float = 0.0, tol: float = 1e-6, max_iter: int = 500):
    """VMD whose bandwidth grows with frequency and whose modes are made orthogonal where they overlap; in order of energy."""
    x = np.asarray(x, float)
    f, freq, half = _spectrum(x)
    # the highest peaks of the spectrum are the first centres
    size = np.abs(f)
    peaks = np.flatnonzero((size[1:-1] > size[:-2]) & (size[1:-1] >= size[2:])) + 1
    near: list[float] = []
    for i in peaks[np.argsort(-size[peaks], kind="stable")]:
        if len(near) < K and all(abs(freq[i] - c) > 4 / len(x) for c in near):
            near.append(float(freq[i]))
    w = np.array([*near, *(0.5 * (k + 0.5) / K for k in range(len(near), K))])
    u = np.zeros((K, len(f)), complex)
    dual = np.zeros_like(f)
    for _ in range(max_iter):
        moved = 0.0
        for k in range(K):
            new = (f - u.sum(0) + u[k] + dual / 2) / (1 + 100 * alpha / max(w[k], 1e-3) * (freq - w[k]) ** 2)
            for j in range(K):
                # what another mode already has along this one goes
                if j != k and (e := (np.abs(u[j]) ** 2).sum()) > 0 and abs(w[j] - w[k]) < 1e-3:
                    new = new - (np.vdot(u[j], new) / e) * u[j]
            p = np.abs(new) ** 2
            if p.sum() > 0:
                w[k] = (freq * p).sum() / p.sum()
            moved += (np.abs(new - u[k]) ** 2).sum()
            u[k] = new
        dual = dual + tau * (f - u.sum(0))
        if moved < tol * (np.abs(f) ** 2).sum():
            break
    modes = _signal(u, half, len(x))
    order = np.argsort(-(modes**2).sum(1), kind="stable")
    return modes[order], w[order]


def svmd(x, max_alpha: float = 20000.0, tau: float = 0.0, tol: float = 1e-6, stop: int = 4, max_modes: int = 12, max_iter: int = 200):
    """Modes one after the other; each is kept off those found. Stops (4) when a mode adds little power, (1) at the noise level, (2) at a small rest."""
    x = np.asarray(x, float)
    f, freq, half = _spectrum(x)
    size = min(25, (len(x) - 1) | 1)
    noise = ((x - savgol(x, size, 8)) ** 2).mean() if len(x) > 25 else 0.0
    found: list[np.ndarray] = []
    centres: list[float] = []
    rest = f.copy()
    power = max((np.abs(f) ** 2).sum(), 1e-300)
    while len(found) < max_modes:
        u, dual = np.zeros_like(f), np.zeros_like(f)
        w = float(freq[np.argmax(np.abs(rest))])
        alpha = 10.0
        while True:
            for _ in range(max_iter):
                d = alpha * (freq - w) ** 2
                away = sum((1 / (1e-12 + (alpha * (freq - c) ** 2) ** 2 + 1) for c in centres), np.zeros(len(freq)))
                new = (rest + d * d * u + dual / 2) / ((1 + d * d) * (1 + 2 * d + away))
                p = np.abs(new) ** 2
                w = (freq * p).sum() / max(p.sum(), 1e-300)
                dual = dual + tau * (rest - new)
                change = (np.abs(new - u) ** 2).sum() / max((np.abs(u) ** 2).sum(), 1e-300)
                u = new
                if change < tol:
                    break
            if alpha >= max_alpha:
                break
            alpha = min(max_alpha, alpha * np.e)
        gained = (np.abs(u) ** 2).sum() / power
        if stop == 4 and found and gained < 0.001:
            break
        found.append(u)
        centres.append(w)
        rest = rest - u
        left = (_signal(rest, half, len(x)) ** 2).mean()
        if (stop == 1 and left <= noise) or (stop == 2 and left < 0.005 * (x**2).mean()) or gained < 1e-9:
            break
    order = np.argsort(centres, kind="stable")
    return _signal(np.array(found), half, len(x))[order], np.array(centres)[order]


def stvmd(x, K: int = 3, alpha: float = 50.0, n_fft: int = 64, tau: float = 1e-5, tol: float = 1e-9, max_iter: int = 300, dynamic: bool = False):
    """VMD of every short-time spectrum at once; centre frequencies are shared by the frames, or each frame's own if ``dynamic``."""
    x = np.atleast_2d(np.asarray(x, float))
    c, n = x.shape
    half = n_fft // 2
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    wide = np.pad(x, ((0, 0), (half, half)), mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(wide, n_fft, axis=1)[:, :n]
    f = np.fft.rfft(frames * window, axis=2)
    freq = np.fft.rfftfreq(n_fft)
    u = np.zeros((K, *f.shape), complex)
    w = np.repeat((0.5 * (np.arange(K) + 0.5) / K)[:, None], n, axis=1)
    dual = np.zeros_like(f)
    power = max((np.abs(f) ** 2).sum(), 1e-300)
    total = u.sum(0)
    for _ in range(max_iter):
        moved = 0.0
        for k in range(K):
            new = (f - total + u[k] + dual / 2) / (1 + alpha * n_fft * (freq - w[k][:, None]) ** 2)
            total = total - u[k] + new
            moved += (np.abs(new - u[k]) ** 2).sum()
            u[k] = new
            p = (np.abs(new) ** 2).sum(0)
            if dynamic:
                w[k] = (p @ freq) / np.maximum(p.sum(1), 1e-300)
            else:
                w[k] = (p.sum(0) @ freq) / max(p.sum(), 1e-300)
        dual = dual + tau * (f - total)
        if moved / power < tol:
            break
    back = np.fft.irfft(u, n_fft, axis=3)
    out, weight = np.zeros((K, c, n + n_fft)), np.zeros(n + n_fft)
    for j in range(n_fft):
        out[:, :, j : j + n] += back[..., j] * window[j]
        weight[j : j + n] += window[j] ** 2
    modes = (out / np.maximum(weight, 1e-12))[:, :, half : half + n]
    order = np.argsort(w.mean(1), kind="stable")
    return (modes[order, 0] if c == 1 else modes[order]), w[order]


def _jump_rows(n: int) -> np.ndarray:
    return np.diff(np.eye(n), axis=0)


def jmd(x, K: int = 2, alpha: float = 5000.0, beta: float = 0.01, jump: float = 0.45, tau: float = 5.0, tol: float = 1e-6, max_iter: int = 500):
    """Oscillating modes beside a piecewise constant part: (modes, jump part, centres); (C, T) shares centres.

    Differences of the jump part are shrunk by a minimax concave rule: below a
    threshold to nothing, from ``jump`` on not at all.
    """
    x = np.atleast_2d(np.asarray(x, float))
    c, n = x.shape
    scale = max(np.abs(x).max(), 1e-12)
    y = x / scale
    w = _centres(K, "uniform", 0, False) + 0.25 / K
    v, d = np.zeros_like(y), np.zeros((c, n - 1))
    dual = np.zeros((c, n - 1))
    # the penalty grows with the length, as does what a plateau gains; twice the threshold is a free jump
    strength = beta * n / (0.8 * tau)
    rho = 2 * strength / jump
    # (I + rho D'D) is diagonal under the cosine transform of the mirrored part
    gain = 1 / (1 + rho * (2 - 2 * np.cos(np.pi * np.arange(n + 1) / n)))
    u = None
    for _ in range(max_iter):
        f, freq, half = _spectrum(y - v)
        if u is None:
            u = np.zeros((K, *f.shape), complex)
        moved = 0.0
        for k in range(K):
            new = (f - u.sum(0) + u[k]) / (1 + alpha * (freq - w[k]) ** 2)
            moved += (np.abs(new - u[k]) ** 2).sum()
            u[k] = new
            p = (np.abs(new) ** 2).sum(0)
            w[k] = (freq * p).sum() / max(p.sum(), 1e-300)
        rest = y - _signal(u.sum(0), half, n)
        # jump part: close to the rest, with the shrunk differences
        target = d - dual
        rhs = rest.copy()
        rhs[:, :-1] -= rho * target
        rhs[:, 1:] += rho * target
        wide = np.concatenate([rhs, rhs[:, ::-1]], axis=1)
        v_new = np.fft.irfft(np.fft.rfft(wide, axis=1) * gain, 2 * n, axis=1)[:, :n]
        z = np.diff(v_new, axis=1) + dual
        level = jump / 2
        size = np.abs(z)
        firm = np.maximum(size - level, 0) * jump / max(jump - level, 1e-9)
        d = np.where(size <= level, 0.0, np.where(size >= jump, z, np.sign(z) * firm))
        dual = z - d
        moved += ((v_new - v) ** 2).sum()
        v = v_new
        if moved < tol * max((np.abs(f) ** 2).sum(), 1e-300):
            break
    modes = _signal(u, half, n) * scale
    order = np.argsort(w, kind="stable")
    return (modes[order, 0], v[0] * scale, w[order]) if c == 1 else (modes[order], v * scale, w[order])


def vmd2d(image, K: int = 3, alpha: float = 1000.0, tau: float = 0.0, tol: float = 1e-7, max_iter: int = 300, dc: bool = False):
    """Variational modes of an image (K, H, W) with centres (K, 2) in the upper half plane."""
    f = np.fft.fft2(np.asarray(image, float))
    h, w = f.shape
    fy, fx = np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None]
    radius, angle = 0.5 * (np.arange(K) + 1) / (2 * K), np.pi * np.arange(K) / K
    centre = np.stack([radius * np.sin(angle), radius * np.cos(angle)], axis=1)
    if dc:
        centre[0] = 0
    u, dual = np.zeros((K, h, w), complex), np.zeros_like(f)
    for _ in range(max_iter):
        moved = 0.0
        for k in range(K):
            cy, cx = centre[k]
            side = (fy * cy + fx * cx >= 0) * 2.0 if not (dc and k == 0) else 1.0
            dist = (fy - cy) ** 2 + (fx - cx) ** 2
            ahead = (f - u.sum(0) + u[k] + dual / 2) * side / (1 + alpha * dist)
            # the mode is real: its other half plane mirrors this one
            new = np.fft.fft2(np.fft.ifft2(ahead).real)
            moved += (np.abs(new - u[k]) ** 2).sum()
            u[k] = new
            if not (dc and k == 0):
                p = np.abs(ahead) ** 2
                c = np.array([(fy * p).sum(), (fx * p).sum()]) / max(p.sum(), 1e-300)
                centre[k] = c if c[0] >= 0 else -c
        dual = dual + tau * (f - u.sum(0))
        if moved < tol * (np.abs(f) ** 2).sum():
            break
    return np.fft.ifft2(u).real, centre
