"""Decompositions of images and volumes, and further multivariate and adaptive kernels."""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels import chirp, sifting, variational
from modeloom.operators.kernels.numeric import analytic, extrema, smooth_curve


def neighbours(a: np.ndarray, pick) -> np.ndarray:
    """``pick`` (np.maximum or np.minimum) over each cell and its adjacent ones, along all axes; borders repeat."""
    out = a
    for axis in range(a.ndim):
        wide = np.concatenate([np.take(out, [0], axis), out, np.take(out, [-1], axis)], axis)
        cut = [np.take(wide, range(s, s + a.shape[axis]), axis) for s in range(3)]
        out = pick(pick(cut[0], cut[1]), cut[2])
    return out


def field_extrema(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of cells not below, and not above, their neighbours; constant fields have none."""
    if a.max() == a.min():
        return np.zeros(a.shape, bool), np.zeros(a.shape, bool)
    return a >= neighbours(a, np.maximum), a <= neighbours(a, np.minimum)


def spacing(mask: np.ndarray) -> float | None:
    """The median distance of a marked cell to its nearest other one."""
    p = np.argwhere(mask).astype(float)
    if len(p) < 2:
        return None
    best = np.full(len(p), np.inf)
    for at in range(0, len(p), 512):
        d = ((p[at : at + 512, None] - p[None]) ** 2).sum(2)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        best[at : at + 512] = d.min(1)
    return float(np.sqrt(np.median(best)))


def _slide(a: np.ndarray, size: int, how) -> np.ndarray:
    out = a
    half = size // 2
    for axis in range(a.ndim):
        h = min(half, a.shape[axis] - 1)
        pad = [(0, 0)] * a.ndim
        pad[axis] = (h, h)
        view = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="symmetric"), 2 * h + 1, axis)
        out = how(view, -1)
    return out


def faemd_field(a, max_imfs: int = 3, tol: float = 0.05, max_iter: int = 20):
    """Fast adaptive EMD of an image or volume: order-statistic envelopes as wide as the spacing of extrema; modes and residue, summing to it."""
    rest = np.asarray(a, float)
    out = []
    while len(out) < max_imfs:
        tops, dips = field_extrema(rest)
        gaps = [g for g in (spacing(tops), spacing(dips)) if g]
        if not gaps:
            break
        size = max(3, int(round(max(gaps))) | 1)
        h = rest
        for n in range(max_iter):
            mean = _slide((_slide(h, size, np.max) + _slide(h, size, np.min)) / 2, size, np.mean)
            h = h - mean
            if n and (mean**2).mean() < tol * max((h**2).mean(), 1e-300):
                break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def surface(points: np.ndarray, values: np.ndarray, shape: tuple[int, int], neighbours_: int = 12) -> np.ndarray:
    """A smooth surface through scattered points: inverse-distance weights of the nearest, so no point is missed."""
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1).reshape(-1, len(shape)).astype(float)
    out = np.empty(len(grid))
    k = min(neighbours_, len(points))
    for at in range(0, len(grid), 2048):
        d = ((grid[at : at + 2048, None] - points[None]) ** 2).sum(2)
        i = np.argpartition(d, k - 1, axis=1)[:, :k]
        w = 1 / (np.take_along_axis(d, i, 1) + 1e-9)
        out[at : at + 2048] = (w * values[i]).sum(1) / w.sum(1)
    return out.reshape(shape)


def emd2d(image, max_imfs: int = 3, tol: float = 0.01, max_iter: int = 10):
    """Image EMD: the mean of surfaces through maxima and through minima goes until it is small; modes and residue, summing to the image."""
    rest = np.asarray(image, float)
    power = (rest**2).mean() or 1.0
    out = []
    while len(out) < max_imfs:
        h, done = rest, False
        for _ in range(max_iter):
            tops, dips = field_extrema(h)
            if tops.sum() < 4 or dips.sum() < 4:
                break
            up = surface(np.argwhere(tops).astype(float), h[tops], h.shape)
            low = surface(np.argwhere(dips).astype(float), h[dips], h.shape)
            mean = sifting_smooth((up + low) / 2)
            h, done = h - mean, True
            if (mean**2).mean() < tol * power:
                break
        if not done:
            break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def sifting_smooth(a: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Smooths a surface's facets along both axes."""
    rows = np.array([smooth_curve(r, strength) for r in a])
    return np.array([smooth_curve(c, strength) for c in rows.T]).T


def bmemd(stack, n_dir: int = 8, max_imfs: int = 3, max_iter: int = 8):
    """EMD of an image stack (C, H, W): surfaces through the extrema of projections, averaged over directions; (K, C, H, W), summing to the stack."""
    rest = np.asarray(stack, float)
    out = []
    while len(out) < max_imfs:
        h, done = rest, False
        for _ in range(max_iter):
            mean, seen = np.zeros_like(h), 0
            for d in sifting.directions(n_dir, len(h)):
                p = np.tensordot(d, h, 1)
                tops, dips = field_extrema(p)
                if tops.sum() < 4 or dips.sum() < 4:
                    continue
                for mask in (tops, dips):
                    at = np.argwhere(mask).astype(float)
                    mean += np.array([surface(at, c[mask], c.shape) for c in h]) / 2
                seen += 1
            if not seen:
                break
            mean /= seen
            h, done = h - mean, True
            if (mean**2).mean() < 0.01 * max((h**2).mean(), 1e-300):
                break
        if not done:
            break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def fuse(images: np.ndarray, window: int = 5) -> np.ndarray:
    """One image from several, each pixel weighed by its local variance."""
    images = np.asarray(images, float)
    weight = np.array([(a - _slide(a, window, np.mean)) ** 2 for a in images]) + 1e-12
    return (images * weight).sum(0) / weight.sum(0)


def cvmd2d(image, K: int = 3, alpha: float = 1000.0, threshold: float = 0.5, **params):
    """Image modes with compact supports: each pixel belongs to the modes whose smoothed local energy is near the largest; (modes, supports)."""
    modes, centres = variational.vmd2d(image, K, alpha, **params)
    energy = np.array([_slide(m**2, 7, np.mean) for m in modes])
    support = energy >= threshold * energy.max(0, keepdims=True)
    return modes * support, support, centres


def nstemd(x, n_dir: int = 32, **params):
    """Multivariate EMD whose directions follow the ellipsoid of the channels' covariance, beside the uniform ones."""
    x = np.asarray(x, float)
    values, vectors = np.linalg.eigh(np.cov(x))
    axes = vectors * np.sqrt(np.maximum(values, 1e-12))
    scale = np.linalg.pinv(axes)
    # in coordinates where the cloud is round, uniform directions are the ellipsoid's
    modes = sifting.memd(scale @ x, n_dir, **params)
    return np.einsum("ij,kjt->kit", axes, modes)


def tvf_emd(x, bandwidth: float = 0.1, max_imfs: int = 6, max_iter: int = 30, min_extrema: int = 4):
    """EMD by a time-varying low-pass: its cut-off bisects the frequencies of the strongest and the next part at every time; stops when a mode is narrow."""
    rest = np.asarray(x, float)
    n = len(rest)
    out = []

    def cutoff(h: np.ndarray) -> np.ndarray | None:
        k = np.sort(np.concatenate(extrema(h)))
        if len(k) < min_extrema:
            return None
        rate = 0.5 / np.maximum(np.diff(k), 1)
        local = np.interp(np.arange(n), (k[1:] + k[:-1]) / 2, rate)
        return 0.6 * smooth_curve(local, float((0.5 / rate.mean()) ** 4))

    def low_pass(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
        # between filters of a few fixed cut-offs the output follows the wanted one
        levels = np.geomspace(max(cut.min(), 1 / n), max(cut.max(), 1.01 * cut.min(), 1.01 / n), 8)
        half = n // 2
        wide = np.concatenate([h[:half][::-1], h, h[n - half :][::-1]])
        f, freq = np.fft.rfft(wide), np.fft.rfftfreq(len(wide))
        bank = np.array([np.fft.irfft(f / (1 + (freq / c) ** 12), len(wide))[half : half + n] for c in levels])
        at = np.interp(np.log(np.maximum(cut, levels[0])), np.log(levels), np.arange(8))
        i = np.minimum(at.astype(int), 6)
        w = at - i
        cols = np.arange(n)
        return bank[i, cols] * (1 - w) + bank[i + 1, cols] * w

    while len(out) < max_imfs:
        h, done = rest.copy(), False
        for _ in range(max_iter):
            cut = cutoff(h)
            if cut is None:
                break
            mean = low_pass(h, np.abs(cut))
            h, done = h - mean, True
            a = analytic(h)
            step = np.abs(np.angle(a[1:] * np.conj(a[:-1])))
            power = np.abs(a[1:]) ** 2
            centre = (step * power).sum() / max(power.sum(), 1e-300)
            spread = np.sqrt(((step - centre) ** 2 * power).sum() / max(power.sum(), 1e-300))
            if spread < bandwidth * centre or (mean**2).sum() < 1e-6 * (h**2).sum():
                break
        if not done:
            break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def sjmd(x, max_modes: int = 6, alpha: float = 5000.0, gain: float = 0.5, **params):
    """Jump and modes, one more mode at a time: modes (K, T), jump part, centres.

    Each round solves for the jump part and all modes so far together; when
    another mode leaves more than ``gain`` of what was left without it, the
    round before stands.
    """
    x = np.asarray(x, float)
    best, left = None, np.inf
    for k in range(1, max_modes + 1):
        modes, jump, centres = variational.jmd(x, K=k, alpha=alpha, **params)
        n = modes.shape[-1]
        now = ((x[:n] - modes.sum(0) - jump[:n]) ** 2).sum()
        if best is not None and now > gain * left:
            break
        best, left = (modes, jump, centres), now
    return best


def ba_acmd(x, fs: float = 1.0, stop_corr: float = 0.3, max_modes: int = 6, alpha: float = 1e-5, beta: float = 1e-7):
    """Chirp modes whose bandwidth follows the band that holds the strongest peak; stops when a mode hardly resembles the signal."""
    x = np.asarray(x, float)
    rest, out = x.copy(), []
    for _ in range(max_modes):
        p = np.abs(np.fft.rfft(rest))
        p[0] = 0
        k = int(np.argmax(p))
        level = 0.1 * p[k]
        lo = k - int(np.argmax(p[k::-1] < level)) if (p[k::-1] < level).any() else 0
        hi = k + int(np.argmax(p[k:] < level)) if (p[k:] < level).any() else len(p) - 1
        share = max(hi - lo, 2) / len(x)
        mode, freq, amp = chirp.follow(rest, np.full(len(x), k * fs / len(x)), fs, min(1.0, (2 * np.pi * share) ** 4 * 10), beta, 1e-8, 100)
        mode, freq, amp = chirp.follow(rest, freq, fs, alpha, beta, 1e-8, 100)
        if not out or abs(np.corrcoef(mode, x)[0, 1]) >= stop_corr:
            out.append((mode, freq, amp))
            rest = rest - mode
        else:
            break
    return tuple(np.array(p) for p in zip(*out, strict=True))


def dd_acmd(x, fs: float = 1.0, K: int = 5, energy_stop: float = 0.01, alpha: float = 1e-5, beta: float = 1e-7):
    """The trend first (a mode of frequency 0), then chirp modes from the demodulated data's own frequency, until little energy is left."""
    x = np.asarray(x, float)
    trend = smooth_curve(x, 1 / alpha)
    modes, freq, amp = chirp.acmd(x - trend, K, fs, alpha, beta, energy_stop=energy_stop)
    return np.array([trend, *modes]), np.array([np.zeros(len(x)), *freq]), np.array([np.abs(trend), *amp])


def stnbmd(x, frequencies, fs: float = 1.0, schedule=((1e2, 20), (1e3, 50), (1e4, 100))):
    """Narrow-band modes about given frequencies: amplitude and phase are smoothed together, ever more strongly; complex (K, T)."""
    x = analytic(np.asarray(x, float))
    n, k = len(x), len(frequencies)
    phase = np.array([2 * np.pi * f * np.arange(n) / fs for f in frequencies])
    modes = np.zeros((k, n), complex)
    for strength, rounds in schedule:
        for _ in range(rounds):
            before = modes.copy()
            for i in range(k):
                u = (x - modes.sum(0) + modes[i]) * np.exp(-1j * phase[i])
                u = smooth_curve(u.real, strength) + 1j * smooth_curve(u.imag, strength)
                turn = smooth_curve(np.unwrap(np.angle(u)), strength)
                phase[i] = phase[i] + 0.5 * turn
                modes[i] = u * np.exp(1j * (phase[i] - 0.5 * turn))
            if (np.abs(modes - before) ** 2).sum() < 1e-8 * max((np.abs(modes) ** 2).sum(), 1e-300):
                break
    return modes, np.gradient(phase, axis=1) * fs / (2 * np.pi)


def apmd(x, n_modes: int = 5, share: float = 0.05):
    """Polymorphic modes: each is the part of the short-time map about its strongest ridge, along time or along frequency, whichever holds more; rows sum to the signal."""
    x = np.asarray(x, float)
    n = len(x)
    size = 1 << max(4, int(np.log2(np.sqrt(n) * 2)))
    window = np.hanning(size + 1)[:-1]
    rest, out = x.copy(), []
    total = (x**2).sum() or 1.0
    for _ in range(n_modes - 1):
        wide = np.pad(rest, size // 2, mode="reflect")
        f = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wide, size)[:n] * window, axis=1)
        e = np.abs(f) ** 2
        if (rest**2).sum() < share * total:
            break
        rows = np.argmax(e, axis=1)
        along_time = np.abs(np.arange(e.shape[1])[None] - rows[:, None]) <= 2
        reach = size // 4
        t0 = int(np.argmax(e.sum(1)))
        along_freq = np.broadcast_to((np.abs(np.arange(n) - t0) <= reach)[:, None], e.shape)
        # a ridge along time holds more if its energy a cell is larger
        mask = along_time if e[along_time].mean() >= e[along_freq].mean() else along_freq
        part = np.fft.irfft(f * mask, size, axis=1)
        sums, weight = np.zeros(n + size), np.zeros(n + size)
        for j in range(size):
            sums[j : j + n] += part[:, j]
            weight[j : j + n] += window[j]
        mode = (sums / np.maximum(weight, 1e-9))[size // 2 : size // 2 + n]
        out.append(mode)
        rest = rest - mode
    return np.array([*out, rest])


def vtfmtd(x, omega, window: int = 61, alpha: float = 1e-5, rounds: int = 20):
    """Modes of the short-time Fourier map about tracked frequencies (shares of the sampling rate): each column is shared out by nearness to the centroids."""
    x = np.asarray(x, float)
    n, k = len(x), len(omega)
    w = np.hanning(window + 2)[1:-1]
    wide = np.pad(x, window // 2, mode="reflect")
    size = 1 << int(np.ceil(np.log2(4 * window)))
    f = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wide, window)[:n] * w, size, axis=1)
    freq = np.fft.rfftfreq(size)
    track = np.broadcast_to(np.asarray(omega, float).reshape(k, -1), (k, n)).copy()
    gains = np.zeros((k, *f.shape))
    for _ in range(rounds):
        near = 1 / (1 + (freq[None, None] - track[:, :, None]) ** 2 / max(alpha, 1e-12))
        gains = near / near.sum(0, keepdims=True)
        p = np.abs(f)[None] ** 2 * gains**2
        moved = (p @ freq) / np.maximum(p.sum(2), 1e-300)
        moved = np.array([smooth_curve(m, 1e3) for m in moved])
        done = np.abs(moved - track).max() < 1e-6
        track = moved
        if done:
            break
    # the middle sample of each window's share
    middle = np.exp(2j * np.pi * freq * (window // 2))
    scale = np.where((freq == 0) | (freq == 0.5), 1.0, 2.0) / size / w[window // 2]
    return np.array([((f * g) * middle * scale).sum(1).real for g in gains]), track
