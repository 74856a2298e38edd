"""Sifting decompositions: EMD and its relatives, LMD, ITD, filters.

A kernel takes a signal and returns its modes as rows; the last row is the
residue, so that the rows sum to the signal.
"""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels.numeric import SPLINES, analytic, cubic_spline, extrema, zero_crossings


def mirrored_knots(x: np.ndarray, tops: np.ndarray, dips: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times and values of maxima and minima, with ``count`` of each reflected beyond either end.

    At an end whose sample lies beyond the nearest extremum of the other kind,
    that sample counts as one itself and is the axis; else the nearest extremum is.
    """

    def side(values: np.ndarray, high: np.ndarray, low: np.ndarray):
        flip = high[0] > low[0]
        lead, other, v = (low, high, -values) if flip else (high, low, values)
        # lead: the kind that comes first, seen as maxima
        if v[0] > v[other[0]]:
            axis, more_lead, more_other = lead[0], lead[1 : count + 1], other[:count]
        else:
            axis, more_lead, more_other = 0, lead[:count], np.r_[0, other[: count - 1]]
        pair = (2 * axis - more_lead[::-1], more_lead[::-1]), (2 * axis - more_other[::-1], more_other[::-1])
        if not len(more_lead) or not len(more_other) or pair[0][0][0] > 0 or pair[1][0][0] > 0:
            pair = (-lead[:count][::-1], lead[:count][::-1]), (-other[:count][::-1], other[:count][::-1])
        return pair[::-1] if flip else pair

    n = len(x)
    (lt, lv), (ldt, ldv) = side(x, tops, dips)
    (rt, rv), (rdt, rdv) = side(x[::-1], n - 1 - tops[::-1], n - 1 - dips[::-1])
    top_t = np.r_[lt, tops, (n - 1 - rt)[::-1]]
    top_v = np.r_[x[lv], x[tops], x[::-1][rv][::-1]]
    dip_t = np.r_[ldt, dips, (n - 1 - rdt)[::-1]]
    dip_v = np.r_[x[ldv], x[dips], x[::-1][rdv][::-1]]
    top_t, i = np.unique(top_t, return_index=True)
    dip_t, j = np.unique(dip_t, return_index=True)
    return top_t, top_v[i], dip_t, dip_v[j]


def envelopes(x: np.ndarray, spline: str = "cubic", mirror: int = 2) -> tuple[np.ndarray, np.ndarray] | None:
    """Upper and lower envelopes; none if there are too few extrema."""
    tops, dips = extrema(x)
    if not len(tops) or not len(dips) or len(tops) + len(dips) < 3:
        return None
    tt, tv, dt, dv = mirrored_knots(x, tops, dips, mirror)
    at = np.arange(len(x))
    return SPLINES[spline](tt.astype(float), tv, at), SPLINES[spline](dt.astype(float), dv, at)


def is_mode(new: np.ndarray, old: np.ndarray, std_thr: float, svar_thr: float, energy_thr: float) -> bool:
    """Whether maxima are positive, minima negative, and the last sift hardly changed anything."""
    tops, dips = extrema(new)
    if (new[tops] < 0).any() or (new[dips] > 0).any():
        return False
    if (new**2).sum() < 1e-10:
        return False
    change = new - old
    spread = np.ptp(old)
    if spread and (change**2).sum() / spread / len(new) < svar_thr:
        return True
    with np.errstate(divide="ignore", invalid="ignore"):
        if np.nansum((change / new) ** 2) < std_thr:
            return True
    return (change**2).sum() / max((old**2).sum(), 1e-300) < energy_thr


def emd(x, spline: str = "cubic", mirror: int = 2, max_imfs: int = -1, max_iter: int = 1000, std_thr: float = 0.2, svar_thr: float = 0.001, energy_thr: float = 0.2, range_thr: float = 0.001, power_thr: float = 0.005, fixed: int = 0):
    """Empirical mode decomposition; ``fixed`` sifts each mode that often."""
    x = np.asarray(x, float)
    out, rest = [], x.copy()
    while max_imfs < 0 or len(out) < max_imfs:
        h = rest.copy()
        sifted = False
        for n in range(fixed or max_iter):
            env = envelopes(h, spline, mirror)
            if env is None:
                break
            old, h = h, h - (env[0] + env[1]) / 2
            sifted = True
            if fixed:
                continue
            tops, dips = extrema(h)
            if abs(len(tops) + len(dips) - zero_crossings(h)) <= 1 and is_mode(h, old, std_thr, svar_thr, energy_thr):
                break
        if not sifted:
            break
        out.append(h)
        rest = rest - h
        if np.ptp(rest) < range_thr or np.abs(rest).sum() < power_thr:
            break
    return np.array([*out, rest])


def ensemble_noise(size: int, trial: int, width: float, seed: int, kind: str = "normal") -> np.ndarray:
    rng = np.random.default_rng([seed, trial])
    return rng.normal(0, width, size) if kind == "normal" else rng.uniform(-width / 2, width / 2, size)


def emd_trial(x, trial: int, noise_width: float = 0.05, seed: int = 42, noise_kind: str = "normal", **params):
    """EMD of the signal with the trial's own noise, its width a share of the signal's range."""
    x = np.asarray(x, float)
    return emd(x + ensemble_noise(len(x), trial, noise_width * np.ptp(x), seed, noise_kind), **params)


def ceemdan(x, trials: int = 20, epsilon: float = 0.005, seed: int = 42, max_imfs: int = -1, range_thr: float = 0.01, power_thr: float = 0.05, **params):
    """Each mode is what the mean of local means over noisy copies leaves; stage k adds the k-th mode of the noises."""
    x = np.asarray(x, float)
    scale = x.std() or 1.0
    s = x / scale
    noises = [emd(ensemble_noise(len(x), k, 1.0, seed), **params) for k in range(trials)]
    noises = [m / (m[0].std() or 1.0) for m in noises]

    def mean_of_locals(y: np.ndarray, stage: int) -> np.ndarray:
        total = np.zeros(len(y))
        for m in noises:
            noisy = y + epsilon * (y.std() if stage else 1.0) * m[stage] if stage < len(m) - 1 else y
            parts = emd(noisy, max_imfs=1, **params)
            total += noisy - parts[0] if len(parts) > 1 else noisy
        return total / trials

    out, rest = [], s
    while max_imfs < 0 or len(out) < max_imfs:
        if envelopes(rest) is None or np.ptp(rest) < range_thr or np.abs(rest).sum() < power_thr:
            break
        lower = mean_of_locals(rest, len(out))
        out.append(rest - lower)
        rest = lower
        if len(out) > 2 * np.log2(len(x)) + 4:
            break
    return np.array([*out, rest]) * scale


def _excess_kurtosis(x: np.ndarray) -> float:
    c = x - x.mean()
    v = (c**2).mean()
    return (c**4).mean() / v**2 - 3 if v > 0 else 0.0


def remd(x, max_imfs: int = 10, max_iter: int = 30, energy_stop: float = 0.001, spline: str = "cubic"):
    """EMD whose number of sifts is the one at which the local mean's size and kurtosis are least."""
    x = np.asarray(x, float)
    out, rest = [], x.copy()
    power = (x**2).sum() or 1.0
    while len(out) < max_imfs:
        h, best, best_cost, costs = rest.copy(), None, np.inf, []
        for _ in range(max_iter):
            env = envelopes(h, spline)
            if env is None:
                break
            mean = (env[0] + env[1]) / 2
            h = h - mean
            cost = float(np.sqrt((mean**2).mean()) + abs(_excess_kurtosis(mean)))
            if cost < best_cost:
                best, best_cost = h.copy(), cost
            costs.append(cost)
            tops, dips = extrema(h)
            if len(costs) > 3 and costs[-1] >= costs[-2] >= costs[-3] and abs(zero_crossings(h) - len(tops) - len(dips)) <= 1:
                break
        if best is None:
            break
        out.append(best)
        rest = rest - best
        if (rest**2).sum() / power < energy_stop or sum(map(len, extrema(rest))) < 3:
            break
    return np.array([*out, rest])


def esmd(x, n_curves: int = 2, min_sift: int = 1, max_sift: int = 40, min_extrema: int = 4, eps_ratio: float = 0.001, max_imfs: int = 20, optimize_sift: bool = True):
    """Extreme-point symmetric modes: the mean of ``n_curves`` curves through the midpoints of neighbouring extrema goes.

    The number of sifts is the one whose residue best keeps the signal's trend.
    """
    x = np.asarray(x, float)
    at = np.arange(len(x))

    def mean_curve(h: np.ndarray) -> np.ndarray | None:
        knots = np.sort(np.concatenate(extrema(h)))
        if len(knots) < min_extrema:
            return None
        t, v = (knots[1:] + knots[:-1]) / 2, (h[knots[1:]] + h[knots[:-1]]) / 2
        # border midpoints continue the first and last slopes' values
        t, v = np.r_[min(0, t[0] - 1), t, max(len(h) - 1, t[-1] + 1)], np.r_[v[0], v, v[-1]]
        curves = []
        for k in range(n_curves):
            pick = np.unique(np.r_[0, np.arange(1 + k, len(t) - 1, n_curves), len(t) - 1])
            curves.append(cubic_spline(t[pick], v[pick], at))
        return np.mean(curves, axis=0)

    def split(times: int) -> np.ndarray:
        out, rest = [], x.copy()
        scale = x.std() or 1.0
        while len(out) < max_imfs:
            h, done = rest.copy(), False
            for _ in range(times):
                mean = mean_curve(h)
                if mean is None:
                    break
                h, done = h - mean, True
                if np.abs(mean).max() <= eps_ratio * scale:
                    break
            if not done:
                break
            out.append(h)
            rest = rest - h
        return np.array([*out, rest])

    if not optimize_sift:
        return split(max_sift)
    tries = range(min_sift, max_sift + 1, max(1, (max_sift - min_sift) // 8))
    return min((split(k) for k in tries), key=lambda m: (x - m[-1]).std())


def itd(x, max_modes: int = 10, alpha: float = 0.5):
    """Intrinsic time-scale decomposition; a step keeps what the linear map between baseline knots leaves."""
    rest = np.asarray(x, float)
    power = (rest**2).sum() or 1.0
    out = []
    while len(out) < max_modes:
        k = np.sort(np.concatenate(extrema(rest)))
        if len(k) <= 3 or (rest**2).sum() <= 0.01 * power:
            break
        k = np.unique(np.r_[0, k, len(rest) - 1])
        v = rest[k]
        level = v.copy()
        level[1:-1] = alpha * (v[:-2] + (k[1:-1] - k[:-2]) / (k[2:] - k[:-2]) * (v[2:] - v[:-2])) + (1 - alpha) * v[1:-1]
        i = np.clip(np.searchsorted(k, np.arange(len(rest)), "right") - 1, 0, len(k) - 2)
        span = v[i + 1] - v[i]
        base = level[i] + np.where(span == 0, 0, (level[i + 1] - level[i]) / np.where(span == 0, 1, span) * (rest - v[i]))
        base[-1] = level[-1]
        out.append(rest - base)
        rest = base
    return np.array([*out, rest])


def _moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    size = max(1, size | 1)
    half = min(size // 2, len(x) - 1)
    if half < 1:
        return x
    wide = np.pad(x, half, mode="symmetric")
    sums = np.cumsum(np.r_[0.0, wide])
    return (sums[2 * half + 1 :] - sums[: -2 * half - 1]) / (2 * half + 1)


def _local_curves(x: np.ndarray, ends: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
    """Local mean and amplitude as smoothed steps between neighbouring extrema."""
    k = np.sort(np.concatenate(extrema(x)))
    if len(k) < 3:
        return None
    if ends:
        k = np.unique(np.r_[0, k, len(x) - 1])
    mean, size = (x[k[1:]] + x[k[:-1]]) / 2, np.abs(x[k[1:]] - x[k[:-1]]) / 2
    i = np.clip(np.searchsorted(k, np.arange(len(x)), "right") - 1, 0, len(k) - 2)
    span = int(max(3, np.diff(k).max() // 3))
    m, a = mean[i], size[i]
    for _ in range(12):
        m, a = _moving_mean(m, span), _moving_mean(a, span)
        if (m[1:] != m[:-1]).all():
            break
    return m, a


def lmd(x, max_modes: int = 5, max_iter: int = 200, epsilon: float = 0.01, min_extrema: int = 5):
    """Local mean decomposition: products of a demodulated wave and its envelopes."""
    rest = np.asarray(x, float)
    out = []
    while len(out) < max_modes and sum(map(len, extrema(rest))) >= min_extrema:
        s, amp = rest.copy(), np.ones(len(rest))
        for _ in range(max_iter):
            curves = _local_curves(s)
            if curves is None:
                break
            m, a = curves
            a = np.where(a <= 1e-12, 0.9999, a)
            old, s = s, (s - m) / a
            amp = amp * a
            if np.abs(1 - a).mean() <= epsilon or np.abs(s - old).mean() <= epsilon:
                break
            if not np.isfinite(s).all() or amp.max() > 1e12:
                s, amp = old, amp / a
                break
        out.append(s * amp)
        rest = rest - out[-1]
    return np.array([*out, rest])


def rlmd(x, max_modes: int = 10, max_iter: int = 30, stop: tuple[float, float, float] = (0.005, 0.7, 0.05), min_ratio: float = 0.001, min_peaks: int = 3):
    """LMD over a mirrored signal, whose number of demodulations is the one with the flattest envelope."""
    x = np.asarray(x, float)
    pad = max(2, len(x) // 5)
    rest = np.pad(x, min(pad, len(x) - 1), mode="reflect")
    cut = slice(min(pad, len(x) - 1), min(pad, len(x) - 1) + len(x))
    power = (rest**2).sum() or 1.0
    out = []
    while len(out) < max_modes and len(extrema(rest)[0]) >= min_peaks and (rest**2).sum() / power > min_ratio:
        s, amp, best, best_cost, costs = rest.copy(), np.ones(len(rest)), None, np.inf, []
        for _ in range(max_iter):
            curves = _local_curves(s)
            if curves is None:
                break
            m, a = curves
            a = np.where(a <= 1e-9, 0.9999, a)
            s = (s - m) / a
            amp = amp * a
            if not np.isfinite(s).all() or np.abs(s).max() > 1e6:
                break
            flat = a - 1
            cost = float(np.sqrt((flat**2).mean()) + abs(_excess_kurtosis(flat)) * stop[0])
            if cost < best_cost:
                best, best_cost = s * amp, cost
            costs.append(cost)
            if cost < stop[0] or (len(costs) > 2 and costs[-1] >= costs[-2] >= costs[-3]):
                break
        if best is None:
            break
        out.append(best)
        rest = rest - best
    modes = [m[cut] for m in out]
    return np.array([*modes, x - sum(modes, np.zeros(len(x)))])


WINDOW_RULES = {
    0: lambda a, b: min(a.min(), b.min()),
    1: lambda a, b: max(a.min(), b.min()),
    2: lambda a, b: min(a.max(), b.max()),
    3: lambda a, b: max(a.max(), b.max()),
    4: lambda a, b: (a.mean() + b.mean()) / 2,
    5: lambda a, b: np.median(np.r_[a, b]),
    6: lambda a, b: np.bincount(np.r_[a, b].astype(int)).argmax(),
}


def _window_of(x: np.ndarray, rule: int) -> int | None:
    tops, dips = extrema(x)
    if len(tops) < 2 or len(dips) < 2:
        return None
    size = int(WINDOW_RULES[rule](np.diff(tops), np.diff(dips)))
    return max(3, size | 1)


def _order_mean(x: np.ndarray, size: int) -> np.ndarray:
    half = min(size // 2, len(x) - 1)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="symmetric"), 2 * half + 1)
    return _moving_mean((wide.max(1) + wide.min(1)) / 2, 2 * half + 1)


def faemd(x, max_imfs: int = 3, tol: float = 0.05, window_type: int = 0, max_iter: int = 100):
    """Envelopes by moving maxima and minima; channels of a (C, T) signal share the window of their summed lengths."""
    x = np.atleast_2d(np.asarray(x, float))
    rest = x.copy()
    out = []
    while len(out) < max_imfs:
        sizes = [_window_of(c, window_type) for c in rest]
        if any(s is None for s in sizes):
            break
        size = max(3, int(round(sum(sizes) / np.sqrt(len(sizes)))) | 1) if len(sizes) > 1 else sizes[0]
        h = rest.copy()
        for n in range(max_iter):
            mean = np.array([_order_mean(c, size) for c in h])
            h = h - mean
            if n >= 1 and (mean**2).mean() < tol * max((h**2).mean(), 1e-300):
                break
        out.append(h)
        rest = rest - h
    stack = np.array([*out, rest])
    return stack[:, 0] if len(x) == 1 else stack


def double_filter(length: int) -> np.ndarray:
    """A symmetric, non-negative filter whose spectrum is non-negative: a raised cosine convolved with itself."""
    half = max(1, length // 2)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(half) + 0.5) / half)
    f = np.convolve(w, w)
    return f / f.sum()


def iterative_filtering(x, xi: float = 1.6, delta: float = 0.001, max_imfs: int = 20, max_inner: int = 200, min_extrema: int = 3):
    """Modes by repeated removal of a moving average as wide as the extrema's spacing; the signal is taken as periodic."""
    rest = np.asarray(x, float)
    n, out = len(rest), []
    while len(out) < max_imfs:
        k = sum(map(len, extrema(rest)))
        if k < min_extrema:
            break
        size = 2 * int(xi * n / k)
        if size >= n:
            break
        f = double_filter(2 * size)
        # wrapped around the period, so that its gains stay between 0 and 1
        kernel = np.zeros(n)
        np.add.at(kernel, (np.arange(len(f)) - len(f) // 2) % n, f)
        gain = np.fft.rfft(kernel).real
        spectrum, keep = np.fft.rfft(rest), 1 - gain
        h = spectrum
        for _ in range(max_inner):
            mean = h * gain
            if (np.abs(mean) ** 2).sum() < delta * (np.abs(h) ** 2).sum():
                break
            h = h * keep
        mode = np.fft.irfft(h, n)
        out.append(mode)
        rest = rest - mode
    return np.array([*out, rest])


def alif(x, xi: float = 1.6, delta: float = 0.0001, max_imfs: int = 10, max_inner: int = 500, min_extrema: int = 3):
    """Iterative filtering whose moving average is as wide as the local spacing of extrema."""
    rest = np.asarray(x, float)
    n, out = len(rest), []
    at = np.arange(n)
    while len(out) < max_imfs:
        k = np.sort(np.concatenate(extrema(rest)))
        if len(k) < min_extrema:
            break
        gap = np.diff(k).astype(float)
        width = np.interp(at, (k[1:] + k[:-1]) / 2, gap)
        width = np.clip(xi * _moving_mean(width, max(3, int(gap.mean()))) * 2, 2.0, max(2.0, n / 2))
        reach = int(min(n - 1, np.ceil(width.max())))
        shifts = np.arange(-reach, reach + 1)
        weights = np.maximum(0.0, 1 + np.cos(np.pi * np.clip(shifts[None] / width[:, None], -1, 1)))
        weights /= weights.sum(1, keepdims=True)
        h = rest.copy()
        for _ in range(max_inner):
            wide = np.lib.stride_tricks.sliding_window_view(np.pad(h, reach, mode="symmetric"), 2 * reach + 1)
            mean = (wide * weights).sum(1)
            if ((h - mean) ** 2).sum() > (rest**2).sum():
                break  # unequal widths can make a step grow
            h = h - mean
            if (mean**2).sum() < delta * (h**2).sum():
                break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def semd(x, bridge: float = 0.2, **params):
    """Channels (C, T) in a row, joined by linear cross-fades, decomposed as one signal and cut again: (K, C, T)."""
    x = np.atleast_2d(np.asarray(x, float))
    c, t = x.shape
    d = max(2, round(bridge * t))
    ramp = np.linspace(0, 1, d + 2)[1:-1]
    parts = [x[0]]
    for a, b in zip(x, x[1:], strict=False):
        parts += [a[::-1][:d] * (1 - ramp) + b[:d][::-1] * ramp if d <= t else a[-1] * (1 - ramp) + b[0] * ramp, b]
    modes = emd(np.concatenate(parts), **params)
    starts = [i * (t + d) for i in range(c)]
    return np.array([[m[s : s + t] for s in starts] for m in modes])


def directions(count: int, dims: int) -> np.ndarray:
    """Unit vectors spread over a sphere by a Hammersley sequence."""
    primes, k = [], 2
    while len(primes) < dims - 1:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1

    def digits(i: int, base: int) -> float:
        out, f = 0.0, 1 / base
        while i:
            out, i, f = out + f * (i % base), i // base, f / base
        return out

    u = np.array([[(i + 0.5) / count, *(digits(i, p) for p in primes)] for i in range(count)])
    # Box-Muller pairs of the sequence give vectors of uniform direction
    v = np.sqrt(-2 * np.log(np.clip(u, 1e-9, 1 - 1e-9))) * np.cos(2 * np.pi * np.roll(u, 1, axis=1))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def memd(x, n_dir: int = 32, max_modes: int = 8, max_iter: int = 30, stop: tuple[float, float, float] = (0.075, 0.75, 0.075), adapt: float = 0.0):
    """Multivariate EMD of (C, T): local means are averages of envelopes over projections; (K, C, T).

    With ``adapt``, directions are drawn towards the residue's main axis.
    """
    x = np.asarray(x, float)
    rest, out = x.copy(), []
    base = directions(n_dir, len(x))
    at = np.arange(x.shape[1])

    def local_mean(h: np.ndarray):
        dirs = base
        if adapt:
            _, vectors = np.linalg.eigh(np.cov(h))
            axis = vectors[:, -1]
            near = np.argsort(-np.abs(base @ axis))[: len(base) // 2]
            dirs = base.copy()
            dirs[near] += adapt * np.sign(dirs[near] @ axis)[:, None] * axis
            dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
        means, sizes, seen = np.zeros_like(h), np.zeros(h.shape[1]), 0
        for d in dirs:
            p = d @ h
            tops, dips = extrema(p)
            if len(tops) + len(dips) < 3 or not len(tops) or not len(dips):
                continue
            tt, _, dt, _ = mirrored_knots(p, tops, dips, 2)

            def through(t, h=h):
                inside = np.where(t < 0, -t, np.where(t > len(at) - 1, 2 * (len(at) - 1) - t, t)).astype(int)
                inside = np.clip(inside, 0, len(at) - 1)
                return np.array([cubic_spline(t.astype(float), c[inside], at) for c in h])

            up, low = through(tt), through(dt)
            means += (up + low) / 2
            sizes += np.sqrt(((up - low) ** 2).sum(0)) / 2
            seen += 1
        return (means / seen, sizes / seen) if seen else None

    while len(out) < max_modes:
        h, done = rest.copy(), False
        for _ in range(max_iter):
            found = local_mean(h)
            if found is None:
                break
            mean, size = found
            done = True
            ratio = np.sqrt((mean**2).sum(0)) / np.maximum(size, 1e-12)
            h = h - mean
            if (ratio > stop[0]).mean() <= stop[2] and not (ratio > stop[1]).any():
                break
        if not done:
            break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def hilbert_attributes(x, fs: float = 1.0, sifter=emd, **params) -> list[tuple[np.ndarray, np.ndarray]]:
    """Amplitude and frequency of each mode of a sifter."""
    out = []
    for mode in sifter(x, **params):
        a = analytic(mode)
        step = np.angle(a[1:] * np.conj(a[:-1])) * fs / (2 * np.pi)
        out.append((np.abs(a), np.r_[step, step[-1:]]))
    return out
