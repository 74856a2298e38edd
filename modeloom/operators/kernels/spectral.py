"""Spectral and subspace decompositions: EWT, EFD, SSA, HVD, synchrosqueezing, FMD, swarm and band searches, kurtograms."""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels.numeric import analytic, welch


def _even_mirror(x: np.ndarray) -> tuple[np.ndarray, int]:
    half = len(x) // 2
    return np.concatenate([x[:half][::-1], x, x[len(x) - half :][::-1]]), half


def boundaries(power: np.ndarray, count: int, between: str = "middle") -> np.ndarray:
    """Bins that part the ``count`` largest inner maxima: their midpoints, or the lowest bin between them."""
    inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:])) + 1
    if power[0] > power[1]:
        inner = np.r_[0, inner]
    top = np.sort(inner[np.argsort(-power[inner], kind="stable")[:count]])
    if between == "middle":
        return (top[1:] + top[:-1]) // 2
    return np.array([a + int(np.argmin(power[a : b + 1])) for a, b in zip(top, top[1:], strict=False)], int)


def _smooth(power: np.ndarray, sigma: float) -> np.ndarray:
    if not sigma:
        return power
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(power, r, mode="symmetric"), k / k.sum(), "valid")


def meyer_bank(edges: np.ndarray, size: int) -> np.ndarray:
    """Gains over ``size`` frequencies from 0 to pi of bands between ``edges`` (radians); their squares sum to one."""
    w = np.linspace(0, np.pi, size)
    full = np.r_[edges, np.pi]
    gamma = (1 - 1 / max(size, 2)) * min(((b - a) / (b + a) for a, b in zip(full, full[1:], strict=False)), default=0.5) if len(edges) else 0.5
    gamma = min(gamma, 0.5)

    def beta(u: np.ndarray) -> np.ndarray:
        u = np.clip(u, 0, 1)
        return u**4 * (35 - 84 * u + 70 * u**2 - 20 * u**3)

    rises = [np.sin(np.pi / 2 * beta((w - (1 - gamma) * e) / (2 * gamma * e))) for e in edges]
    falls = [np.cos(np.pi / 2 * beta((w - (1 - gamma) * e) / (2 * gamma * e))) for e in edges]
    bank = []
    for i in range(len(edges) + 1):
        gain = np.ones(size)
        if i:
            gain = gain * rises[i - 1]
        if i < len(edges):
            gain = gain * falls[i]
        bank.append(gain)
    return np.array(bank)


def ewt(x, K: int = 5, log: bool = False, sigma: float = 5, tight: bool = False):
    """Empirical wavelet modes (K, T): Meyer bands between the spectrum's main maxima.

    With squared gains the modes sum to the signal; ``tight`` applies the gains once.
    """
    x = np.asarray(x, float)
    wide, half = _even_mirror(x)
    f = np.fft.rfft(wide)
    power = np.abs(np.fft.rfft(x))
    power = _smooth(np.log(power + 1e-12) if log else power, sigma)
    edges = boundaries(power, K) * np.pi / max(1, len(power) - 1)
    bank = meyer_bank(edges[edges > 0], len(f))
    gains = bank if tight else bank**2
    return np.fft.irfft(f * gains, len(wide), axis=1)[:, half : half + len(x)], edges


def ewt2d(image, K: int = 3, sigma: float = 2):
    """Tensor empirical wavelets: bands of the rows' and columns' mean spectra; (K_y * K_x, H, W), summing to the image."""
    image = np.asarray(image, float)
    f = np.fft.fft2(image)

    def bank(axis: int) -> np.ndarray:
        n = image.shape[1 - axis]
        mean = np.abs(np.fft.rfft(image, axis=1 - axis)).mean(axis)
        edges = boundaries(_smooth(mean, sigma), K) * np.pi / max(1, len(mean) - 1)
        half = meyer_bank(edges[edges > 0], n // 2 + 1) ** 2
        return np.concatenate([half, half[:, 1 : (n + 1) // 2][:, ::-1]], axis=1)

    by, bx = bank(1), bank(0)
    return np.array([np.fft.ifft2(f * gy[:, None] * gx[None]).real for gy in by for gx in bx])


def efd(x, max_imfs: int = 3):
    """Fourier modes of ideal bands, parted at the lowest bins between the main maxima; they sum to the signal."""
    x = np.asarray(x, float)
    power = np.abs(np.fft.rfft(x))
    cuts = boundaries(power, max_imfs, "lowest") / max(1, len(power) - 1)
    wide, half = _even_mirror(x)
    f = np.fft.rfft(wide)
    band = np.searchsorted(cuts, np.arange(len(f)) / (len(f) - 1), "right")
    return np.array([np.fft.irfft(np.where(band == k, f, 0), len(wide))[half : half + len(x)] for k in range(len(cuts) + 1)]), cuts / 2


def ssa(x, K: int = 3, lags: int | None = None):
    """Singular spectrum analysis: K rank-one parts of the trajectory matrix, averaged along antidiagonals, and eigenvalues."""
    x = np.asarray(x, float)
    n = len(x)
    m = lags or max(2, n // 3)
    rows = np.lib.stride_tricks.sliding_window_view(x, m)
    values, vectors = np.linalg.eigh(rows.T @ rows)
    order = np.argsort(values)[::-1]
    count = np.convolve(np.ones(n - m + 1), np.ones(m))
    modes = [np.convolve(rows @ vectors[:, k], vectors[:, k]) / count for k in order[:K]]
    return np.array(modes), values[order]


def hvd(x, K: int = 3, cut: float = 0.02):
    """Hilbert vibration modes: the mean frequency of the strongest part by low-passing the phase's slope, then synchronous detection."""
    rest = np.asarray(x, float)
    n = len(rest)
    out = []

    def low(y: np.ndarray, share: float) -> np.ndarray:
        half = len(y) // 2
        wide = np.concatenate([y[:half][::-1], y, y[len(y) - half :][::-1]])
        f = np.fft.fft(wide)
        gain = 1 / (1 + (np.abs(np.fft.fftfreq(len(wide))) / share) ** 8)
        return np.fft.ifft(f * gain)[half : half + len(y)]

    for _ in range(K):
        half = n // 2
        wide = np.concatenate([rest[:half][::-1], rest, rest[n - half :][::-1]])
        a = analytic(wide)[half : half + n]
        slope = np.angle(a[1:] * np.conj(a[:-1]))
        slope = low(np.r_[slope, slope[-1:]], cut).real
        inner = slice(n // 50, n - n // 50)
        carrier = np.full(n, slope[inner].mean()) if np.ptp(slope[inner]) < 0.1 * abs(slope[inner].mean()) else slope
        phase = np.cumsum(carrier) - carrier[0]
        mode = 2 * (low(rest * np.exp(-1j * phase), min(cut, abs(carrier.mean()) / 4 / np.pi + 1e-6)) * np.exp(1j * phase)).real
        out.append(mode)
        rest = rest - mode
    return np.array([*out, rest])


def cwt(x: np.ndarray, voices: int = 32, wavelet: str = "bump") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wavelet coefficients (scales, T) of the mirrored signal, their time derivatives, and the scales' centre frequencies (cycles a sample)."""
    wide, half = _even_mirror(x)
    n = len(wide)
    top = 0.45
    octaves = np.log2(top * len(x) / 2)
    freq = top / 2 ** (np.arange(int(voices * octaves)) / voices)
    f = np.fft.fft(wide)
    xi = np.fft.fftfreq(n)
    ratio = xi[None] / freq[:, None]
    if wavelet == "bump":
        u = (ratio - 1) / 0.2
        inside = np.abs(u) < 1
        psi = np.where(inside, np.exp(1 - 1 / np.where(inside, 1 - u**2, 1)), 0)
    else:
        psi = np.where(ratio > 0, np.exp(-0.5 * ((ratio - 1) * 6) ** 2), 0)
    w = np.fft.ifft(f * psi, axis=1)[:, half : half + len(x)]
    dw = np.fft.ifft(f * psi * 2j * np.pi * xi, axis=1)[:, half : half + len(x)]
    return w, dw, freq


def sst(x, voices: int = 32, wavelet: str = "bump", gamma: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Synchrosqueezed coefficients (bins, T) and their frequencies: each coefficient moves to its instantaneous frequency."""
    x = np.asarray(x, float)
    w, dw, freq = cwt(x, voices, wavelet)
    strong = np.abs(w) > gamma * np.abs(w).max()
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(strong, np.abs((dw / w).imag) / (2 * np.pi), np.nan)
    step = np.log2(freq[0] / np.where(at > 0, at, np.nan)) * voices
    row = np.round(step)
    good = np.isfinite(row) & (row >= 0) & (row < len(freq))
    out = np.zeros_like(w)
    col = np.broadcast_to(np.arange(len(x)), w.shape)
    np.add.at(out, (row[good].astype(int), col[good]), w[good])
    # the gains' integral over log frequency makes the rows sum to the analytic signal
    probe = np.cos(2 * np.pi * freq[len(freq) // 2] * np.arange(4096))
    pw, _, _ = cwt(probe, voices, wavelet)
    return out / (np.abs(pw[:, 1024:3072].sum(0)).mean() or 1.0), freq


def sst_modes(x, K: int = 4, voices: int = 32, wavelet: str = "bump"):
    """Modes from the strongest bands of the synchrosqueezed map, and the residue: rows sum to the signal."""
    x = np.asarray(x, float)
    t, freq = sst(x, voices, wavelet)
    cuts = boundaries(_smooth(np.abs(t).sum(1), 2), K, "lowest")
    band = np.searchsorted(cuts, np.arange(len(freq)), "right")
    modes = [t[band == k].sum(0).real for k in range(len(cuts) + 1)]
    return np.array([*modes, x - np.sum(modes, axis=0)])


def correlated_kurtosis(x: np.ndarray, period: int, shifts: int = 1) -> float:
    p = x.copy()
    for m in range(1, shifts + 1):
        p = p * np.r_[np.zeros(m * period), x[: len(x) - m * period]] if m * period < len(x) else p * 0
    return (p**2).sum() / max((x**2).sum() ** (shifts + 1), 1e-300)


def dominant_period(x: np.ndarray) -> int:
    """The lag of the largest autocorrelation past its first zero crossing."""
    c = x - x.mean()
    r = np.fft.irfft(np.abs(np.fft.rfft(c, 2 * len(c))) ** 2)[: len(c)]
    cross = np.flatnonzero(r[1:] * r[:-1] <= 0)
    start = cross[0] + 1 if len(cross) else 1
    return int(start + np.argmax(r[start : max(start + 1, len(r) // 2)]))


def fmd(x, mode_num: int = 2, filter_size: int = 30, cut_num: int = 7, max_iter: int = 20):
    """Feature modes: a bank of filters, each tuned to the largest correlated kurtosis of its output; of the most alike pair the weaker goes."""
    x = np.asarray(x, float)
    size = filter_size
    window = np.lib.stride_tricks.sliding_window_view(np.pad(x, (size // 2, size - 1 - size // 2)), size)
    k = np.arange(size) - (size - 1) / 2
    bank = []
    for i in range(cut_num):
        lo, hi = i / cut_num / 2, (i + 1) / cut_num / 2
        taps = (2 * hi * np.sinc(2 * hi * k) - 2 * lo * np.sinc(2 * lo * k)) * np.hanning(size)
        bank.append(taps)
    while True:
        outs, next_bank, scores = [], [], []
        for taps in bank:
            y = window @ taps
            period = dominant_period(np.abs(analytic(y)))
            for _ in range(max_iter if len(bank) == cut_num else 2):
                back = np.r_[np.zeros(period), y[:-period]] if period < len(y) else np.zeros(len(y))
                weight = (y * back) ** 2
                # the filter that most favours samples whose product over a period is large
                a = window.T @ (window * (back**2)[:, None])
                b = window.T @ window + 1e-9 * np.trace(window.T @ window) / size * np.eye(size)
                new = np.linalg.solve(b, a @ taps)
                new /= np.linalg.norm(new) or 1.0
                if not np.isfinite(new).all() or weight.sum() == 0 or np.abs(new - taps / (np.linalg.norm(taps) or 1)).max() < 1e-4:
                    break
                taps = new
                y = window @ taps
            outs.append(y)
            next_bank.append(taps)
            scores.append(correlated_kurtosis(y, period))
        if len(outs) <= mode_num:
            return np.array(outs)
        c = np.abs(np.corrcoef(outs))
        np.fill_diagonal(c, -1)
        i, j = np.unravel_index(np.nanargmax(c), c.shape)
        gone = i if scores[i] < scores[j] else j
        bank = [t for n, t in enumerate(next_bank) if n != gone]


def swd(x, power_stop: float = 0.05, max_components: int = 10, width: float = 0.2):
    """Swarm components: the dominant peak of the Welch spectrum is followed by a narrow band-pass, scaled by least squares, and taken off; the last row is the rest."""
    x = np.asarray(x, float)
    rest, out = x.copy(), []
    total = (x**2).sum() or 1.0
    freq = np.fft.rfftfreq(len(x))
    while len(out) < max_components:
        g, p = welch(rest, 1.0, min(len(x), 1024))
        if (rest**2).sum() < power_stop * total or p.max() <= 0:
            break
        centre = g[np.argmax(p)]
        band = np.exp(-0.5 * ((freq - centre) / max(width * centre, 2 / len(x))) ** 2)
        member, target = np.zeros(len(x)), rest.copy()
        for _ in range(15):
            # members move towards the prey's filtered trace
            step = np.fft.irfft(np.fft.rfft(target) * band, len(x))
            member = member + step
            target = rest - member
            if (step**2).sum() < 1e-3 * (member**2).sum():
                break
        gain = (member @ rest) / max(member @ member, 1e-300)
        if (gain * member) @ (gain * member) < 1e-4 * total:
            break
        out.append(gain * member)
        rest = rest - out[-1]
    return np.array([*out, rest])


def pq_sparsity(envelope: np.ndarray, segments: int = 10, a: float = -10.0, p: float = 2.0, q: float = 1.0) -> float:
    parts = np.array_split(envelope, segments)
    r = np.array([((s**p).mean() ** (1 / p)) / max((s**q).mean() ** (1 / q), 1e-300) for s in parts])
    return float((r**a).mean() ** (1 / a))


def band(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The part of a signal in an ideal band (shares of the sampling rate)."""
    f = np.fft.rfft(x)
    freq = np.fft.rfftfreq(len(x))
    return np.fft.irfft(np.where((freq >= lo) & (freq <= hi), f, 0), len(x))


def particle_swarm(objective, low, high, particles: int = 20, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """The best position found for the largest objective within a box."""
    rng = np.random.default_rng(seed)
    low, high = np.asarray(low, float), np.asarray(high, float)
    pos = rng.uniform(low, high, (particles, len(low)))
    vel = rng.uniform(-1, 1, pos.shape) * (high - low) * 0.1
    score = np.array([objective(p) for p in pos])
    own, own_score = pos.copy(), score.copy()
    for r in range(rounds):
        lead = own[np.argmax(own_score)]
        inertia = 0.9 - 0.5 * r / rounds
        vel = inertia * vel + 2 * rng.random(pos.shape) * (own - pos) + 2 * rng.random(pos.shape) * (lead - pos)
        pos = np.clip(pos + np.clip(vel, (low - high) / 2, (high - low) / 2), low, high)
        score = np.array([objective(p) for p in pos])
        better = score > own_score
        own[better], own_score[better] = pos[better], score[better]
    best = int(np.argmax(own_score))
    return own[best], float(own_score[best])


def imd(x, threshold: float = 1.6, max_modes: int = 4, min_band: float = 0.02, particles: int = 20, rounds: int = 15, seed: int = 0):
    """Impulsive modes: bands whose squared envelope is sparsest, found by a swarm, in the whole range and then on either side of those found; the last row is the rest."""
    x = np.asarray(x, float)
    queue, out = [(0.0, 0.5)], []

    def fitness(p: np.ndarray) -> float:
        lo, hi = min(p), max(p)
        if hi - lo < min_band:
            return -1.0
        return pq_sparsity(np.abs(analytic(band(x, lo, hi))) ** 2)

    while queue and len(out) < max_modes:
        lo, hi = queue.pop(0)
        if hi - lo < 2 * min_band:
            continue
        best, score = particle_swarm(fitness, [lo, lo], [hi, hi], particles, rounds, seed + len(out))
        if score < threshold:
            continue
        a, b = min(best), max(best)
        out.append(band(x, a, b))
        queue += [(lo, a), (b, hi)]
    return np.array([*out, x - np.sum(out, axis=0)]) if out else x[None]


def dtw(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Dynamic time warping distance with absolute differences, within ``window`` samples of the diagonal."""
    m, n = len(a), len(b)
    width = max(window if window is not None else max(m, n), abs(m - n))
    inf = np.inf
    before = np.full(n + 1, inf)
    before[0] = 0.0
    for i in range(1, m + 1):
        lo, hi = max(1, i - width), min(n, i + width)
        now = np.full(n + 1, inf)
        best = np.minimum(before[lo : hi + 1], before[lo - 1 : hi]).tolist()
        cost = np.abs(a[i - 1] - b[lo - 1 : hi]).tolist()
        run, row = inf, []
        for c, up in zip(cost, best, strict=True):
            run = c + (up if up < run else run)
            row.append(run)
        now[lo : hi + 1] = row
        before = now
    return float(before[n])


def dtw_rows(a: np.ndarray, b: np.ndarray, window: int | None = None) -> np.ndarray:
    """``dtw`` of every row of ``a`` (P, m) and the same row of ``b`` (P, n), all rows at a time."""
    m, n = a.shape[1], b.shape[1]
    width = max(window if window is not None else max(m, n), abs(m - n))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    before = np.full((n + 1, a.shape[1]), np.inf)
    before[0] = 0.0
    for i in range(1, m + 1):
        now = np.full_like(before, np.inf)
        lo, hi = max(1, i - width), min(n, i + width)
        best = np.minimum(before[lo : hi + 1], before[lo - 1 : hi])
        cost = np.abs(a[i - 1] - b[lo - 1 : hi])
        for j in range(lo, hi + 1):
            now[j] = cost[j - lo] + np.minimum(best[j - lo], now[j - 1])
        before = now
    return before[n]


#: Where ``dtw_beside`` stops counting.
DTW_FAR = 20_000


def dtw_beside(a: np.ndarray, b: np.ndarray, window: int | None = None, block: int = 4096) -> np.ndarray:
    """Of every row of ``b`` (Q, n) to every row of ``a`` (P, m), the ``dtw`` distance of small whole numbers, (Q, P) int16, at most DTW_FAR.

    Samples are int16 and no two are further apart than 32767 - DTW_FAR. A block of
    rows goes through the antidiagonals at once; a buffer holds one antidiagonal,
    its first cell in row 1, with cells out of reach before and after it.
    """
    (p, m), (q, n) = a.shape, b.shape
    width = max(window if window is not None else max(m, n), abs(m - n))
    spans = [(max(0, s - n + 1, (s - width + 1) // 2), min(m - 1, s, (s + width) // 2)) for s in range(m + n - 1)]
    most = max(hi - lo + 1 for lo, hi in spans)
    gap = (32767 - DTW_FAR) // max(int(max(a.max(), b.max())) - int(min(a.min(), b.min())), 1)
    backwards = np.ascontiguousarray(b[:, ::-1])
    out = np.empty((q, p), np.int16)
    for at in range(0, p, block):
        x = np.ascontiguousarray(a[at : at + block].T)
        size = x.shape[1]
        y, (costs, least) = np.empty((n, size), np.int16), np.empty((2, most, size), np.int16)
        buffers = np.full((3, most + 3, size), DTW_FAR, np.int16)
        steps, at1, at2 = [], 0, 0  # the first samples of the antidiagonal before and the one before that
        for s, (lo, hi) in enumerate(spans):
            c, now, before, last = hi - lo + 1, buffers[s % 3], buffers[(s - 1) % 3], buffers[(s - 2) % 3]
            up, over, across = before[lo - at1 : lo - at1 + c], before[lo - at1 + 1 : lo - at1 + 1 + c], last[lo - at2 : lo - at2 + c]
            if not s:
                across = np.zeros((1, size), np.int16)  # where paths begin
            steps.append((x[lo : hi + 1], y[n - 1 - s + lo : n - s + hi], costs[:c], least[:c], up, over, across, now[1 : c + 1], now[c + 1], s % gap == gap - 1))
            at1, at2 = lo, at1
        end = buffers[(m + n - 2) % 3][m - spans[-1][0]]
        for one, to in zip(backwards, out, strict=True):
            y[:] = one[:, None]  # whole rows: numpy takes a number a row at a third of the speed
            buffers[1:] = DTW_FAR
            for xs, ys, cost, low, up, over, across, cells, beyond, full in steps:
                np.subtract(xs, ys, out=cost)
                np.absolute(cost, out=cost)
                np.minimum(up, over, out=low)
                np.minimum(low, across, out=low)
                np.add(cost, low, out=cells)
                if full:
                    np.minimum(cells, DTW_FAR, out=cells)
                beyond[:] = DTW_FAR
            np.minimum(end, DTW_FAR, out=to[at : at + block])
    return out
