"""Short-time spectra, ridges, phases' crossings, and the two tones of a beat."""

from __future__ import annotations

import numpy as np

from modeloom.operators.kernels.numeric import analytic, extrema, pchip

#: Width of the Gaussian window, as a share of half its length.
SIGMA = 0.28


def stft(x, bins: int = 512, window: int = 32) -> np.ndarray:
    """(bins, n): the analytic signal's short-time spectrum, zero frequency in the middle row; windows are cut at the ends."""
    z = analytic(np.asarray(x, float))
    n, size = len(z), 2 * -(-window // 2)
    g = (np.pi * SIGMA**2) ** -0.25 * np.exp(-(np.linspace(-1, 1, size) ** 2) / (2 * SIGMA**2))
    reach = min(bins // 2 - 1, (size - 1) // 2)
    at = np.arange(n)[None] + np.arange(-reach, reach + 1)[:, None]
    known = (at >= 0) & (at < n)
    frames = np.where(known, z[np.clip(at, 0, n - 1)], 0) * g[(size - 1) // 2 - reach : (size - 1) // 2 + reach + 1, None]
    # a frame's first known sample is the transform's first
    lead = np.maximum(0, reach - np.arange(n))
    spectrum = np.fft.fft(frames, bins, axis=0) * np.exp(2j * np.pi * np.arange(bins)[:, None] * lead[None] / bins)
    return np.fft.fftshift(spectrum, axes=0)


def ridge(energy, jump: int) -> np.ndarray:
    """The row of each column's ridge: from the strongest cell both ways, to the strongest within ``jump`` rows of the last."""
    e = np.abs(np.asarray(energy))
    rows, columns = e.shape
    top, start = np.unravel_index(int(e.argmax()), e.shape)
    out = np.empty(columns, int)
    out[start] = top
    for way in (range(start + 1, columns), range(start - 1, -1, -1)):
        at = top
        for j in way:
            low = max(0, at - jump)
            at = low + int(e[low : min(rows, at + jump + 1), j].argmax())
            out[j] = at
    return out


def phase_crossings(phase) -> np.ndarray:
    """Samples at which a phase has turned once more since the sample before them in the list, to the nearest; the first is 0."""
    phase = np.asarray(phase, float)
    out, base = [0], phase[0]
    for j in range(1, len(phase)):
        if phase[j] - base > 2 * np.pi >= phase[j - 1] - base:
            over, under = phase[j] - base - 2 * np.pi, 2 * np.pi - (phase[j - 1] - base)
            out.append(j if over < under else j - 1)
            base = phase[out[-1]]
    return np.array(out)


def local_frequency(x) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude and frequency (cycles a sample, not below 0) of the analytic signal, by central differences; ends repeat their neighbours."""
    a = analytic(np.asarray(x, float))
    amp, phase = np.abs(a), np.unwrap(np.angle(a))
    freq = np.zeros(len(a))
    if len(a) > 2:
        freq[1:-1] = (phase[2:] - phase[:-2]) / (4 * np.pi)
        freq[0], freq[-1] = freq[1], freq[-2]
        amp[0], amp[-1] = amp[1], amp[-2]
    return amp, np.maximum(freq, 0)


def two_tones(x) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Amplitudes and frequencies (a1, f1, a2, f2) of two parts whose beat makes a signal's envelope.

    At the envelope's crests the amplitudes add, in its troughs they are
    opposed; there the energy-weighed frequency gives two equations for the two
    frequencies. Without two crests and troughs one part has all.
    """
    amp, freq = local_frequency(x)
    t = np.arange(len(amp))
    tops, dips = extrema(amp**2)
    if len(tops) < 2 or len(dips) < 2:
        return amp, freq, np.zeros_like(amp), freq
    moved = freq * amp**2
    crest, trough = (pchip(k, amp[k], np.clip(t, k[0], k[-1])) for k in (tops, dips))
    more, less = (pchip(k, moved[k], np.clip(t, k[0], k[-1])) for k in (tops, dips))
    a1, a2 = (crest + trough) / 2, (crest - trough) / 2
    # crests: f1 a1 + f2 a2 = more / crest; troughs: f1 a1 - f2 a2 = less / trough
    up, down = more / np.maximum(crest, 1e-12), less / np.maximum(trough, 1e-12)
    return a1, (up + down) / 2 / np.maximum(a1, 1e-12), a2, (up - down) / 2 / np.maximum(a2, 1e-12)
