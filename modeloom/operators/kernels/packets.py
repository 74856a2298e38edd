"""Filter banks and the kurtogram: a tree of halved bands whose nodes are also cut in three."""

from __future__ import annotations

import numpy as np

#: Taps less one, and cut-off (a share of the Nyquist rate), of the half-band prototype; the third-band one has half as many taps again.
ORDER, CUTOFF = 16, 0.4


def windowed_sinc(taps: int, cutoff: float) -> np.ndarray:
    """A low-pass of unit gain at 0: a sinc under Hamming's window."""
    k = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * k) * np.hamming(taps)
    return h / h.sum()


def analytic_filters() -> dict[str, np.ndarray]:
    """Complex filters of the lower and upper half (h, g) and of the three thirds (h1, h2, h3) of the positive frequencies."""
    low = windowed_sinc(ORDER + 1, CUTOFF)
    h = low * np.exp(2j * np.pi * np.arange(ORDER + 1) / 8)
    # the mirror image: taps in reverse, signs in turn
    g = h[ORDER - 1 - np.arange(ORDER)] * np.where(np.arange(ORDER) % 2, 1, -1)
    k = np.arange(ORDER * 3 // 2 + 1)
    third = windowed_sinc(len(k), CUTOFF * 2 / 3)
    return {"h": h, "g": g, **{f"h{j + 1}": third * np.exp(2j * np.pi * k * (1 + 2 * j) / 12) for j in range(3)}}


def _thinned(x: np.ndarray, taps: np.ndarray, by: int) -> np.ndarray:
    return np.convolve(x, taps)[: len(x)][by - 1 :: by]


def halves(x: np.ndarray, filters: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper half band, every second sample; the upper one's spectrum is turned round, so both rise."""
    low, high = _thinned(x, filters["h"], 2), _thinned(x, filters["g"], 2)
    return low, high * np.where(np.arange(len(high)) % 2, 1, -1)


def thirds(x: np.ndarray, filters: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The three third bands, every third sample."""
    return [_thinned(x, filters[k], 3) for k in ("h1", "h2", "h3")]


def envelope_kurtosis(x: np.ndarray) -> float:
    """The fourth moment over the squared second, less that of Gaussian noise."""
    if not len(x):
        return 0.0
    x = x - x.mean()
    energy = (np.abs(x) ** 2).mean()
    if energy < np.finfo(float).eps:
        return 0.0
    return float((np.abs(x) ** 4).mean() / energy**2 - (2 if np.abs(x.imag).max() > 1e-15 * (1 + np.abs(x).max()) else 3))


def packet(x: np.ndarray, path: tuple[int, ...], third: int | None = None, filters: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """The envelope of one band: the halves taken in turn, from the widest, and a third of the last."""
    filters = filters or analytic_filters()
    for side in path:
        x = halves(x, filters)[side]
    return x if third is None else thirds(x, filters)[third]


def kurtogram(x, levels: int = 5) -> list[tuple[float, int, float, float, float]]:
    """(level, band, centre, width, kurtosis) of every band; frequencies in cycles a sample, negative kurtosis as 0.

    Level l has 2^l bands; from the thirds of level l - 1's bands come those of
    l + log2(1.5), up to that of the last level but one. Transients of the
    filters are left out.
    """
    x = np.asarray(x, float)
    filters = analytic_filters()
    skip = len(filters["h"]) - 1
    nodes = [x - x.mean()]
    rows = [(0.0, 0, 0.25, 0.5, max(0.0, envelope_kurtosis(nodes[0])))]

    def add(level: float, bands: list[np.ndarray]) -> None:
        width = 0.5 / len(bands)
        rows.extend((level, b, (b + 0.5) * width, width, max(0.0, envelope_kurtosis(z[skip:]))) for b, z in enumerate(bands))

    for level in range(1, levels + 1):
        if level < levels:
            add(level + np.log2(1.5), [z for node in nodes for z in thirds(node, filters)])
        nodes = [z for node in nodes for z in halves(node, filters)]
        add(float(level), nodes)
    return rows


def band_envelope(x, level: float, frequency: float) -> tuple[np.ndarray, float, float]:
    """The complex envelope, centre and width of the kurtogram's band that is nearest to a frequency (cycles a sample) at a level."""
    x = np.asarray(x, float)
    whole = int(level)
    in_three = level - whole >= 0.5
    count = 3 * 2 ** (whole - 1) if in_three else 2**whole
    width = 0.5 / count
    band = int(np.clip(np.floor(frequency / width), 0, count - 1))
    node, depth = (band // 3, whole - 1) if in_three else (band, whole)
    path = tuple(node >> k & 1 for k in reversed(range(depth)))
    return packet(x - x.mean(), path, band % 3 if in_three else None), (band + 0.5) * width, width
