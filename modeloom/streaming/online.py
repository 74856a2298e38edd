"""Online decomposition as keyed streaming state.

A window of extrema slides over each series. Each window's first mode counts
with a bell-shaped weight; once no later window can reach a sample, the sample
is final and is emitted, and what the mode leaves goes on to the next stage.
State is the tail of each stage that isn't final yet, so it doesn't grow with
the stream (but waits for extrema where there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from modeloom.operators.kernels.numeric import extrema
from modeloom.operators.kernels.sifting import emd

OUTPUT = "series_id string, mode int, t bigint, value double"
STATE = "stages array<struct<start:bigint,data:array<double>,sum:array<double>,weight:array<double>>>, next_t bigint"


class Stage:
    """Samples from ``start`` on that aren't final, and the weighed modes over them so far."""

    def __init__(self, start: int = 0, data=(), total=(), weight=()):
        self.start = start
        self.data, self.total, self.weight = (np.asarray(a, float) for a in (data, total, weight))

    def push(self, x: np.ndarray, n_extrema: int, closing: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
        """Takes samples; returns where final ones begin, their mode and what it leaves."""
        self.data = np.r_[self.data, x]
        self.total = np.r_[self.total, np.zeros(len(x))]
        self.weight = np.r_[self.weight, np.zeros(len(x))]
        first, done = self.start, []
        while len(self.data):
            knots = np.sort(np.concatenate(extrema(self.data)))
            whole = len(knots) > n_extrema
            if not whole and not closing:
                break
            size = int(knots[n_extrema]) + 1 if whole else len(self.data)
            modes = emd(self.data[:size], max_imfs=1)
            mode = modes[0] if len(modes) > 1 else np.zeros(size)
            bell = np.exp(-0.5 * (np.linspace(-1, 1, size) * 2.5) ** 2) + 1e-3
            self.total[:size] += bell * mode
            self.weight[:size] += bell
            # the next window starts one pair of extrema on
            step = len(self.data) if not whole else max(1, int(knots[1]))
            done.append((self.total[:step] / np.maximum(self.weight[:step], 1e-12), self.data[:step]))
            self.start += step
            self.data, self.total, self.weight = self.data[step:], self.total[step:], self.weight[step:]
        if not done:
            return first, np.zeros(0), np.zeros(0)
        mode = np.concatenate([m for m, _ in done])
        return first, mode, np.concatenate([d for _, d in done]) - mode


def advance(stages: list[Stage], x: np.ndarray, n_extrema: int, max_modes: int, closing: bool = False) -> list[tuple[int, int, np.ndarray]]:
    """Feeds samples through the stages: (mode, first t, values) that became final; the last mode is what all stages leave."""
    out = []
    start = None
    for k in range(max_modes):
        if k >= len(stages):
            stages.append(Stage(start or 0))
        start, mode, rest = stages[k].push(x, n_extrema, closing)
        if len(mode):
            out.append((k, start, mode))
        x = rest
        if not len(x) and not closing:
            break
    if len(x):
        out.append((max_modes, start, x))
    return out


def online_emd(signal: np.ndarray, chunk: int = 50, n_extrema: int = 8, max_modes: int = 3) -> np.ndarray:
    """The whole decomposition of a finite signal, fed in chunks and closed: modes and the rest, which sum to it."""
    stages: list[Stage] = []
    out = np.zeros((max_modes + 1, len(signal)))
    parts = [signal[i : i + chunk] for i in range(0, len(signal), chunk)]
    for x, closing in [*((p, False) for p in parts), (np.zeros(0), True)]:
        for k, at, values in advance(stages, np.asarray(x, float), n_extrema, max_modes, closing):
            out[k, at : at + len(values)] += values
    return out


def stream_emd(stream: DataFrame, n_extrema: int = 8, max_modes: int = 3) -> DataFrame:
    """Final samples of each mode (series_id, mode, t, value) of a stream (series_id, t, value).

    Samples of a series must come in the order of t from 0 on, within a
    micro-batch in any order; a sample that was already taken is left out.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stages, next_t = [], 0
        if state.exists:
            saved, next_t = state.get
            stages = [Stage(s["start"], s["data"], s["sum"], s["weight"]) for s in saved]
        pdf = pd.concat(list(frames)).sort_values("t", kind="stable").drop_duplicates("t")
        pdf = pdf[pdf["t"] >= next_t]
        for k, at, values in advance(stages, pdf["value"].to_numpy(float), n_extrema, max_modes):
            yield pd.DataFrame({"series_id": key[0], "mode": np.int32(k), "t": np.arange(at, at + len(values)), "value": values})
        rows = [{"start": int(s.start), "data": s.data.tolist(), "sum": s.total.tolist(), "weight": s.weight.tolist()} for s in stages]
        state.update((rows, int(pdf["t"].max()) + 1 if len(pdf) else int(next_t)))

    return stream.select("series_id", "t", "value").groupBy("series_id").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")
