"""Queries that must read whole series, held against SQL and plain versions written here."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from modeloom.operators.kernels import spectral
from modeloom.plans import catalogue
from modeloom.plans.catalogue import EVENTS, PAIR, USERS
from tests.test_catalogue import SF, canon, near

#: The channel queries' sum over all samples of a series.
CHANNELS = f"""WITH {EVENTS} SELECT series_id, CAST(c AS INTEGER) AS channel, (t + c) % n AS t, round(value, 6) + 0.0::DOUBLE AS value
FROM sig JOIN len USING (series_id) CROSS JOIN range(0, 3) r(c)"""


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def same(got, want):
    got, want = canon(got), canon(want)
    assert len(got) == len(want)
    assert all(near(a, b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", ["memd", "apitmemd", "nstemd", "semd", "faemd_channels"])
def test_channels_sum_to_whole_series(spark, duck, name):
    want = duck.sql(f"SELECT series_id, channel, t, value FROM ({CHANNELS})").fetchall()
    assert max(r[2] for r in want) > 100
    same(catalogue.QUERIES[f"decompose_{name}"](spark, SF).select("series_id", "channel", "t", "value").collect(), want)


@pytest.mark.parametrize("name", ["mvmd", "mjmd"])
def test_channel_modes_have_whole_length(spark, duck, name):
    length = dict(duck.sql(f"WITH {EVENTS} SELECT series_id, n FROM len").fetchall())
    # kernels of even lengths may lose the last sample
    rows = catalogue.QUERIES[f"decompose_{name}"](spark, SF).collect()
    assert rows and all(length[r.series_id] - r.n in (0, 1) for r in rows)


def warped(a, b, window):
    """The distance by its recurrence, cell by cell."""
    d = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(max(1, i - window), min(len(b), i + window) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d.get(k, math.inf) for k in ((i - 1, j - 1), (i, j - 1), (i - 1, j)))
    return d[len(a), len(b)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """42 embeddings, alike in their first 16 values and in every fourth one, apart in others."""
    r = random.Random(1)
    base = [r.random() for _ in range(64)]
    rows = [(i, [x if k < 16 or k % 4 == 0 else r.random() * 3 for k, x in enumerate(base)], f"l{i % 3}") for i in range(42)]
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(f"{path}/embeddings.parquet")
    return str(path), rows


def test_dtw_warps_whole_vectors(spark, vectors):
    path, rows = vectors
    want = [(i, j, warped(x, y, 4)) for i, x, _ in rows for j, y, _ in rows if j % 20 == 0]
    same(catalogue.QUERIES["dtw"](spark, path).select("id", "other_id", "distance").collect(), want)


def test_knn_dtw_warps_whole_vectors(spark, vectors):
    path, rows = vectors
    want = []
    for i, x, _ in rows:
        if i % 20 == 0:
            near_by = sorted((warped(y, x, 16), j, label) for j, y, label in rows)[:5]
            votes = Counter(label for _, _, label in near_by)
            want.append((i, min(votes, key=lambda v: (-votes[v], v))))
    same(catalogue.QUERIES["knn_dtw"](spark, path).select("id", "label").collect(), want)


def test_dtw_rows_is_dtw():
    r = np.random.default_rng(0)
    for m, n, window in ((1, 1, None), (5, 9, 2), (9, 5, None), (16, 16, 4)):
        a, b = r.normal(size=(7, m)), r.normal(size=(7, n))
        assert spectral.dtw_rows(a, b, window).tolist() == [spectral.dtw(x, y, window) for x, y in zip(a, b, strict=True)]


#: Whole ranges, in SQL of their own.
COEF = "SUM(value * cos(2 * pi() * ((k * t) % n) / n)) AS re, -SUM(value * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM sig JOIN len USING (series_id) CROSS JOIN LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) GROUP BY 1, 2"
RANGES = {
    "dft": f"WITH {USERS}, c AS (SELECT series_id, k, {COEF}) SELECT series_id, k AS bin, round(re, 6), round(im, 6), round(re * re + im * im, 6) FROM c",
    "amplitude_spectrum": f"WITH {EVENTS}, c AS (SELECT series_id, k, ANY_VALUE(n) AS n, {COEF}) SELECT series_id, k, round(k * 24.0::DOUBLE / n, 6), round(2 * sqrt(re * re + im * im) / n, 6) FROM c",
    "local_peaks": f"""WITH {EVENTS}, c AS (SELECT series_id, k, {COEF}), p AS (SELECT series_id, k, re * re + im * im AS power FROM c),
q AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM p WINDOW w AS (PARTITION BY series_id ORDER BY k)),
z AS (SELECT series_id, k, power, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, k) AS rank FROM q WHERE power > a AND power > b) SELECT series_id, k, rank, round(power / 1e6, 3) FROM z WHERE rank <= 5""",
    "autocorrelation": f"""WITH {EVENTS}, m AS (SELECT series_id, AVG(value) mu, var_pop(value) v, COUNT(*) n FROM sig GROUP BY 1)
SELECT a.series_id, b.t - a.t AS lag, round(SUM((a.value - mu) * (b.value - mu)) / ANY_VALUE(v) / (ANY_VALUE(n) - (b.t - a.t)), 6) FROM sig a JOIN m USING (series_id) JOIN sig b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + n // 2 GROUP BY 1, 2""",
    "cross_correlation": f"WITH {EVENTS}, {PAIR} SELECT s.series_id, s.t - y.t AS lag, round(SUM(s.value * y.value) / ANY_VALUE(n), 1) FROM sig s JOIN len USING (series_id) JOIN y ON y.series_id = s.series_id GROUP BY 1, 2",
}
COLUMNS = {"dft": "bin re im power", "amplitude_spectrum": "bin freq amplitude", "local_peaks": "bin rank power", "autocorrelation": "lag r", "cross_correlation": "lag r"}


@pytest.mark.parametrize("name", RANGES)
def test_whole_range(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF).select("series_id", *COLUMNS[name].split()).collect(), duck.sql(RANGES[name]).fetchall())
