"""Relational operators against plain versions."""

import numpy as np
import pytest

from modeloom.operators import correlation, features, smoothing
from modeloom.operators.kernels import numeric, packets, timefreq
from modeloom.sources import generators


@pytest.mark.parametrize("alpha", [0.0, 0.004, 0.03, 0.14, 0.16, 0.9, 1.0])
def test_exponential_smoothing(spark, alpha):
    r = np.random.default_rng(1)
    x = {name: r.normal(5, 3, n) for name, n in (("a", 700), ("b", 1), ("c", 256))}
    rows = [(name, t, float(v)) for name, xs in x.items() for t, v in enumerate(xs)]
    got = smoothing.exponential_smoothing(spark.createDataFrame(rows, "series_id string, t long, value double").repartition(3), alpha)
    found = {(q.series_id, q.t): q.smoothed for q in got.collect()}
    assert len(found) == len(rows)
    for name, xs in x.items():
        y = xs[0]
        for t, v in enumerate(xs):
            y = alpha * v + (1 - alpha) * y if t else v
            assert abs(found[name, t] - y) < 1e-9


def test_covariance_and_components(spark):
    r = np.random.default_rng(2)
    x = r.normal(100, 2, (300, 5)) @ r.normal(size=(5, 5))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, features array<double>, label int").repartition(4)
    want = np.cov(x.T)
    for c in features.covariance(rows).collect():
        assert abs(c.value - want[c.i, c.j]) < 1e-8
    mean, vectors, share = features.principal_components(rows, 5)
    assert np.allclose(mean, x.mean(0)) and np.allclose(vectors.T @ vectors, np.eye(5)) and abs(share.sum() - 1) < 1e-9
    assert np.allclose(np.abs(np.diag(vectors.T @ want @ vectors)) / np.trace(want), share)


def test_nearest_keeps_ties_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, [float(i // 3)], i) for i in range(40)], "id long, features array<double>, label int").repartition(5)
    got = {q.other_id: [n.id for n in q.n] for q in features.nearest(rows.where("id % 20 = 0"), rows, 4).collect()}
    assert got == {0: [0, 1, 2, 3], 20: [18, 19, 20, 15]}


def test_lag_covariance(spark):
    x = np.random.default_rng(3).normal(size=50)
    s = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)] + [("short", 0, 1.0)], "series_id string, t long, value double")
    m = np.lib.stride_tricks.sliding_window_view(x, 6)
    found = {(q.i, q.j): q.value for q in correlation.lag_covariance(s, 6).collect()}
    assert set(found) == {(i, j) for i in range(6) for j in range(6)}
    assert np.allclose([[found[i, j] for j in range(6)] for i in range(6)], m.T @ m)


def test_packets_cut_bands_in_order():
    k = np.arange(4096)
    for level in (1, 2, 3):
        bands = {b: c for lv, b, c, _, _ in packets.kurtogram(np.sin(k), 4) if lv == level}
        assert len(bands) == 2**level
        for b, centre in bands.items():
            x = np.cos(2 * np.pi * centre * k)
            energy = [np.mean(np.abs(packets.packet(x, tuple(n >> j & 1 for j in reversed(range(level))))[20:]) ** 2) for n in range(2**level)]
            assert int(np.argmax(energy)) == b
    for third in range(3):
        x = np.cos(2 * np.pi * (1 + 2 * third) / 12 * k)
        assert int(np.argmax([np.mean(np.abs(z[20:]) ** 2) for z in packets.thirds(x, packets.analytic_filters())])) == third


def test_three_knots_and_ridges():
    x, y = np.array([0.0, 1, 3]), np.array([1.0, 2, 0])
    at = np.linspace(0, 3, 31)
    got = numeric.spline_through_three(x, y, at)
    assert np.allclose(numeric.spline_through_three(x, y, x), y)
    second = np.gradient(np.gradient(got, at), at)
    assert np.allclose(second[2:-2], np.interp(at, x, [0, -2, 0])[2:-2], atol=0.11)
    e = np.zeros((20, 30))
    path = 5 + np.round(4 * np.sin(np.arange(30) / 5)).astype(int)
    e[path, np.arange(30)] = 1
    e[19, :10] = 0.9
    assert (timefreq.ridge(e, 2) == path).all()


def test_wind_record(spark, tmp_path):
    (tmp_path / "wind.csv").write_text("1.5,9\n2.5,9\r\n\n-3,9\n")
    rows = generators.wind_record(spark, str(tmp_path / "wind.csv")).orderBy("t").collect()
    assert [q.value for q in rows] == [1.5, 2.5, -3.0] and rows[1].time == 0.05


@pytest.mark.parametrize("n", [28, 5000])
def test_products_of_counts_and_halves_are_exact(n):
    r = np.random.default_rng(6)
    x, y = r.integers(0, 40, n).astype(float), r.integers(0, 9999, n + 3) / 2
    assert (correlation._products(x, y) == np.correlate(x, y, "full")).all()
    assert (n * (n + 3) > correlation.DIRECT) == (n == 5000)
    z = r.normal(size=n)
    assert np.allclose(correlation._products(z, y), np.correlate(z, y, "full"), rtol=1e-12, atol=1e-7)


def distances(x, y):
    """Sums of squares one by one, and null for what has none."""
    if x is None or y is None or None in x or None in y or len(x) != len(y):
        return None
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += (a - b) * (a - b)
    return total


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Vectors far from zero, with copies, ties, lengths of their own, nulls and samples that are not finite; queries among them."""
    r = np.random.default_rng(7)
    x = [(1e6 + r.integers(0, 4, 6) / 1024).tolist() for _ in range(150)]
    for i, v in {0: None, 7: None, 20: [1.0, None, 3.0, 4.0, 5.0, 6.0], 31: [], 40: [1.0, 2.0], 41: [2.0, 2.0], 60: [1e200] * 6, 63: [1e9] * 6, 64: [-1e200] * 6, 80: [], 101: [float("inf")] * 6}.items():
        x[i] = v
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "id long, features array<double>, label int").coalesce(1)


def test_kernel_matrix_of_odd_vectors(spark, odd_vectors):
    rows, table = odd_vectors
    got = features.kernel_matrix(table, table.where("id % 20 = 0"), "euclidean")
    assert got.rdd.getNumPartitions() > 4  # one file, and still a task for every core
    want = {(i, j): distances(x, y) for i, x, _ in rows for j, y, _ in rows if j % 20 == 0}
    found = {(q.id, q.other_id): q.value for q in got.collect()}
    assert found == want and len(want) == 150 * 8
    halves = features.kernel_matrix(table, table.where("id % 20 = 0"), "euclidean", places=6).collect()
    assert {(q.id, q.other_id): q.value for q in halves} == {p: v if v is None else numeric.round_half_up(np.array([v]), 6)[0] for p, v in want.items()}


def test_kernel_matrix_in_tiles(spark, monkeypatch, odd_vectors):
    _, table = odd_vectors
    whole = features.kernel_matrix(table, table.where("id % 20 = 0"), "linear").collect()
    monkeypatch.setattr(features, "TILE", 3)
    assert sorted(map(str, whole)) == sorted(map(str, features.kernel_matrix(table, table.where("id % 20 = 0"), "linear").collect()))


def test_kernel_matrix_leaves_python_by_tiles(spark, odd_vectors):
    _, table = odd_vectors
    got = features.kernel_matrix(table, table.where("id % 20 = 0"), "rational", 2.0, places=6)
    assert "MapInArrow" in (plan := got._jdf.queryExecution().toString()) and "posexplode(values" in plan
    assert got.dtypes == [("id", "bigint"), ("other_id", "bigint"), ("value", "double")]
    assert features.kernel_matrix(table, table.where("id < 0"), "rational", 2.0, places=6).collect() == []
    named = features.kernel_matrix(table, table.where("id % 20 = 0").selectExpr("'q' || id AS id", "features"), "rational", 2.0, places=6)
    assert {(q.id, int(q.other_id[1:])): str(q.value) for q in named.collect()} == {(q.id, q.other_id): str(q.value) for q in got.collect()}


def test_rational_kernel_by_a_product_of_matrices(monkeypatch):
    def plain(x, y, par, places):
        with np.errstate(all="ignore"):
            d = features._squared(x, y)
            return numeric.round_half_up((1 - d / (d + par)).ravel(), places).reshape(d.shape) + 0.0

    r = np.random.default_rng(11)
    unit = r.normal(size=(90, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    unit[40:50] = unit[3]
    odd = unit.copy()
    odd[5], odd[6, 0], odd[7, 1], odd[8], odd[9] = 1e200, np.nan, np.inf, 1e9, 0
    far, whole = 1e6 + r.integers(0, 4, (80, 6)) / 1024, r.integers(0, 3, (80, 6)).astype(float)
    cases = [(x, 2.0, 6) for x in (unit, odd, far, whole, np.zeros((4, 0)))] + [(whole, 2.0, 1), (whole, 2.0, 2), (unit, 1e-9, 6), (whole, -1.5, 6)]
    for x, par, places in cases:
        with np.errstate(all="ignore"):
            got = features._kernel(x, x[::3], "rational", par, places)
        assert got.tobytes() == plain(x, x[::3], par, places).tobytes()
    halves = features._squared(whole, whole) == 6  # 2 / 8, which rounds up
    assert halves.any() and (features._kernel(whole, whole, "rational", 2.0, 1)[halves] == 0.3).all()

    want = plain(unit, unit, 2.0, 6)
    monkeypatch.setattr(features, "_sums", None)  # common values need no sums in order
    assert (features._kernel(unit, unit, "rational", 2.0, 6) == want).all()


def test_round_half_up_is_sparks_round(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=300), np.arange(-50, 50) / 1e6 + 5e-7, r.integers(0, 9999, 300) / 2.0**7 / 1e3, [1.0000005, 2.5e-7, 5e-7, 1e15 + 0.3, -1e300, 0.0, -0.0, np.inf, np.nan, 4503599627.3704955]])
    want = [q[0] for q in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    np.testing.assert_array_equal(numeric.round_half_up(x, 6), want)


@pytest.mark.parametrize("name, value", [("kernel_laplacian", lambda d: np.exp(-np.sqrt(d) / 2)), ("kernel_rational", lambda d: 2 / (d + 2))])
def test_kernel_queries_of_one_file(spark, name, value):
    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    x = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = entry_points.queries()[name](spark, sf)
    assert got.rdd.getNumPartitions() > 4
    found = {(q.id, q.other_id): q.value for q in got.collect()}
    assert set(found) == {(i, j) for i in x for j in x if j % 20 == 0}
    assert all(abs(v - value(((x[i] - x[j]) ** 2).sum())) < 1e-6 for (i, j), v in found.items())


def test_nearest_of_odd_vectors(spark, odd_vectors):
    rows, table = odd_vectors
    got = {q.other_id: [(n.d, n.id, n.label) for n in q.n] for q in features.nearest(table.where("id % 20 = 0"), table, 5).collect()}
    assert set(got) == set(range(0, 150, 20))
    for j, y, _ in rows:
        if j % 20 == 0:
            each = [(distances(x, y), i, label) for i, x, label in rows]
            assert got[j] == sorted(each, key=lambda n: (n[0] is None, n[0] or 0.0, n[1]))[:5]
    assert features.nearest(table.where("id < 0"), table, 5).collect() == []


def test_nearest_by_warping_of_odd_vectors(spark, odd_vectors):
    from collections import Counter

    from modeloom.operators.kernels import spectral

    rows, table = odd_vectors
    rows, table = [q for q in rows if q[0] != 101], table.where("id != 101")
    got = {q.id: q.label for q in features.knn_dtw(table.where("id % 20 = 0"), table, 5, 2).collect()}
    assert set(got) == set(range(0, 150, 20))

    def warped(x, y):
        return None if x is None or y is None or None in x or None in y else spectral.dtw(np.array(x), np.array(y), 2)

    for j, y, _ in rows:
        if j % 20 == 0:
            each = [(warped(x, y), i, label) for i, x, label in rows]
            votes = Counter(n[2] for n in sorted(each, key=lambda n: (n[0] is None, n[0] or 0.0, n[1]))[:5])
            assert got[j] == min(votes, key=lambda v: (-votes[v], v is None, v or 0))


@pytest.mark.parametrize("window", [None, 0, 2, 16])
def test_filter_of_warping_keeps_the_nearest(window):
    from modeloom.operators.kernels import spectral

    r = np.random.default_rng(9)
    for m, n, scale in ((12, 12, 1.0), (7, 11, 1e-9), (1, 5, 1e12)):
        x, y = r.normal(size=(300, m)) * scale, r.normal(size=(4, n)) * scale
        x[100:104] = 500 * scale
        x[200:210] = x[0]
        d = np.array([[spectral.dtw(a, b, window) for a in x] for b in y])
        near = np.zeros(d.shape, bool)
        near[features._warped_close(x, y, 5, window)] = True
        assert near[d <= np.sort(d, axis=1)[:, 4:5]].all() and near.sum() < d.size / 2
        whole = [(v * 400 / scale).round().clip(-6000, 6000).astype(np.int16) for v in (x, y)]
        want = [[min(spectral.dtw(a.astype(float), b.astype(float), window), spectral.DTW_FAR) for a in whole[0]] for b in whole[1]]
        assert (spectral.dtw_beside(*whole, window, block=70) == want).all()


def test_rational_kernel_of_all_rows(spark):
    import duckdb

    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    x = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = entry_points.queries()["kernel_rational"](spark, sf)
    assert got.dtypes == [("id", "bigint"), ("other_id", "bigint"), ("value", "double")]
    found = [(q.id, q.other_id, q.value) for q in got.collect()]
    assert sorted(q[:2] for q in found) == sorted((i, j) for i in x for j in x)
    assert all(abs(v - 2 / (((x[i] - x[j]) ** 2).sum() + 2)) < 1e-6 for i, j, v in found)
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        assert c.sql(f"SELECT count(*) FROM ({entry_points.oracle_sql()['kernel_rational']})").fetchall() == [(len(x) ** 2,)]


def test_gram_matrix_in_blocks(spark, monkeypatch, odd_vectors):
    rows, table = odd_vectors
    monkeypatch.setattr(features, "BLOCK", 5)
    monkeypatch.setattr(features, "TILE", 6)
    monkeypatch.setattr(features, "SIDE", 3)
    got = features.gram_matrix(table, "euclidean")
    assert "CartesianProduct" in (plan := got._jdf.queryExecution().toString()) and "Broadcast" not in plan
    assert got.rdd.getNumPartitions() > 4
    want = [(i, j, str(distances(x, y))) for i, x, _ in rows for j, y, _ in rows]
    assert sorted((q.id, q.other_id, str(q.value)) for q in got.collect()) == sorted(want)
    ids = table.where("id < 30").selectExpr("nullif('q' || id % 9, 'q4') AS id", "features")  # nulls and ids that occur again
    named = features.gram_matrix(ids, "euclidean").collect()
    known = [("q" + str(i % 9) if i % 9 != 4 else None, x) for i, x, _ in rows[:30]]
    assert sorted(str((q.id, q.other_id, q.value)) for q in named) == sorted(str((i, j, distances(x, y))) for i, x in known for j, y in known)
    assert features.gram_matrix(table.where("id < 0"), "euclidean").collect() == []


def test_gram_matrix_keeps_its_tasks(spark, monkeypatch, odd_vectors):
    from pyspark.sql.classic.dataframe import DataFrame

    rows, table = odd_vectors
    made = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *by: made(df, 40, *by))  # more than asked for
    got = features.gram_matrix(table, "euclidean")
    assert 4 < got.rdd.getNumPartitions() <= 64
    assert sorted((q.id, q.other_id, str(q.value)) for q in got.collect()) == sorted((i, j, str(distances(x, y))) for i, x, _ in rows for j, y, _ in rows)
