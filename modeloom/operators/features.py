"""Distances, kernels, principal components and nearest neighbours of feature rows (id, features, label)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modeloom.functions.arrays import dot
from modeloom.operators.kernels import spectral
from modeloom.operators.kernels.numeric import round_half_up

#: Pairs that are warped at a time.
DTW_ROWS = 1_000


#: Values of a pairwise operator made at a time: a tile that stays in a core's cache.
TILE = 1 << 15
#: Other rows of a tile at most: a product of matrices is slow on narrow strips.
SIDE = 512
#: Queries whose distances to a batch of rows are held at a time.
QUERIES = 64
#: Rows of a block that meets all blocks at most.
BLOCK = 2048


def _sums(x: np.ndarray, y: np.ndarray, term: Callable) -> np.ndarray:
    """Sums of ``term`` of the features, of every row of x (P, d) beside every row of y (Q, d), added one by one in order."""
    total, part = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for a, b in zip(x.T, np.ascontiguousarray(y.T), strict=True):
        term(a[:, None], b[None, :], out=part)
        total += part
    return total


def _squared_difference(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.subtract(a, b, out=out)
    return np.multiply(out, out, out=out)


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _sums(x, y, np.multiply)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _sums(x, y, _squared_difference)


def _squared_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``_squared``, of the rows a of x and b of y."""
    return sum((_squared_difference(x[a, i], y[b, i]) for i in range(x.shape[1])), np.zeros(len(a)))


#: Sums of two rows' features, and the kernel of those.
KERNELS = {
    "linear": (_dot, lambda s, par: s),
    "polynomial": (_dot, lambda s, par: (s + 1) ** float(par)),
    "rbf": (_squared, lambda d, par: np.exp(-d / (2 * par * par))),
    "exponential": (_squared, lambda d, par: np.exp(-np.sqrt(d) / (2 * par * par))),
    "laplacian": (_squared, lambda d, par: np.exp(-np.sqrt(d) / par)),
    "cauchy": (_squared, lambda d, par: 1 / (1 + d / (par * par))),
    "multiquadric": (_squared, lambda d, par: np.sqrt(d + par * par)),
    "rational": (_squared, lambda d, par: 1 - d / (d + par)),
    "sigmoid": (_dot, lambda s, par: np.tanh(s * par)),
    "euclidean": (_squared, lambda d, par: d),
}
#: Kernels of squared distances with values from 0 to 1, and how much they change at most as the distance does.
SLOPES = {"rational": lambda par: 1 / par if par > 0 else np.inf}


def _kernel(x: np.ndarray, y: np.ndarray, kernel: str, par: float, places: int | None) -> np.ndarray:
    """The kernel of every row of x (P, d) with every row of y (Q, d), rounded to ``places`` if given.

    Rounded values of the kernels in ``SLOPES`` come from a product of matrices
    where its rounding errors can't change a digit, the others from sums in order.
    """
    sums, value = KERNELS[kernel]

    def exact(total: np.ndarray) -> np.ndarray:
        found = value(total, par)
        return found if places is None else round_half_up(found.ravel(), places).reshape(found.shape) + 0.0

    if places is None or kernel not in SLOPES:
        return exact(sums(x, y))
    p, q, unit = (x * x).sum(1), (y * y).sum(1), 10.0**places
    d = x @ y.T
    d *= -2
    d += p[:, None]
    d += q
    scaled = value(np.maximum(d, 0, out=d), par)
    scaled *= unit
    out = np.floor(scaled + 0.5)
    scaled -= out
    # what a distance errs, as in _close, and what the steps after it do
    slack = unit * (SLOPES[kernel](par) * 8 * (x.shape[1] + 8) * np.finfo(float).eps * (q + p.max()) + 16 * np.finfo(float).eps)
    sure = np.abs(scaled, out=scaled) < 0.5 - slack
    out /= unit
    if not sure.all():
        a, b = np.nonzero(~sure)
        if len(a) > out.size / 4:
            return exact(sums(x, y))
        out[a, b] = exact(_squared_pairs(x, y, a, b))
    return out


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the arrays of each length. Arrays that are null or hold a null are in none."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat, held = column.flatten(), np.maximum(sizes, 0)
    starts, whole = np.cumsum(held) - held, sizes >= 0
    if flat.null_count:
        whole[np.repeat(np.arange(len(sizes)), held)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values, out = flat.to_numpy(zero_copy_only=False).astype(float, copy=False), {}
    for size in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == size))
        out[size] = at, values[starts[at][:, None] + np.arange(size)]
    return out


def _spread(rows: DataFrame) -> DataFrame:
    """The rows over two tasks a core, however few files hold them; a task reads its rows in batches."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "id")


def _strips(column: pa.Array, side: int) -> list[tuple[int, int, dict]]:
    """First place, rows and vectors of every ``side`` rows."""
    return [(at, len(part := column.slice(at, side)), _vectors(part)) for at in range(0, len(column), side)]


def _tiles(column: pa.Array, strips: list[tuple[int, int, dict]], height: int, kernel: str, par: float, places: int | None) -> Iterator[tuple[int, int, pa.ListArray]]:
    """Of every ``height`` rows and every strip of others: their first places, and a list of kernels for each row."""
    for at in range(0, len(column), height):
        piece = column.slice(at, height)
        ours = _vectors(piece)
        for first, width, theirs in strips:
            values, lost = np.zeros((len(piece), width)), np.ones((len(piece), width), bool)
            for size in ours.keys() & theirs.keys():
                (i, x), (j, y) = ours[size], theirs[size]
                with np.errstate(all="ignore"):
                    found = _kernel(x, y, kernel, par, places)
                if found.shape == values.shape:
                    values, lost = found, None
                else:
                    values[i[:, None], j], lost[i[:, None], j] = found, False
            ends = pa.array(np.arange(len(piece) + 1, dtype=np.int32) * width)
            yield at, first, pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=None if lost is None else lost.ravel()))


def kernel_matrix(rows: DataFrame, others: DataFrame, kernel: str = "linear", par: float = 1.0, places: int | None = None) -> DataFrame:
    """(id, other_id, value): the kernel of every row with each of a stated set of rows, which a caller keeps small: the driver sends it to all tasks.

    Values are rounded to ``places`` if given. Null where either array is null, has a null, or is of another length.
    """
    right = others.select("id", "features").toArrow()
    names, vectors = (pa.concat_arrays([pa.array([], c.type), *c.chunks]) for c in right.columns)
    kind, other = dict(rows.dtypes)["id"], dict(others.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = max(1, min(SIDE, TILE, len(vectors)))
        parts = _strips(vectors, side)
        for batch in batches:
            for at, first, lists in _tiles(batch.column(1), parts, TILE // side, kernel, par, places):
                n = len(lists)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.full(n, first, np.int32)), lists], names=["id", "first", "values"])

    # a row and tile leave Python as one row, with the place of its first other row: ids of every pair would cost more than the values
    found = _spread(rows.select("id", "features")).mapInArrow(run, f"id {kind}, first int, values array<double>")
    ids = pa.table({"ids": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)})
    named = found.crossJoin(F.broadcast(rows.sparkSession.createDataFrame(ids, f"ids array<{other}>")))  # with one row
    each = named.select("id", "ids", "first", F.posexplode("values").alias("k", "value"))
    return each.select("id", F.get("ids", F.col("first") + F.col("k")).alias("other_id"), "value")


def _whole(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def gram_matrix(rows: DataFrame, kernel: str = "linear", par: float = 1.0, places: int | None = None) -> DataFrame:
    """(id, other_id, value): the kernel of every row with every row, itself among them; values as in ``kernel_matrix``.

    Rows travel in blocks from executor to executor, the driver sees none: the
    rows lie in parts by their ids, and a task takes the blocks of one part with
    those of another. Which blocks a part has may change when it is read again, its rows don't.
    """
    kind, block, side = dict(rows.dtypes)["id"], BLOCK, max(1, min(SIDE, TILE))
    height = TILE // side

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), block):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch.slice(at, block))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    def unpack(column: pa.Array) -> Iterator[pa.RecordBatch]:
        return (pa.ipc.open_stream(packed.as_buffer()).read_next_batch() for packed in column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ours, theirs in zip(*map(unpack, batch.columns), strict=True):
                for at, first, lists in _tiles(ours.column(1), _strips(theirs.column(1), side), height, kernel, par, places):
                    named = [_whole(ours.column(0).slice(at, len(lists))), _whole(theirs.column(0).slice(first, side)), _whole(lists)]
                    yield pa.RecordBatch.from_arrays(named, names=["ids", "others", "values"])

    parts = math.ceil(3 * math.sqrt(rows.sparkSession.sparkContext.defaultParallelism))  # a task for each pair of parts: 9 a core
    # where more parts are made than asked for, their square would be far too many tasks
    blocks = rows.select("id", "features").repartition(parts, "id").coalesce(parts).mapInArrow(pack, "block binary")
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(blocks.select(F.col("block").alias("other")))
    found = pairs.mapInArrow(run, f"ids array<{kind}>, others array<{kind}>, values array<array<double>>")
    lines = found.select("ids", "others", F.posexplode("values").alias("i", "line"))
    each = lines.select(F.get("ids", "i").alias("id"), "others", F.posexplode("line").alias("k", "value"))
    return each.select("id", F.get("others", "k").alias("other_id"), "value")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows: for every pair of features how many rows there are, and the sums of either and of their product, less the first row."""
    n, base, sums, products = 0, None, None, None
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), float)
        if not len(x):
            continue
        if base is None:
            base, sums, products = x[0], np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
        x = x - base
        n, sums, products = n + len(x), sums + x.sum(0), products + x.T @ x
    if n:
        d = len(sums)
        i, j = (k.ravel() for k in np.indices((d, d)))
        columns = (i, j, np.full(d * d, n), base[i], base[j], sums[i], sums[j], products.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "bi", "bj", "si", "sj", "p"])


def _paired(rows: DataFrame) -> DataFrame:
    """(i, j, n, si, sj, p) over all rows: one row a pair of features from each partition."""
    parts = rows.select("features").mapInArrow(_moments, "i long, j long, n long, bi double, bj double, si double, sj double, p double")
    n, bi, bj, si, sj = (F.col(c) for c in ("n", "bi", "bj", "si", "sj"))
    return parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(si + n * bi).alias("si"), F.sum(sj + n * bj).alias("sj"), F.sum(F.col("p") + bi * sj + bj * si + n * bi * bj).alias("p")
    )


def covariance(rows: DataFrame) -> DataFrame:
    """(i, j, value): the sample covariance of the features. Products are summed where the rows are; as many rows as feature pairs meet from each partition."""
    n = F.col("n")
    return _paired(rows).select("i", "j", F.try_divide(F.col("p") - F.col("si") * F.col("sj") / n, n - 1).alias("value"))


def principal_components(rows: DataFrame, n_components: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, components (columns, the largest entry of each positive) and shares of the variance, from one pass; the driver sees a row a feature pair."""
    found = sorted(_paired(rows).collect(), key=lambda r: (r.i, r.j))
    d = max(r.i for r in found) + 1
    mean = np.array([r.sj / r.n for r in found[:d]])
    cov = np.array([(r.p - r.si * r.sj / r.n) / max(r.n - 1, 1) for r in found]).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    vectors = vectors[:, order[:n_components]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return mean, vectors, values[order][:n_components] / values.sum()


def pca(rows: DataFrame, n_components: int = 2) -> DataFrame:
    """(id, pc): each row's coordinates along the first principal components."""
    mean, vectors, _ = principal_components(rows, n_components)
    centred = F.zip_with("features", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    return rows.select("id", F.array(*[dot(centred, F.array(*map(F.lit, v.tolist()))) for v in vectors.T]).alias("pc"))


def _close(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (of y, of x) may be among the k nearest rows of x (P, d) to each of y (Q, d) by Euclidean distance, ties among them.

    Squared distances come from a product of matrices; what its rounding errors can hide is kept.
    """
    p, q = (x * x).sum(1), (y * y).sum(1)
    d = q[:, None] - 2 * (y @ x.T) + p
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (q[:, None] + p)
    return np.nonzero(d - slack <= np.partition(d + slack, k - 1, axis=1)[:, k - 1 : k])


def _warped_close(x: np.ndarray, y: np.ndarray, k: int, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """As ``_close``, by dynamic time warping.

    Distances of samples rounded to whole steps err by a step a sample of the path at most; what that can hide is kept.
    Rows that reach far beyond the queries are kept too, as they would make the steps coarse.
    """
    (_, m), n = x.shape, y.shape[1]
    if not m or not n:
        return np.nonzero(np.ones((len(y), len(x)), bool))
    reach = 4 * (y.max() - y.min()) + np.abs(y).max()
    within = (x.min(1) >= y.min() - reach) & (x.max(1) <= y.max() + reach)
    if k <= within.sum() < len(x):
        near = np.ones((len(y), len(x)), bool)
        near[:, within] = False
        b, a = _warped_close(x[within], y, k, window)
        near[b, np.flatnonzero(within)[a]] = True
        return np.nonzero(near)
    low, high = min(x.min(), y.min()), max(x.max(), y.max())
    bound = (m + n) * (high - low)  # of the k-th distance: the straight path's to some of the rows is at least that
    if m == n and len(x) >= k:
        some = x[: max(k, 512)]
        bound = max(np.partition([np.abs(some - v).sum(1) for v in y], k - 1, axis=1)[:, k - 1].max(), 0.0)
    step = max(1.05 * bound / spectral.DTW_FAR, (high - low) / 6000) or 1.0
    whole = [np.rint((v - low) / step).astype(np.int16) for v in (x, y)]
    d = spectral.dtw_beside(*whole, window).astype(int)
    return np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * (m + n))[:, None])


def _candidates(x: np.ndarray, y: np.ndarray, k: int, close: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``close`` names, and every pair with a row of numbers too large for it or with less than k others."""
    fine, even = (np.abs(v).max(1, initial=0.0) < 1e100 for v in (x, y))
    if fine.sum() < k:
        even = np.zeros_like(even)
    near = np.ones((len(y), len(x)), bool)
    if even.any():
        some = np.zeros((even.sum(), fine.sum()), bool)
        some[close(x[fine], y[even], k)] = True
        near[np.ix_(even, fine)] = some
    return np.nonzero(near)


def _nearest(queries: DataFrame, train: DataFrame, k: int, close: Callable, exact: Callable, alike: bool) -> DataFrame:
    """(other_id, n): the k rows of ``train`` nearest to each of a stated set of query rows, which a caller keeps small: the driver sends it to all tasks.

    ``close`` names the pairs of a batch that may count, ``exact`` gives their
    distances. Each task returns its k of a query at most. Distances are null, and
    come last, where either array is null, has a null or, if ``alike``, another length.
    """
    asked = queries.select("id", "features").toArrow().combine_chunks()
    kind, label, other = dict(train.dtypes)["id"], dict(train.dtypes)["label"], dict(queries.dtypes)["id"]

    def pairs(column: pa.Array, theirs: dict, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(queries, rows, distances) that may count among rows in the order of their ids."""
        ours = _vectors(column)
        for size, (j, y) in theirs.items():
            met = {s: v for s, v in ours.items() if s == size or not alike}
            for i, x in met.values():
                for at in range(0, len(y), QUERIES):
                    b, a = _candidates(x, y[at : at + QUERIES], k, close)
                    yield j[at + b], i[a], exact(x, y[at : at + QUERIES], a, b)
            apart = np.setdiff1d(np.arange(len(column)), np.concatenate([i for i, _ in met.values()]) if met else [])[:k]
            yield np.repeat(j, len(apart)), np.tile(apart, len(j)), None
        lost = np.setdiff1d(np.arange(n), np.concatenate([j for j, _ in theirs.values()]) if theirs else [])
        first = np.arange(len(column))[:k]
        yield np.repeat(lost, len(first)), np.tile(first, len(lost)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = _vectors(pa.concat_arrays(asked["features"].chunks)) if len(asked) else {}
        best = None
        for batch in batches:
            if not len(batch) or not len(asked):
                continue
            rows = pa.Table.from_batches([batch]).sort_by("id").combine_chunks()
            tables = [best] if best is not None else []
            for q, r, d in pairs(pa.concat_arrays(rows["features"].chunks), theirs, len(asked)):
                if len(q):
                    at = pa.array(r)
                    d = pa.nulls(len(q), pa.float64()) if d is None else pa.array(d)
                    tables.append(pa.table({"q": pa.array(q, pa.int64()), "d": d, "id": rows["id"].take(at), "label": rows["label"].take(at)}))
            best = pa.concat_tables(tables).sort_by([(c, "ascending") for c in ("q", "d", "id")])
            q = best["q"].to_numpy()
            best = best.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k)).combine_chunks()
        if best is not None:
            found = pa.table({"other_id": asked["id"].take(best["q"]), "d": best["d"], "id": best["id"], "label": best["label"]})
            yield from found.to_batches(max_chunksize=TILE)

    found = _spread(train.select("id", "features", "label")).mapInArrow(run, f"other_id {other}, d double, id {kind}, label {label}")
    place = W.partitionBy("other_id").orderBy(F.col("d").asc_nulls_last(), "id", "label")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    listed = ranked.groupBy("other_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct("d", "id", "label").alias("n")))).alias("n"))
    return listed.select("other_id", F.transform("n", lambda x: x["n"]).alias("n"))


def _vote(least: DataFrame) -> DataFrame:
    votes = least.select("other_id", F.explode("n.label").alias("label")).groupBy("other_id", "label").agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), F.col("label").isNull().alias("without"), "label"))
    return votes.groupBy("other_id").agg(best["label"].alias("label")).withColumnRenamed("other_id", "id")


def nearest(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(other_id, n): the k rows of ``train`` nearest to each of a stated set of query rows, as structs d (squared), id, label; of equally near ones the smaller id."""

    def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return _squared_pairs(x, y, a, b)

    return _nearest(queries, train, k, _close, exact, True)


def knn_classify(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(id, label): the commonest label among the k nearest, of equally common ones the smallest."""
    return _vote(nearest(queries, train, k))


def knn_dtw(queries: DataFrame, train: DataFrame, k: int = 5, window: int | None = None, step: int = 1) -> DataFrame:
    """(id, label) of a stated set of query series by dynamic time warping over every ``step``-th sample; ties as in knn_classify."""

    def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [slice(i, i + DTW_ROWS) for i in range(0, len(a), DTW_ROWS)]
        return np.concatenate([np.empty(0), *(spectral.dtw_rows(x[a[p]], y[b[p]], window) for p in parts)])

    def thinned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", F.filter("features", lambda x, i: i % step == 0)) if step > 1 else rows

    return _vote(_nearest(thinned(queries), thinned(train), k, lambda x, y, k: _warped_close(x, y, k, window), exact, False))
