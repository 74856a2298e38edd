"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by population count (of both 32-bit
halves). Tile pairs whose counts differ beyond the radius can't hold a link and
are never formed; within a pair, blocks sorted by the counts of 16-bit quarters
are skipped by the same bound, and the rest is compared exactly with numpy's
exclusive-or and bit counts. A task holds one tile in memory and streams its
partner tiles past it in pieces; which tile of a pair stays and which travels
is settled by their numbers' parity, so both ends of the list get their share.
A tile returns a spanning forest, never all links, so a group of copies costs
rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm._io import discard, stage_table, unused
from modeloom.llm.components import connected_components

SEED = 42
#: Smallest and largest rows of a tile; between them a tile holds a sixty-fourth of all.
TILE_ROWS = (2_048, 1 << 20)
#: Fingerprints of a travelling piece, and how many are compared at once.
PIECE, AT_ONCE = 1_024, 16_384
BLOCK = 256
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingle hashes whose bits are counted at a time.
HASHES_AT_ONCE = 200_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's ``width``-word shingles, each as often as it occurs; 0 without words."""
    if not text:
        return 0
    words = text.encode().translate(LOWER_AZ).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = max(1, n - width + 1)
    stops = ends[-k:].tolist()
    starts = [0, *(ends[: k - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, k, HASHES_AT_ONCE):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + HASHES_AT_ONCE], stops[at : at + HASHES_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > k, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
        keys = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(found.view(np.int64))], names=[*keys, "fp"])


def fingerprints(docs: DataFrame, width: int = 4, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, or (doc_id, hash, fp) with a hash of the text; fp is the fingerprint as a signed long."""
    keys = ["doc_id", *[F.xxhash64("text").alias("hash")] * hashed]
    return docs.select(*keys, "text").mapInArrow(lambda b: _fingerprint_batches(b, width), f"doc_id long, {'hash long, ' * hashed}fp long")


def _halves(fp: str = "fp") -> tuple:
    low = F.bit_count(F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)))
    return low.alias("low"), (F.bit_count(F.col(fp)) - low).alias("high")


def _plan(cells: list[tuple[int, int, int]], rows: int, radius: int) -> tuple[dict, list[tuple[int, int, int, int, int, int]]]:
    """Units of the (low, high) cells, as (unit, first tile, tiles), and the pairs of units that may hold links.

    A cell larger than a tile is a unit of several tiles, which a hash deals
    out; smaller ones share a tile. At most 33 * 33 cells are ever passed, so
    there are no more units, however many tiles they have.
    """
    units: dict[tuple[int, int], tuple[int, int, int]] = {}
    n_units = n_tiles = room = 0
    for low, high, n in sorted(cells, key=lambda c: (c[0] + c[1], c[0])):
        parts = -(-n // rows)
        if parts > 1 or n > room:
            units[low, high] = (n_units, n_tiles, parts)
            n_units, n_tiles = n_units + 1, n_tiles + parts
            room = rows - n if parts == 1 else 0
        else:
            units[low, high] = (n_units - 1, n_tiles - 1, 1)
            room -= n
    near = set()
    for (low, high), own in units.items():
        for x in range(low - radius, low + radius + 1):
            rest = radius - abs(x - low)
            for y in range(high - rest, high + rest + 1):
                if (x, y) in units:
                    near.add((*own, *units[x, y]))
    return units, sorted(near)


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fp >> np.uint64(s) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], axis=1).astype(np.int16)


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by their quarters' counts; each block's first row and its least and largest counts."""
    q = _quarters(fp)
    order = np.lexsort((q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
    first = np.arange(0, len(fp), BLOCK)
    q = q[order]
    return order, first, np.minimum.reduceat(q, first), np.maximum.reduceat(q, first)


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels after links x-y: the larger root is hooked on the smaller until every link lies within one tree."""
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        if not len(x):
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


class Home:
    """A tile that stays: its fingerprints in blocks, and the forest of links found so far."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.radius = radius
        order, self.first, self.least, self.most = _blocks(fps)
        self.fps = fps[order]
        self.label = np.arange(len(fps))
        for i in range(len(self.first)):
            rows = self.fps[self.first[i] : self.first[i] + BLOCK]
            for j, x, y in self._near(rows, self.least[i], self.most[i]):
                if j >= i:
                    self.label = _join(self.label, self.first[i] + x, self.first[j] + y)

    def _near(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray):
        """(block, places in ``rows``, places in the block) of the links between a block and the tile's."""
        gap = np.maximum(0, np.maximum(self.least - most, least - self.most)).sum(axis=1)
        for j in np.flatnonzero(gap <= self.radius).tolist():
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ self.fps[None, self.first[j] : self.first[j] + BLOCK]) <= self.radius)
            if len(x):
                yield j, x, y

    def meet(self, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from travelling fingerprints to one of the tile's that each is linked to; the tile's forest takes the rest."""
        order, first, least, most = _blocks(guests)
        guests = guests[order]
        host = np.full(len(guests), -1)
        for i in range(len(first)):
            for j, x, y in self._near(guests[first[i] : first[i] + BLOCK], least[i], most[i]):
                x, y = x + first[i], y + self.first[j]
                fresh = host[x] < 0
                host[x[fresh]] = y[fresh]
                self.label = _join(self.label, host[x], y)
        met = np.flatnonzero(host >= 0)
        return guests[met], self.fps[host[met]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.fps[at], self.fps[self.label[at]]


def _edge_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges from rows (home, guest, fps) that come sorted by home, a home's own pieces before its guests'."""
    at: int | None = None
    own: list[np.ndarray] = []
    home: Home | None = None
    waiting: list[np.ndarray] = []

    def settled() -> Home:
        nonlocal home
        if home is None:
            home = Home(np.concatenate(own), radius)
        return home

    def meet() -> Iterator[pa.RecordBatch]:
        if waiting:
            yield _edge_batch(*settled().meet(np.concatenate(waiting)))
            waiting.clear()

    for batch in batches:
        for tile, guest, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if tile != at:
                yield from meet()
                if own:
                    yield _edge_batch(*settled().forest())
                at, own, home = tile, [], None
            (waiting if guest else own).append(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, waiting)) >= AT_ONCE:
                yield from meet()
    yield from meet()
    if own:
        yield _edge_batch(*settled().forest())


def links(distinct: DataFrame, radius: int, tile_rows: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints as all links at ``radius`` differing bits do.

    ``distinct`` has every fingerprint once, in ``fp``. The driver sees a count
    for each pair of half counts (at most 1,089 rows) and pairs of units (at
    most 41 for each); tiles are paired on the executors.
    """
    spark = distinct.sparkSession
    cells = [tuple(r) for r in distinct.groupBy(*_halves()).count().collect()]
    total = sum(c[2] for c in cells)
    if total < 2:
        return spark.createDataFrame([], "u long, v long")
    rows = tile_rows or min(max(total // 64, TILE_ROWS[0]), TILE_ROWS[1])
    units, near = _plan(cells, rows, radius)
    where = spark.createDataFrame([(*cell, *u) for cell, u in units.items()], "low int, high int, unit int, first long, parts long")
    meets = spark.createDataFrame([(u, first, parts) for u, _, _, _, first, parts in near], "unit int, to_first long, to_parts long")
    pieces = (
        distinct.select("fp", *_halves())
        .join(F.broadcast(where), ["low", "high"])  # at most 1,089 rows
        .withColumn("tile", F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")))
        .withColumn("piece", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(-(-rows // PIECE))))
        .groupBy("unit", "tile", "piece")
        .agg(F.collect_list("fp").alias("fps"))  # about PIECE rows
    )
    own = pieces.select(F.col("tile").alias("home"), F.lit(False).alias("guest"), "fps")
    home, tile = F.col("home"), F.col("tile")
    travels = (
        pieces.join(F.broadcast(meets), "unit")  # at most 41 rows for each of 1,089 units
        .select("tile", "fps", F.explode(F.sequence("to_first", F.col("to_first") + F.col("to_parts") - 1)).alias("home"))
        .where(((home < tile) & ((home + tile) % 2 == 0)) | ((home > tile) & ((home + tile) % 2 == 1)))
        .select("home", F.lit(True).alias("guest"), "fps")
    )
    n_tiles = max(first + parts for _, first, parts in units.values())
    return (
        own.unionByName(travels)
        .repartition(max(1, min(n_tiles, 4 * spark.sparkContext.defaultParallelism)), "home")
        .sortWithinPartitions("home", "guest")
        .mapInArrow(lambda b: _link_batches(b, radius), "u long, v long")
    )


def _members(distinct: DataFrame, radius: int, tile_rows: int | None = None) -> DataFrame:
    """(fp, root) of every fingerprint that is linked to another; the root is one of the component's fingerprints."""
    stars = connected_components(links(distinct, radius, tile_rows))
    return stage_table(
        stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct()),
        "simhash-members",
    )


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, tile_rows: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; a
    component is what links reach, and its id the smallest doc_id in it. Texts
    that are null or have no words share fingerprint zero and are linked like
    others. Repeated rows stay, with the same component; a row whose doc_id is
    null gets its component's id but lends it none. An empty table gives none.
    """
    prints = stage_table(fingerprints(docs, width), "simhash-fp")
    distinct = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    member = _members(distinct, radius, tile_rows)
    named = member.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    label = stage_table(member.join(named, "root").select("fp", "component_id"), "simhash-components")
    # a group of exact copies is one fp: the label table is small beside the rows, and skewed joins are split
    full = stage_table(
        distinct.join(label, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-labels"
    )
    discard(distinct, member, label)
    return prints.join(full, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one with the smallest doc_id.

    Rows without a doc_id come last, and stay where a component has no other;
    of different texts under one doc_id each is a row of its own component, and
    within one component the smaller text hash stays. Of rows alike in doc_id
    and text any one stays. Null and word-less texts are one component. An
    empty table gives none; columns may have any name.
    """
    prints = stage_table(fingerprints(docs, width, hashed=True), "simhash-fp")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    distinct = stage_table(prints.groupBy("fp").agg(F.min(first).alias("least")), "simhash-distinct")
    member = _members(distinct, radius)
    key, same, hashed = unused(docs, "kept_id"), unused(docs, "kept_hash"), unused(docs, "text_hash")
    rooted = distinct.join(member, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    stays = stage_table(rooted.agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(key), F.col("least.hash").alias(same)), "simhash-stays")
    discard(prints, distinct, member)
    rows = docs.withColumn(hashed, F.xxhash64("text"))
    kept = rows.join(stays, rows["doc_id"].eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(same)), "left_semi")
    return kept.dropDuplicates(["doc_id", hashed]).select(*docs.columns)
