"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

A text's features are hashed one- and two-word sequences, of the words as they
stand and of their shapes (letters, digits and marks in outline), each weighed
by its share of the text. Weights are trained by follow-the-regularised-leader
updates in one task, on a bounded sample of labelled rows whose features were
counted where the texts are, and sent to the workers, where a text is scored by
one sparse dot product.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed features.
BUCKETS = 1 << 18
#: Most labelled rows that are trained on, the first by a hash of doc_id, and how often each is seen.
TRAIN_ROWS = 4_000
#: Most distinct features of all rows trained on (8 bytes each); rows beyond are left out.
TRAIN_FEATURES = 1 << 24
EPOCHS = 4
#: The fold that is kept from training, and the score from which a text counts as good.
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
MEMO_WORDS = 500_000
PAIR = np.uint64(0x9E3779B97F4A7C15)
DIGITS = re.compile(r"\d+")
REPEAT = re.compile(r"(.)\1+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null doc_id isn't, and is not trained on either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def shape(word: str) -> str:
    """A word's outline: X and x for runs of capital and small letters, 0 for digits, marks once."""
    outline = DIGITS.sub("0", word)
    outline = "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in outline)
    return REPEAT.sub(r"\1", outline)[:8]


class Hasher:
    """Words to pairs of 64-bit hashes (word, shape), with a bounded memo."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            plain, outline = word.lower().encode(), shape(word).encode()
            found = (zlib.crc32(plain) << 32 | zlib.crc32(plain, 1), zlib.crc32(outline, 2) << 32 | zlib.crc32(outline, 3))
            self.memo[word] = found
        return found

    def buckets(self, text: str | None) -> np.ndarray:
        """The bucket of every n-gram of a text, repeats included; of a text without words, none."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        memo = self.memo
        both = np.array([memo.get(w) or self.of(w) for w in words], np.uint64)
        parts = []
        for h in (both[:, 0], both[:, 1]):
            parts.append(h)
            pairs = (h[:-1] * PAIR) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
            parts.append(pairs * PAIR)
        same = both[1:, 0] == both[:-1, 0]
        parts.append(np.full(int(same.sum()), 0x5851F42D4C957F2D, np.uint64))
        every = np.concatenate(parts)
        return ((every ^ every >> np.uint64(29)) * PAIR >> np.uint64(64 - 18)).astype(np.int64)


class Ftrl:
    """Logistic regression by per-coordinate FTRL-proximal updates; the last coordinate is the bias."""

    def __init__(self, size: int = BUCKETS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        root = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (root - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        return p


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights (BUCKETS and the bias) from rows of (distinct buckets, their counts, label); without rows, zeros."""
    model = Ftrl()
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, count, y = rows[i]
            model.update(np.append(at, BUCKETS), np.append(10 * count / max(1, count.sum()), 1.0), y)
    return model.weights()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, order, buckets, counts) of rows (label, order, text): a text's features, however long it is at most BUCKETS of them."""
    hasher = Hasher()
    kind = pa.list_(pa.int32())
    for batch in batches:
        found = [np.unique(hasher.buckets(t.as_py()), return_counts=True) for t in batch.column(2)]
        cells = [pa.array([f[k].astype(np.int32) for f in found], kind) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], names=["label", "place", "buckets", "counts"])


def _train_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows, room = [], most
    for batch in batches:
        for y, at, count in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if len(at) <= room:
                room -= len(at)
                rows.append((np.array(at.values, np.int32), np.array(count.values, np.int32), int(y)))
    out = io.BytesIO()
    np.save(out, train(rows))
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most ``most`` labelled rows that aren't held out, the first by a hash of doc_id.

    A doc_id labelled twice counts by its larger label, one with several texts
    by the least of them. Only the weights reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    counted = texts.select(F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"), "text").mapInArrow(
        _count_batches, "label int, place long, buckets array<int>, counts array<int>"
    )
    rows = counted.orderBy("place", "label").limit(most)  # all of them, in order, in one task
    found = rows.mapInArrow(lambda b: _train_batches(b, TRAIN_FEATURES), "weights binary").collect()
    return np.load(io.BytesIO(bytes(found[0][0]))) if found else np.zeros(BUCKETS + 1)


def _score_batches(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    w = weights.value
    hasher = Hasher()
    for batch in batches:
        scores = []
        for text in batch.column(1):
            b = hasher.buckets(text.as_py())
            logit = w[BUCKETS] + (10 * w[b].mean() if len(b) else 0.0)
            scores.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Trained on ``labels`` (doc_id, quality) outside the held-out fold; language,
    source and doc_id are never inputs. Null and empty texts score as the bias
    alone. Repeated rows score alike; without labels every score is one half;
    an empty table gives no rows. The broadcast holds BUCKETS + 1 weights.
    """
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(learn(docs, labels, most))
    scored = docs.select("doc_id", "text").mapInArrow(lambda b: _score_batches(b, weights), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
