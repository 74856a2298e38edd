"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.bpe import MEMO_CHUNK, ODD_GAPS, vocabulary

#: Chunks whose counts a worker keeps; the memo is emptied when full.
MEMO_SIZE = 300_000
#: Characters of texts that are cut into chunks at once.
SLICE_CHARS = 2_000_000
#: Symbols that are merged together at once; more words wait for the next round.
ROUND_SYMBOLS = 2_000_000
NO_RANK = np.iinfo(np.int64).max


class Merger:
    """Merge ranks as sorted arrays: ``keys`` are (left, right) packed in 64 bits."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        pairs = np.array([(a << 32) | b for a, b in self.vocab.merges], np.int64)
        wholes = np.array(list(self.vocab.merges.values()), np.int64)
        order = np.argsort(pairs)
        # ids of wholes rise with their merges' ranks, so they serve as ranks
        self.keys, self.wholes = pairs[order], wholes[order]
        self.symbol_id = np.array(self.vocab.symbol_id, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.wholes[at], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word survive all merges."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = 0
        while at < len(words):
            upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), ROUND_SYMBOLS, "right")))
            out[at:upto] = self._round(words[at:upto], sizes[at:upto])
            at = upto
        return out

    def _round(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        out = sizes.copy()
        codes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if not len(codes):
            return out
        ends = np.cumsum(sizes)
        codes[ends[sizes > 0] - 1] += 256
        sym, word = self.symbol_id[codes], np.repeat(np.arange(len(words)), sizes)
        while len(sym) > 1:
            rank = np.full(len(sym), NO_RANK)
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(sym[:-1], sym[1:]), NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            out[word[first]] = size
            hit = (rank == np.repeat(lowest, size)) & (rank != NO_RANK)
            if not hit.any():
                break
            # in a run of overlapping hits, from the left every other one merges
            place = np.arange(len(sym))
            start = hit & np.r_[True, ~hit[:-1]]
            hit &= (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
            sym = np.where(hit, rank, sym)
            keep = np.r_[True, ~hit[:-1]]
            keep &= np.repeat(lowest != NO_RANK, size)  # words without merges left are done
            out[word[first]] = np.add.reduceat(np.r_[True, ~hit[:-1]].astype(np.int64), first)
            sym, word = sym[keep], word[keep]
        return out


@functools.lru_cache(maxsize=2)
def merger(path: str) -> tuple[Merger, dict[str, int]]:
    """Merge tables, and counts of chunks, kept as long as the worker lives."""
    return Merger(path), {}


def _count(texts: list[str], path: str) -> list[int]:
    """Token counts of a few texts: what the memo lacks is merged together."""
    m, memo = merger(path)
    vocab = m.vocab
    cut = [t.split() if "<|" not in t and not any(c in t for c in ODD_GAPS) else list(vocab.chunks(t)) for t in texts]
    fresh = list({c for chunks in cut for c in chunks if not isinstance(c, int) and c not in memo})
    words = [vocab.words(c) for c in fresh]
    each = list({w for ws in words for w in ws})
    of = dict(zip(each, m.counts(each).tolist(), strict=True))
    seen = {c: sum([of[w] for w in ws]) for c, ws in zip(fresh, words, strict=True)}
    counts = [sum([1 if isinstance(c, int) else memo[c] if c in memo else seen[c] for c in chunks]) for chunks in cut]
    if len(memo) + len(seen) > MEMO_SIZE:
        memo.clear()
    memo |= {c: n for c, n in seen.items() if len(c) <= MEMO_CHUNK}
    return counts


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, counts, part, chars = [], [], [], 0
        for text in batch.column(1):
            part.append(text.as_py() or "")
            sizes.append(len(part[-1].encode()))
            chars += len(part[-1])
            if chars >= SLICE_CHARS:
                counts += _count(part, path)
                part, chars = [], 0
        counts += _count(part, path)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    One row per input row, repeated rows included; null counts as empty, and an
    empty text has no bytes and no tokens. Only ``doc_id`` and ``text`` are
    read. No shuffle; a worker holds a batch and a bounded memo.
    """
    return (
        docs.select("doc_id", "text")
        .mapInArrow(lambda b: _count_batches(b, path), "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
