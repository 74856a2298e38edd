"""Substring dedup by sliding sentence spans.

A run is a stretch of at least LEAST_SENTENCES consecutive sentences with at
least LEAST_WORDS words. Runs are compared over all documents by 96 bits of
their words' hash (of 10^12 different runs any two are alike in these with a
chance of 6 in a million): a run's first place, by (doc_id, text hash, sentence), stays, and
the sentences under all its other places go.

Not every run needs a hash. Take a run R and a sentence s in it, and shrink R
from both ends as long as it stays a run and has s: what is left is the
shortest run that begins at its first sentence, or the shortest that ends at
its last. If R is not at its first place, neither is the smaller run, as R's
first place has it too, at the same distance. So the shortest runs forwards
from each sentence and backwards from each remove the same sentences as all
runs would; a test holds that against all runs of small texts.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm._io import discard, forget, stage_table
from modeloom.llm.bpe import Memo

#: Words and sentences that a run has at least.
LEAST_WORDS, LEAST_SENTENCES = 20, 2
#: One word in how many ends a sentence without a mark.
PICK = 10
MEMO_WORDS = 80_000
#: Texts whose runs are listed at a time.
ROWS = 1_024
TOKEN = re.compile(r"\n|\S+")
MARKS = (".", "!", "?")


def _known(word: str) -> tuple[bytes, bool]:
    """A word as runs are compared by it, and whether a sentence ends after it."""
    low = word.lower().encode("utf-8", "surrogatepass")
    return low, word.endswith(MARKS) or zlib.crc32(low) % PICK == 0


@functools.lru_cache(maxsize=1)
def _words() -> Memo:
    return Memo(_known, MEMO_WORDS)


def sentences(text: str) -> tuple[tuple[bytes, ...], np.ndarray]:
    """A text's words, lower-cased, and how many of them there are up to each sentence's end.

    A sentence ends after a word with . ! or ? at its end, at a line's end, and
    after words that a hash picks, one in PICK: all signs of the place itself,
    so a repeated passage has the same sentences inside it whatever surrounds
    it, with or without marks.
    """
    memo = _words()
    known: list[tuple[bytes, bool]] = []
    lines: list[int] = []
    for line in text.split("\n"):
        known += [memo[w] if len(w) < 64 else _known(w) for w in line.split()]
        lines.append(len(known) - 1)
    if not known:
        return (), np.zeros(0, np.int64)
    words, ends = zip(*known, strict=True)
    over = np.fromiter(ends, bool, len(ends))
    lines = np.array(lines)
    over[lines[lines >= 0]] = True
    return words, np.flatnonzero(over) + 1


def places(text: str) -> list[int]:
    """The characters before which sentences end; white space belongs to the sentence after it."""
    ends, last, over = [], 0, True
    for m in TOKEN.finditer(text):
        token = m[0]
        if token == "\n":
            ends_here = not over
        else:
            ends_here, last, over = _known(token)[1], m.end(), False
        if ends_here:
            ends.append(last)
            over = True
    return ends if over else [*ends, last]


def runs(text: str, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence and sentence past the last (rows of two), and hash (a long and an int), of each shortest run of a text."""
    words, ends = sentences(text)
    upto = np.concatenate([[0], ends])
    n = len(ends)
    at = np.arange(n)
    stop = np.maximum(np.searchsorted(upto, upto[:-1] + least, "left"), at + LEAST_SENTENCES)
    first = np.minimum(np.searchsorted(upto, upto[1:] - least, "right") - 1, at + 1 - LEAST_SENTENCES)
    back = at[first >= 0]
    back = back[stop[first[back]] != back + 1]  # the others are shortest runs forwards too
    ahead = at[stop <= n]
    pairs = np.concatenate([np.stack([ahead, stop[ahead]], 1), np.stack([first[back], back + 1], 1)])
    blob = b" ".join(words)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    spans = begins[upto[pairs]] - [0, 1]
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([digest(blob[a:b]) for a, b in spans.tolist()])
    return pairs, np.frombuffer(hashes, np.int64)[::2], np.frombuffer(hashes, np.int32)[2::4]


def _run_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            found = [runs(text.as_py() or "", least) for text in batch.column(2)]
            at = pa.array(np.cumsum([0, *[len(f[0]) for f in found]]), pa.int32())

            def listed(parts: list[np.ndarray], at=at) -> pa.ListArray:
                return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts)))

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), listed([(f[0][:, 0] << 32) | f[0][:, 1] for f in found]), listed([f[1] for f in found]), listed([f[2] for f in found])],
                names=["id", "t", "place", "h1", "h2"],
            )


def _cut(text: str, gone: list[int]) -> tuple[str, int]:
    ends = places(text)
    starts, before = [0, *ends], [0, *sentences(text)[1].tolist()]
    drop = set(gone)
    kept = [text[starts[i] : ends[i]] for i in range(len(ends)) if i not in drop]
    return "".join([*kept, text[starts[-1] :]]).strip(), sum(before[i + 1] - before[i] for i in drop)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, words = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            places = gone.as_py() or []
            kept, n = _cut(text.as_py(), places) if places else (text.as_py(), 0)
            texts.append(kept)
            counts.append(len(places))
            words.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(words, pa.int64())],
            names=["doc_id", "text", "n_removed", "n_words_removed"],
        )


def repeated_sentences(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, t, gone): sentences to remove, by number, of every row (doc_id, text hash) that has any.

    A run's first place is the smallest (doc_id, text hash, sentence); null ids
    come first. Runs that occur once go by a count of 64 bits of their hash, before
    anything else of them is grouped; a hot run is counted where it is read,
    and the joins' sides are plain exchanges, whose hot hashes can be split.
    """
    parts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text").mapInArrow(
        lambda b: _run_batches(b, least), "id long, t long, place array<long>, h1 array<long>, h2 array<int>"
    )
    parts = stage_table(parts, "spans-runs")
    every = parts.select("id", "t", F.explode(F.arrays_zip("place", "h1", "h2")).alias("r")).select("id", "t", "r.place", "r.h1", "r.h2")
    often = parts.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    often = stage_table(often, "spans-often")
    forget(docs.sparkSession)
    shared = stage_table(every.join(often, "h1", "left_semi").select("id", "t", "place", "h1", "h2"), "spans-shared")
    discard(parts, often)
    place = F.struct("id", "t", "place")
    first = shared.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("kept")).where("n > 1").select("h1", "h2", "kept")
    first = stage_table(first, "spans-first")
    later = shared.join(first, ["h1", "h2"]).where(place > F.col("kept")).select("id", "t", "place")
    covered = later.groupBy("id", "t").agg(F.collect_set("place").alias("places"))

    def numbers(p):
        return F.sequence(F.shiftright(p, 32), p.bitwiseAND(F.lit((1 << 32) - 1)) - 1)

    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("places", numbers))))
    covered = stage_table(covered.select("id", "t", gone.alias("gone")), "spans-gone")
    discard(shared, first)
    return covered


def substring_dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_removed, n_words_removed) of every row, without sentences that an earlier place of a run has.

    Of rows with the same doc_id and text all keep what their first has, as
    they can't be told apart. Null texts stay null and have no runs; texts of
    fewer than ``least`` words, or without white space, have none; an empty
    table gives no rows; other columns are not read. Nothing but hashes and
    numbers of sentences is shuffled, besides each text once, to meet its own
    list.
    """
    gone = repeated_sentences(docs, least)
    found = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    met = found.join(gone, found["id"].eqNullSafe(gone["id"]) & (found["t"] == gone["t"]), "left")
    return met.select(found["doc_id"], found["text"], "gone").mapInArrow(_cut_batches, "doc_id long, text string, n_removed long, n_words_removed long")
