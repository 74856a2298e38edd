"""Personal data: base detectors, and a character-level LSTM with CRF that adds spans.

The tagger reads every character of every text, in overlapping windows. Each
window is decoded, and for each character of the text the window decides in
which it stands farthest from an edge. Runs of tags make spans. Only numbers
are checked, by sums and counts: a card passes Luhn's sum, an address's parts
are at most 255, a phone has 7 to 15 digits. Where a span overlaps a base span,
the base span stays.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm import tagger
from modeloom.llm._io import shared_dir
from modeloom.llm.tagger import BATCH, CAUTION, EPOCHS, HIDDEN, KINDS, TRAIN_WINDOWS, Tagger, char_ids, trained

#: Characters of a window and the step between windows; every character has half the overlap or more on either side of it.
WINDOW, STRIDE = 512, 448
#: Windows decoded at once.
AT_ONCE = 512
BASE = ("email", "ip", "card", "phone")
DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Longest look back for an e-mail's local part at a time.
LOOK = 256
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost e-mail addresses, found from their @ so that long words cost no more than their length."""
    out: list[Span] = []
    free = 0  # the end of the last address
    at = text.find("@")
    while at >= 0:
        start, size = at, LOOK
        while start > free:
            low = max(free, start - size)
            start -= LOCAL.match(text[low:start][::-1]).end()
            if start > low:
                break
            size *= 2
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base detectors' spans by kind, in order; matches that fail their kind's test are dropped."""
    found: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found["phone"].append(("phone", *m.span()))
    return found


def plausible(kind: str, text: str) -> bool:
    """Whether a span's numbers can be of its kind."""
    digits = "".join(DIGIT.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p in KNOWN_BYTES for p in parts)
    return kind != "phone" or 7 <= len(digits) <= 15


KNOWN_BYTES = {str(n) for n in range(256)}


def windows(size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first and last-plus-one character that it decides on) of a text's windows; together they decide on each character once."""
    half = (WINDOW - STRIDE) // 2
    starts = range(0, max(1, size - WINDOW + STRIDE), STRIDE)
    return [(a, min(a + WINDOW, size), a + half if a else 0, size if a == starts[-1] else a + STRIDE + half) for a in starts]


def tags_of(texts: list[str], model: Tagger) -> list[np.ndarray]:
    """The tag of every character of each text."""
    ids = [char_ids(t) for t in texts]
    tags = [np.zeros(len(i), np.int8) for i in ids]
    asked = [(n, *w) for n, i in enumerate(ids) if len(i) for w in windows(len(i))]
    asked.sort(key=lambda w: w[2] - w[1])  # alike in size, so little is padded
    for at in range(0, len(asked), AT_ONCE):
        part = asked[at : at + AT_ONCE]
        rows = np.zeros((len(part), max(b - a for _, a, b, _, _ in part)), np.uint8)
        for row, (n, a, b, _, _) in zip(rows, part, strict=True):
            row[: b - a] = ids[n][a:b]
        for row, (n, a, _, low, high) in zip(model.decode(rows, CAUTION), part, strict=True):
            tags[n][low:high] = row[low - a : high - a]
    return tags


def tagged_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """The tagger's spans of each text, in order; quotes, white space and, but for secrets, marks at their ends don't count."""
    out: list[list[Span]] = []
    for text, row in zip(texts, tags_of(texts, model), strict=True):
        found: list[Span] = []
        if row.any():
            kinds = (row + 1) // 2  # 0 outside, else kind + 1
            before = np.r_[np.int8(0), kinds[:-1]]
            begins = np.flatnonzero((kinds > 0) & ((before != kinds) | (row % 2 == 1)))
            goes_on = np.flatnonzero((kinds == 0) | (row % 2 == 1) | (before != kinds))
            ends = np.r_[goes_on, len(row)][np.searchsorted(goes_on, begins, "right")]
            for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
                kind = KINDS[kinds[s] - 1]
                loose = "\"'.,;:" if kind == "secret" else "\"'.,;:!?"
                while s < e and (text[s].isspace() or text[s] in loose):
                    s += 1
                while e > s and (text[e - 1].isspace() or text[e - 1] in loose):
                    e -= 1
                if e - s > 3 and plausible(kind, text[s:e]):
                    found.append((kind, s, e))
        out.append(found)
    return out


def find(texts: list[str], model: Tagger) -> list[tuple[dict[str, list[Span]], list[Span]]]:
    """For each text its base spans by kind, and all spans: the base ones, and tagged ones that overlap no other."""
    out = []
    order = {name: n for n, name in enumerate(KINDS)}
    for text, tagged in zip(texts, tagged_spans(texts, model), strict=True):
        base = base_spans(text)
        spans = [s for kind in BASE for s in base[kind]]
        taken = sorted((a, b) for _, a, b in spans)
        extra = []
        k = reach = 0
        for kind, a, b in tagged:
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if a >= reach:
                extra.append((kind, a, b))
                reach = b
        out.append((base, sorted([*spans, *extra], key=lambda s: (order[s[0]], s[1]))))
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        out = io.BytesIO()
        np.savez(out, **trained().p)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])


@functools.lru_cache(maxsize=1)
def trained_weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """The tagger's weights, trained by one task (a worker's numpy keeps to one thread) and kept in the shared folder for later sessions.

    The file is named after the training's parameters and this code, so a
    change trains anew.
    """
    mark = zlib.crc32(inspect.getsource(tagger).encode())
    path = f"{shared_dir(spark)}/pii-weights-{TRAIN_WINDOWS}-{EPOCHS}-{BATCH}-{HIDDEN}-{mark:08x}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.range(0, 1, 1, 1).mapInArrow(_train_batches, "weights binary").write.mode("overwrite").parquet(path)
    row = spark.read.schema("weights binary").parquet(path).first()
    with np.load(io.BytesIO(bytes(row[0]))) as saved:
        return dict(saved)


def _model(shared) -> Tagger:
    model = Tagger()
    model.p = shared.value
    return model


def _find_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = _model(shared)
    for batch in batches:
        found = find([t.as_py() or "" for t in batch.column(1)], model)
        counts = [[len(base[kind]) for base, _ in found] for kind in BASE]
        shas = [hashlib.sha256(_listed([s for kind in BASE for s in base[kind]]).encode()).hexdigest() for base, _ in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()),
                pa.array([_listed(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row.

    Spans are code points of the whole text, ends exclusive; ``n_spans`` counts
    base and added ones. Null counts as empty, without spans; repeated rows give
    the same result each; an empty table gives none; only doc_id and text are
    read. No shuffle; the trained weights (about 40 KB) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_weights(docs.sparkSession))
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _find_batches(b, shared),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long",
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans one mark stands."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by marks, and ``n_chars``, if there, counted anew.

    Null texts stay null; repeated rows are each cleaned alike; an empty table
    gives no rows; all other columns pass as they are, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_weights(docs.sparkSession))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = find([t or "" for t in texts], model)
            cleaned = [None if t is None else redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array(cleaned, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out
