"""Benchmark decontamination by a prefix-filtered join of word shingles.

The tokens are three-word shingles (shorter for items of one or two words).
One pass over the documents keeps the places of shingles that some benchmark
window has; from them each shingle's frequency over all documents follows.
Since a window must be contained whole, its rarest shingle alone is the
necessary prefix: documents' shingles are joined with these prefixes, places
where the window would stick out are dropped, and the rest is verified by the
shingles that cover the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.llm._io import ascii_words, discard, stage_table, unused

WINDOW = 10
SHINGLE = 3
#: Benchmark shingles up to which they are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, content, width, k): every window of every item that has words; k is the width of its shingles."""
    words = benchmark.select("item_id", ascii_words(F.col("text")).alias("w"), F.lit(window).alias("window")).where(F.size("w") > 0)
    width = F.least("window", F.size("w"))
    starts = words.select("item_id", "w", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("at"))
    return starts.select(
        "item_id", F.array_join(F.slice("w", F.col("at"), F.col("width")), " ").alias("content"), "width", F.least(F.lit(SHINGLE), "width").alias("k")
    ).distinct()


def _shingle(k: int) -> Column:
    """The shingle that starts at an exploded row, empty for the row past the last word, null where it would stick out."""
    parts = [F.col(f"s.{i}") for i in range(k)]
    last = parts[-1]
    return F.when(parts[0] == "", F.lit("") if k == SHINGLE else F.lit(None)).when(last.isNull() | (last == ""), None).otherwise(F.concat_ws(" ", *parts))


def _keys() -> tuple[Column, Column]:
    """k1 and k2, by which a row is judged: its doc_id and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64("text").alias("k2")


def _places(docs: DataFrame, shingles: DataFrame, n_shingles: int, sizes: list[int]) -> DataFrame:
    """(k1, k2, n_words, pos, shingle) wherever a document has a benchmark shingle, and one row with an empty shingle for each document."""
    w = F.col("w")
    words = docs.select(
        *_keys(),
        F.concat(ascii_words(F.col("text")), F.array(F.lit(""))).alias("w"),
    )
    shifted = [w, *(F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))) for i in range(1, SHINGLE))]
    zipped = F.arrays_zip(*shifted)
    rows = words.select("k1", "k2", (F.size(w) - 1).alias("n_words"), F.posexplode(zipped).alias("pos", "s"))
    rows = rows.select("k1", "k2", "n_words", "pos", F.struct(*[F.col("s").getField(n).alias(str(i)) for i, n in enumerate(rows.schema["s"].dataType.names)]).alias("s"))
    each = [rows.select("k1", "k2", "n_words", "pos", _shingle(k).alias("shingle")) for k in sorted({*sizes, SHINGLE})]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    return every.where(F.col("shingle").isNotNull()).join(_small(shingles, n_shingles), "shingle").select("k1", "k2", "n_words", "pos", "shingle")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where benchmark windows occur in documents.

    Returns for each row of ``docs``: doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, contaminated. Null texts
    have no words; items without words match nothing; items shorter than
    ``window`` count whole. Rows with the same doc_id and text give the same
    result each, repeated items (by item_id) count once, an empty benchmark
    gives no hits and an empty table no rows. Other columns are not read.
    """
    return _judged(docs, benchmark, window).drop("k1", "k2")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The rows of ``contamination`` with their keys k1 and k2."""
    windows = stage_table(_windows(benchmark, window), "decon-windows")
    contents = windows.select("content", "width", "k").distinct()
    parts = contents.select("content", "width", "k", F.split("content", " ").alias("w")).select(
        "content", "width", "k", "w", F.explode(F.sequence(F.lit(0), F.col("width") - F.col("k"))).alias("off")
    )
    parts = stage_table(
        parts.select(
            "content", "width", "off",
            F.array_join(F.slice("w", F.col("off") + 1, F.col("k")), " ").alias("shingle"),
            ((F.col("off") % F.col("k") == 0) | (F.col("off") == F.col("width") - F.col("k"))).alias("covers"),
        ),
        "decon-shingles",
    )
    spark = docs.sparkSession
    wanted = parts.select("shingle").unionByName(spark.range(1).select(F.lit("").alias("shingle"))).distinct()
    sizes = [r[0] for r in windows.select("k").distinct().collect()]  # at most three
    n_parts = parts.count()
    places = stage_table(_places(docs, wanted, n_parts, sizes), "decon-places")

    found = places.where("shingle <> ''")
    seen = found.groupBy("shingle").agg(F.count("*").alias("seen"))
    rarity = parts.join(seen, "shingle", "left")
    prefix = rarity.groupBy("content", "width").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("shingle"), F.col("off"))).alias("p")
    )
    prefix = stage_table(
        prefix.where("p.seen > 0").select("content", "width", F.col("p.shingle").alias("shingle"), F.col("p.off").alias("off")),
        "decon-prefix",
    )
    start = F.col("pos") - F.col("off")
    candidates = (
        found.join(_small(prefix, n_parts), "shingle")
        .where((start >= 0) & (start + F.col("width") <= F.col("n_words")))
        .select("k1", "k2", "content", "width", start.alias("start"))
    )
    cover = parts.where("covers").select("content", "off", "shingle")
    need = cover.groupBy("content").agg(F.count("*").alias("need"))
    asked = (
        candidates.join(_small(cover.join(need, "content"), n_parts), "content")
        .select("k1", "k2", (F.col("start") + F.col("off")).alias("pos"), "shingle", "content", "width", "start", "need")
        .distinct()
    )
    whole = (
        asked.join(found.select("k1", "k2", "pos", "shingle").distinct(), ["k1", "k2", "pos", "shingle"])
        .groupBy("k1", "k2", "content", "width", "start", "need")
        .agg(F.count("*").alias("met"))
        .where("met = need")
        .select("k1", "k2", "content", "width", "start")
    )
    whole = stage_table(whole, "decon-occurrences")
    discard(parts, prefix)

    spans = whole.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "width"))).alias("spans"))
    # spans in order of their starts: each adds what lies beyond the reach so far
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(a["upto"], s["start"]))).alias("hit"),
            F.greatest(a["upto"], s["start"] + s["width"]).alias("upto"),
        ),
        lambda a: a["hit"],
    )
    items = (
        whole.select("k1", "k2", "content").distinct()
        .join(_small(windows.select("content", "item_id"), n_parts), "content")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    hits = spans.select("k1", "k2", covered.cast("long").alias("n_hit")).join(items, ["k1", "k2"])
    every = places.where("shingle = ''").select("k1", "k2", F.col("n_words").cast("long").alias("n_words"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(hits, ["k1", "k2"], "left").select(
        "k1",
        "k2",
        F.when(F.col("k1") != -(2**63), F.col("k1")).alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns, whatever these are called.

    Each row is judged by its own text, so rows that share a doc_id, or have
    none, don't decide about each other; rows alike in both fare alike. Null
    texts stay; an empty benchmark drops nothing and an empty table gives no rows.
    """
    a, b = unused(docs, "decon_k1"), unused(docs, "decon_k2")
    bad = _judged(docs, benchmark, window).where("contaminated").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = _keys()
    return docs.join(bad, (k1 == F.col(a)) & (k2 == F.col(b)), "left_anti")
