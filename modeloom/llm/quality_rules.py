"""Quality rules as a short-circuit cascade.

Each rule says when a text goes. On a sample the rules' costs and rejection
rates are measured, and the cascade asks them in the order of rejections per
cost, so most bad texts never reach the dear rules. The order changes the
work, never a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.llm._io import UPPER, let, space_words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows (about) on which costs and rejection rates are estimated, and how often each is judged to time a rule.
SAMPLE_ROWS, TIMES = 1_000, 5
#: Low bits of a packed shingle hash that hold its place; no text that fits a row has more words.
PLACE_BITS = 28


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def n_dup_lines(text: Column) -> Column:
    """Lines (cut at \\n) with a word that equal an earlier line."""
    worded = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(worded, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are sorted by a hash with their places packed into one long; equal
    neighbours are candidates, which are then sorted and compared as words.
    """
    mask = (1 << PLACE_BITS) - 1

    def windows(w: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(w) - 3)
        packed = F.transform(
            place,
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")),
        )
        return let(F.sort_array(packed), lambda s: exact(w, alike(s)))

    def alike(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            high = F.shiftright(x, PLACE_BITS)
            return (F.shiftright(F.get(s, i + 1), PLACE_BITS) == high) | (F.shiftright(F.get(s, i - 1), PLACE_BITS) == high)

        return F.transform(F.filter(s, same), lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))

    def exact(w: Column, places: Column) -> Column:
        rows = F.transform(places, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))

        def twice(s: Column) -> Column:
            def equal(x: Column, y: Column) -> Column:
                return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

            kept = F.filter(s, lambda x, k: equal(x, F.get(s, k + 1)) | equal(x, F.get(s, k - 1)))
            return let(F.sort_array(F.transform(kept, lambda x: x["i"])), covered)

        return let(F.sort_array(rows), twice)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(words, lambda w: F.when(F.size(w) >= 4, windows(w)).otherwise(F.lit(0)))


class Features:
    """What rules ask of a text, as columns; those in ``known`` are already there."""

    def __init__(self, text: Column, words: Column, **known: Column):
        self.text, self.words, self.known = text, words, known

    def of(self, name: str, make: Callable[[], Column]) -> Column:
        return self.known[name] if name in self.known else make()

    def n_words(self) -> Column:
        return self.of("n_words", lambda: F.size(self.words))

    def n_chars_without(self, chars: str) -> Column:
        return F.char_length(without(self.text, chars))

    def word_chars(self) -> Column:
        return self.of("word_chars", lambda: self.n_chars_without(SPACES))

    def n_symbols(self) -> Column:
        return self.of("n_symbols", lambda: F.char_length(self.text) - self.n_chars_without(SYMBOLS))

    def n_dup_lines(self) -> Column:
        return self.of("n_dup_lines", lambda: n_dup_lines(self.text))

    def n_repeat_words(self) -> Column:
        return self.of("n_repeat_words", lambda: n_repeat_words(self.words))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says from a text's features whether it goes."""

    name: str
    rejects: Callable[[Features], Column]


#: Rules beside the base ones. Words are never weighed by language or vocabulary, so no language is at a disadvantage.
RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols() > 10 * f.n_words()),
    Rule("shouting", lambda f: 100 * (F.char_length(f.text) - f.n_chars_without(UPPER)) > 40 * f.word_chars()),
    Rule("word_length", lambda f: let(f.word_chars(), lambda n: (n > 25 * f.n_words()) | (n < 2 * f.n_words()))),
    Rule("dup_lines", lambda f: 100 * f.n_dup_lines() > 40 * F.size(F.split(f.text, "\n"))),
    Rule("exclaiming", lambda f: 100 * (F.char_length(f.text) - f.n_chars_without("!?")) > 40 * f.n_words()),
)
#: Base rules: fewer than 50 words, or more than half of the words in repeated windows.
FEW = Rule("few_words", lambda f: f.n_words() < 50)
REPEATS = Rule("repeats", lambda f: 100 * f.n_repeat_words() > 50 * f.n_words())


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def rule_order(docs: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    """``rules`` by rejections per second on a sample, best first; equal ones keep their order.

    Rows are drawn alone, each with a chance of SAMPLE_ROWS over their number,
    so the sample's size doesn't grow and it stays where it is read: nothing is
    shuffled. A rule's cost is the time to judge the sample TIMES over, less
    what the same job takes without a rule. The sample only steers the order of
    work.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select("text").sample(share, seed=7)
    sample = sample.select(_text().alias("text"), space_words(F.col("text")).alias("words")).persist()
    again = sample.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("time"))

    def timed(rejects: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        total, rejected = again.agg(F.count("*"), F.count_if(rejects)).first()
        return time.perf_counter() - began, total, rejected

    try:
        sample.count()  # fills the cache
        idle = min(timed(F.length("text") < 0)[0] for _ in range(3))
        worth = []
        for rule in rules:
            seconds, total, rejected = timed(rule.rejects(Features(F.col("text"), F.col("words"))))
            worth.append((rejected / max(1, total)) / max(seconds - idle, 1e-3))
        return [r for _, r in sorted(zip(worth, rules, strict=True), key=lambda x: -x[0])]
    finally:
        sample.unpersist()


def passes(rules: list[Rule], features: Features) -> Column:
    """Whether no rule rejects; a rule is only asked if those before it don't reject."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(features), F.lit(False)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(True))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null and empty texts have no words, fail the base rules and aren't kept.
    Repeated rows are judged alike, each for itself; an empty table gives no
    rows; columns other than doc_id and text are not read. No shuffle.
    """
    order = rule_order(docs, (FEW, *rules, REPEATS))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    f = Features(F.col("text"), F.col("words"))
    counted = docs.select("doc_id", _text().alias("text"), space_words(F.col("text")).alias("words")).select(
        "doc_id", "text", "words", *[getattr(f, name)().cast("long").alias(name) for name in counts]
    )
    known = Features(F.col("text"), F.col("words"), **{name: F.col(name) for name in counts})
    failed = FEW.rejects(known) | REPEATS.rejects(known)
    return counted.select("doc_id", *counts, failed.alias("base_failed"), passes(order, known).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor ``rules`` reject, with all their columns.

    Null and empty texts fail and go; repeated rows are judged alike, each for
    itself; an empty table gives no rows; columns may have any name. The words
    are bound once inside the condition, so no plan writes their expression out
    for every rule.
    """
    order = rule_order(docs, (FEW, *rules, REPEATS))
    bound = F.struct(_text().alias("text"), space_words(F.col("text")).alias("words"))
    return docs.where(let(bound, lambda s: passes(order, Features(s["text"], s["words"]))))
