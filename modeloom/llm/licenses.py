"""License scans with a positional index of rare words.

Templates are word sequences with a mandatory key phrase. Their words' document
frequencies are counted over all documents; each template is looked up by the
rarest word (highest IDF) of its key phrase, which must stand whole, so that no
place is missed. Such a word at place p votes for the template at p minus the
word's offset; at each place voted for, the key phrase is verified and all of
the template's words are compared by relative position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.llm._io import ascii_words, let


@dataclass(frozen=True)
class Template:
    """``key``: the words (first, past the last) that must stand whole."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words = tuple(text.split())
    part = tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return Template(label, words, (at, at + len(part)), base)


# Phrases that licences prescribe, in their own words, and the phrases that identify them.
TEMPLATES = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "granted free of charge to any person obtaining a copy"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("gpl", "gnu general public license"),
    template("gpl-3", "gnu general public license version 3"),
    template("gpl-2", "gnu general public license version 2"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl-3", "gnu affero general public license version 3"),
    template("mpl-2", "mozilla public license version 2"),
    template("mpl-2", "mozilla public license v 2"),
    template("epl", "eclipse public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("cc-by", "creative commons attribution"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
    template("cc0", "cc0 1 0 universal"),
    template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
)
#: Least share of a template's words that must stand at their relative places.
SHARE = 0.8


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each word of the templates occurs; as many rows as the templates have words."""
    words = sorted({w for t in templates for w in t.words})
    has = docs.select(F.explode(F.array_distinct(F.filter(ascii_words(F.col("text")), lambda w: w.isin(words)))).alias("word"))
    return dict.fromkeys(words, 0) | {r[0]: r[1] for r in has.groupBy("word").count().collect()}


def _index(templates: tuple[Template, ...], seen: dict[str, int]) -> tuple[list[str], Column]:
    """The anchors, and postings (word, template's number, offset) as a literal."""
    postings = []
    for n, t in enumerate(templates):
        at = min(range(*t.key), key=lambda i: (seen[t.words[i]], t.words[i], i))
        postings.append((t.words[at], n, at))
    rows = [F.struct(F.lit(w).alias("word"), F.lit(n).alias("t"), F.lit(i).alias("off")) for w, n, i in postings]
    return sorted({p[0] for p in postings}), F.array(*rows)


def _found(w: Column, templates: tuple[Template, ...], anchors: list[str], postings: Column) -> Column:
    """(t, start, share) of every template that stands in words ``w``."""
    about = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _array(t.words).alias("words"),
                F.lit(t.key[0]).alias("k0"), _array(t.words[t.key[0] : t.key[1]]).alias("key"),
            )
            for t in templates
        ]
    )
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(anchors))
    votes = F.flatten(
        F.transform(
            places,
            lambda p: F.transform(
                F.filter(postings, lambda e: e["word"] == F.get(w, p)), lambda e: F.struct(e["t"].alias("t"), (p - e["off"]).alias("start"))
            ),
        )
    )

    def weighed(v: Column) -> Column:
        about_it = F.get(about, v["t"])

        def scored(a: Column) -> Column:
            met = F.filter(a["words"], lambda x, i: x == F.coalesce(F.get(w, v["start"] + i), F.lit("")))
            at = v["start"] + a["k0"]
            key = (at >= 0) & (F.slice(w, F.greatest(at + 1, F.lit(1)), F.size(a["key"])) == a["key"])
            share = F.when(key, F.size(met) / F.size(a["words"])).otherwise(F.lit(0.0))
            return F.struct(v["start"].alias("start"), share.alias("share"), a["label"].alias("label"), a["base"].alias("base"))

        return let(about_it, scored)

    return F.transform(votes, weighed)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is the largest share of a template's words found in place, among
    places that have its key phrase. Null texts have no words; without hits the
    labels are empty strings and the places null. Repeated rows give the same
    result each; an empty table gives none; only doc_id and text are read. No
    shuffle but that of the words' counts.
    """
    anchors, postings = _index(templates, word_frequencies(docs, templates))

    def scan(w: Column) -> Column:
        found = F.when(F.size(w) > 0, _found(w, templates, anchors, postings)).otherwise(F.array().cast("array<struct<start:int,share:double,label:string,base:boolean>>"))

        def summed(all_: Column) -> Column:
            def digest(hits: Column) -> Column:
                starts = F.transform(F.filter(hits, lambda h: h["base"]), lambda h: h["start"])
                return F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.size(starts).cast("long").alias("n_base"),
                    F.array_min(starts).cast("long").alias("first_word"),
                    F.array_max(starts).cast("long").alias("last_word"),
                    F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h["base"]), lambda h: h["label"]))), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",").alias("labels"),
                    F.coalesce(F.array_max(F.transform(all_, lambda h: h["share"])), F.lit(0.0)).alias("score"),
                )

            return let(F.filter(all_, lambda h: h["share"] >= F.when(h["base"], F.lit(1.0)).otherwise(F.lit(share))), digest)

        return let(found, summed)

    return docs.select("doc_id", let(ascii_words(F.col("text")), scan).alias("r")).select("doc_id", "r.*")
