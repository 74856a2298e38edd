import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row string, n_words int, score double, fp string, kept string, k1 int, hash string, gone string, label string"
SYLLABLES = "the an re tion ing es or ed nd ha st er ly ble th wh in ou ti éau ção ß ñ".split()


def prose(r, n):
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for i in range(8, n, 9):
        words[i] += r.choice((".", ".\n", "!", "?"))
    return " ".join(words)


def odd_rows():
    """Documents with every oddity the operators must bear: nulls, empty and very long texts, repeated rows, near and exact copies."""
    r = random.Random(3)
    base = prose(r, 120)
    passage = prose(r, 70) + "."
    long = prose(r, 20_000)
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "  ", 1)), (4, base[:-30] + "changed end here."), (5, prose(r, 90)), (6, None), (7, ""), (8, " \n\t "), (9, "one"),
        (10, long), (11, "x" * 60_000), (12, "ab " * 5_000), (13, prose(r, 60) + ".\n" + passage + "\n" + prose(r, 60)), (14, prose(r, 80) + ".\n" + passage + "\n" + prose(r, 40)),
        (15, prose(r, 60) + "\nReleased under the MIT License.\n" + prose(r, 30)), (16, "Licensed under the Apache License, Version 2.0. cc by-nc CC BY NC cc by nc"),
        (17, "mail a.b@c.de and 10.0.0.1, 4111 1111 1111 1111 or +1 (555) 010-9999! password=7602ad27cf5550de1c " + prose(r, 60)), (18, "a@b@c.d.e 1.2.3.4.5 300.1.1.1 4111-1111-1111-1112 +12"),
        (19, "line\nline\n\nline\n" + prose(r, 60)), (20, "!!! ### $$$ " * 40), (21, "\x00\x01 weird \x1c\x85\xa0 gaps 日本語 👍🏽 İΣς <|endoftext|> <|startoftext|>x"), (None, prose(r, 55)), (5, prose(random.Random(9), 90)),
        (2, base), (6, None), (22, "Thou art " + prose(r, 70)), (23, "1.1.1." * 2_000 + "@" * 2_000 + "+1" * 2_000),
    ]
    return [(d, t, "en", f"src{i % 3}", len(t or ""), "w", None, 5, 0.5, None, "k", 1, "h", "g", "l") for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in odd_rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
