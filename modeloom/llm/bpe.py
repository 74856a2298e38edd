"""Tokenisation with a public word-level BPE file.

``Vocabulary`` parses the tokenizer file once per process. Texts are cut at
white space first: no pre-token spans white space, so a chunk's tokens never
depend on its neighbours and can be kept in a bounded memo.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Chunks and words whose tokens a worker keeps, twice: those asked for lately and those before.
MEMO_SIZE = 150_000
#: Words of longer chunks are not kept.
MEMO_CHUNK = 64
#: Ids decoded in one pass.
DECODED_AT_ONCE = 100_000
#: str.split() cuts at these, the tokenizer's white space class doesn't.
ODD_GAPS = ("\x1c", "\x1d", "\x1e", "\x1f")

# Letters and numbers newer than Unicode 16, which the tokenizer's own tables don't have.
NEWER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1"
    "\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee"
    "\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f"
    "\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff"
    "\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2"
    "\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed"
    "\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
# Lower case forms that the tokenizer knows and Python 3.13 doesn't.
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


class Vocabulary:
    """The tables of a BPE file with word ends.

    A symbol is a code from 0 to 511: a byte, plus 256 where it ends a word.
    A token is a string of such codes, its id follows its merge's rank.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        # the same pattern for lower-case ASCII, where letters and digits are plain ranges
        self.plain_token = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{NEWER}]]")
        self.pre_token = regex.compile(pattern, regex.V1)
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.symbol_id = [self.ids[c] for c in self.letters] + [self.ids[c + self.suffix] for c in self.letters]
        pieces: list[bytes] = [b""] * size
        self.codes: list[str] = [""] * size
        for piece, i in self.ids.items():
            pieces[i] = piece.encode()
            ends = piece.endswith(self.suffix) and piece != self.suffix
            body = [byte_of[c] for c in (piece[: -len(self.suffix)] if ends else piece) if c in byte_of]
            if ends:
                body[-1] += 256
            self.codes[i] = "".join(map(chr, body))
        for piece, i in self.specials.items():
            pieces[i] = piece.encode()
        # the decoding's offset table: piece i and a space are blob[offsets[i]:offsets[i + 1]]; the last stands for ids without a piece
        spaced = [p + b" " if p else b"" for p in [*pieces, b""]]
        self.offsets = np.cumsum([0, *map(len, spaced)], dtype=np.int32)
        self.blob = np.frombuffer(b"".join(spaced), np.uint8)
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        for left, right in model["merges"]:
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merges[pair] = whole
            self.halves[whole] = pair

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for i, code in enumerate(self.codes):
            if code:
                found.add_word(code, (len(code) - 1, i))
        found.make_automaton()
        return found

    @functools.cached_property
    def shorter(self) -> list[int]:
        """Of each token the longest other token that it begins with, or -1."""
        known = {code: i for i, code in enumerate(self.codes) if code}
        return [next((known[c[:k]] for k in range(len(c) - 1, 0, -1) if c[:k] in known), -1) for c in self.codes]

    @functools.cached_property
    def compatible(self):
        """Whether exact merging leaves the border between two tokens alone."""

        return functools.lru_cache(maxsize=200_000)(lambda a, b: self.meets(a, b, 1 << 40))

    def meets(self, a: int, b: int, below: int) -> bool:
        """Whether no merge earlier than ``below`` crosses the border between two tokens."""
        while True:
            whole = self.merges.get((a, b))
            if whole is not None and whole < below:
                return False
            # undo the later of the two merges; on a tie the left side was merged first
            order = ((a, 1), (b, 0)) if a > b else ((b, 0), (a, 1))
            for token, side in order:
                part = self.halves[token][side]
                if part != token:
                    if side:
                        below, a = token, part
                    else:
                        below, b = token + 1, part
                    break
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of a pre-token: longest matches, shortened or taken back until every border is compatible."""
        n = len(word)
        if n < 2:
            return [self.symbol_id[256 + word[0]]] if n else []
        longest = [-1] * n
        for end, (back, token) in self.automaton.iter(word[:-1].decode("latin-1") + chr(word[-1] + 256)):
            longest[end - back] = token  # ends rise, so the last is the longest
        codes, shorter, compatible = self.codes, self.shorter, self.compatible
        path: list[int] = []
        dead = bytearray(n + 1)
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                upto = at + len(codes[token])
                if not dead[upto] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if upto == n:
                    return path
                at, last, token = upto, token, longest[upto]
            else:  # nothing fits here: this place can't be reached
                dead[at] = 1
                token = path.pop()
                at -= len(codes[token])
                last = path[-1] if path else -1
                token = shorter[token]

    def normalise(self, text: str) -> str:
        """NFC, then each character's own lower case (so no final sigma)."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() else text.replace("Σ", "σ").translate(LATER_LOWER).lower()

    def words(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk without white space."""
        if chunk.isascii():
            low = chunk.lower()
            return [low.encode()] if low.isalpha() else [w.encode() for w in self.plain_token.findall(low)]
        return [w.encode() for w in self.pre_token.findall(self.normalise(chunk))]

    def chunks(self, text: str) -> Iterator[str | int]:
        """White-space chunks of a text, and the ids of special tokens in it."""
        pieces = self.special_cut.split(text) if "<|" in text else [text]
        for piece in pieces:
            if piece in self.specials:
                yield self.specials[piece]
            elif any(c in piece for c in ODD_GAPS):
                yield from regex.split(r"\s+", piece)
            else:
                yield from piece.split()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null counts as empty."""
        out: list[int] = []
        for chunk in self.chunks(text or ""):
            if isinstance(chunk, int):
                out.append(chunk)
            else:
                for word in self.words(chunk):
                    out += self.encode_word(word)
        return out

    def decode_many(self, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """The texts of id sequences that end at ``upto`` in ``ids``, as UTF-8: their pieces joined by spaces, as the file names no decoder.

        Piece i with its space is blob[offsets[i]:offsets[i + 1]]. Ids outside
        the vocabulary have no piece and are skipped.
        """
        ids = np.where((ids >= 0) & (ids < len(self.offsets) - 1), ids, len(self.offsets) - 2)
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(first - (ends - size).astype(np.int32), size)
        text = self.blob[at].tobytes()
        cuts = np.r_[0, ends][upto].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip([0, *cuts], cuts, strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].decode()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo(dict):
    """Values by key, made on demand; when full, what hasn't been asked for since the last time goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def coded_chunks(path: str) -> Memo:
    """The ids, as little-endian bytes, of chunks and special ids, kept as long as the worker lives."""
    vocab = vocabulary(path)
    words = Memo(vocab.encode_word, MEMO_SIZE)

    def coded(chunk: str | int) -> bytes:
        if isinstance(chunk, int):
            ids = [chunk]
        elif len(chunk) > MEMO_CHUNK:
            ids = [i for w in vocab.words(chunk) for i in vocab.encode_word(w)]
        else:
            ids = [i for w in vocab.words(chunk) for i in words[w]]
        return struct.pack(f"<{len(ids)}I", *ids)

    return Memo(coded, MEMO_SIZE)


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes sum to at most ``most``, or single ones beyond it."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _decoded_digests(vocab: Vocabulary, coded: list[bytes]) -> list[str]:
    """Digests of the texts that id sequences decode to; a long one is decoded in slices."""
    if len(coded) == 1:
        found, gap = hashlib.sha256(), b""
        for at in range(0, len(coded[0]), 4 * DECODED_AT_ONCE):
            ids = np.frombuffer(coded[0][at : at + 4 * DECODED_AT_ONCE], "<u4").astype(np.int64)
            found.update(gap + vocab.decode_many(ids, np.array([len(ids)]))[0])
            gap = b" "
        return [found.hexdigest()]
    ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
    return [hashlib.sha256(t).hexdigest() for t in vocab.decode_many(ids, np.cumsum([len(c) // 4 for c in coded]))]


def _digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab, memo = vocabulary(path), coded_chunks(path)
    for batch in batches:
        coded = []
        for text in batch.column(1):
            text = text.as_py() or ""
            simple = "<|" not in text and not any(c in text for c in ODD_GAPS)
            coded.append(b"".join([memo[c] for c in (text.split() if simple else vocab.chunks(text))]))
        decoded = [d for a, b in _groups([len(c) // 4 for c in coded], DECODED_AT_ONCE) for d in _decoded_digests(vocab, coded[a:b])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array(decoded, pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode each row's whole text, decode the ids, and return digests of both.

    One row per input row (repeated rows stay); a null or empty text has no
    tokens and the digests of the empty string. Only ``doc_id`` and ``text``
    are read, so extra columns can't clash. No shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _digest_batches(batches, path),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        ids = [vocab.encode(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row; null or empty texts have an empty list."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _encode_batches(b, path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
