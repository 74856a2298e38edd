"""Plain versions of the text operators, on lists of (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def ascii_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    w = space_words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    times = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if space_words(line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), failed)


def licenses(text):
    w = ascii_words(text)
    hits = []
    for phrase, label in BASE_PHRASES.items():
        k = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
    starts = [i for i, _ in hits]
    return (len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def contamination(text, items, window=10):
    w = ascii_words(text)
    inside, found = set(), set()
    for item_id, item in items:
        v = ascii_words(item)
        k = min(window, len(v))
        for s in range(len(v) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[s : s + k]:
                    inside |= set(range(i, i + k))
                    found.add(str(item_id))
    return (len(w), len(inside), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(inside))


def fingerprint(text, width=4):
    w = space_words((text or "").translate(FOLD))
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """prints: list of (doc_id, fp); the smallest doc_id reachable of each row."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            r = root(i)
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(prints))]


def sentences(text):
    """Words (start, end) of each sentence."""
    out, now = [], []
    words = list(re.finditer(r"\S+", text))
    for i, m in enumerate(words):
        now.append(m.span())
        after = text[m.end() : words[i + 1].start()] if i + 1 < len(words) else ""
        if m[0][-1] in ".!?" or zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) % 10 == 0 or "\n" in after:
            out.append(now)
            now = []
    return out + [now] * bool(now)


def repeated(docs, least=20, fewest=2):
    """Numbers of the sentences that go, of each of docs (id, text): all runs of all texts are compared, by their words."""
    places = {}
    for n, (_, text) in enumerate(docs):
        parts = [[text[a:b].lower() for a, b in s] for s in sentences(text or "")]
        for i in range(len(parts)):
            for j in range(i + fewest, len(parts) + 1):
                run = tuple(w for p in parts[i:j] for w in p)
                if len(run) >= least:
                    places.setdefault(run, []).append((n, i, j))
    gone = [set() for _ in docs]
    for found in places.values():
        for n, i, j in found:
            if (n, i) != min((m, k) for m, k, _ in found):
                gone[n] |= set(range(i, j))
    return gone


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    text = text or ""
    out = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [], "phone": [],
    }
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out
