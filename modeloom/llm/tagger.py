"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Its cells squash by x / (1 + |x|), for gates moved to 0..1, in place of tanh and
the logistic curve: numpy does that in a sixth of the time.
"""

from __future__ import annotations

import functools
import random
import string

import numpy as np

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
#: Tag 0 is outside; a kind's first character has tag 1 + 2k, its others 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
#: Characters of a labelled window.
WINDOW = 128
HIDDEN, EMBEDDED = 12, 12
#: Printable ASCII has ids from 3; 0 pads, 1 is any letter beyond ASCII, 2 anything else.
CHARS = 3 + 95
#: Labelled windows made for training, passes over them, and windows of an update.
TRAIN_WINDOWS, EPOCHS, BATCH = 6_000, 12, 64
#: What a span must score above its absence: the labelled windows have far more spans than texts do.
CAUTION = 0.25


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((codes >= 32) & (codes < 127), codes - np.uint32(29), np.where(codes >= 0xAA, 1, 2)).astype(np.uint8)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of _squash where it has the value y."""
    return (1 - np.abs(y)) ** 2


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * _squash(0.5 * x) + 0.5


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.25 * _slope(2 * y - 1)


class Tagger:
    """Weights: emb, wx, wh, b (both directions stacked), out, bias and the CRF's transitions, begin and end scores."""

    def __init__(self, seed: int = 3, hidden: int = HIDDEN, embedded: int = EMBEDDED, dtype=np.float32):
        rng = np.random.default_rng(seed)

        def near(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(dtype)

        self.p = {
            "emb": near(CHARS, embedded, scale=0.3),
            "wx": near(2, embedded, 4 * hidden, scale=1 / np.sqrt(embedded)),
            "wh": near(2, hidden, 4 * hidden, scale=1 / np.sqrt(hidden)),
            "b": np.zeros((2, 1, 4 * hidden), dtype),
            "out": near(2 * hidden, TAGS, scale=1 / np.sqrt(2 * hidden)),
            "bias": np.zeros(TAGS, dtype),
            "trans": np.zeros((TAGS, TAGS), dtype),
            "begin": np.zeros(TAGS, dtype),
            "end": np.zeros(TAGS, dtype),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 3  # gates open to memory at first

    def _run(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
        """Emission scores (batch, time, tags) of rows of character ids, and what training needs."""
        p = self.p
        n = p["wh"].shape[1]
        both = np.stack([ids, ids[:, ::-1]])  # the second direction reads backwards
        x = p["emb"][both]
        drive = x @ p["wx"][:, None] + p["b"][:, None]
        h = np.zeros((2, len(ids), n), x.dtype)
        c = np.zeros_like(h)
        states = np.empty((2, *ids.shape, n), x.dtype)
        trace = []
        for t in range(ids.shape[1]):
            z = drive[:, :, t] + h @ p["wh"]
            gates, g = _gate(z[..., : 3 * n]), _squash(z[..., 3 * n :])
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            before, c = c, f * c + i * g
            tc = _squash(c)
            if keep:
                trace.append((i, f, o, g, before, tc, h))
            h = o * tc
            states[:, :, t] = h
        joint = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        return joint @ p["out"] + p["bias"], {"both": both, "x": x, "trace": trace, "joint": joint}

    @functools.cached_property
    def _ready(self) -> tuple[np.ndarray, np.ndarray]:
        """What each character (a column) and each state add to the gates; gates' rows are halved, so one squashing serves all of them."""
        p = self.p
        n = p["wh"].shape[1]
        half = np.r_[np.full(3 * n, 0.5), np.ones(n)].astype(p["wh"].dtype)
        drive, wh = (p["emb"] @ p["wx"] + p["b"]) * half, p["wh"] * half
        return np.ascontiguousarray(drive.transpose(0, 2, 1)), np.ascontiguousarray(wh.transpose(0, 2, 1))

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores (time, tags, batch) of rows of character ids."""
        p = self.p
        table, wh = self._ready
        n = wh.shape[2]
        rows, steps = ids.shape
        along = np.ascontiguousarray(ids.T)
        states = np.empty((2, steps, n, rows), wh.dtype)
        h, c, tmp = (np.zeros((2, n, rows), wh.dtype) for _ in range(3))
        z = np.empty((2, 4 * n, rows), wh.dtype)
        drive = np.empty_like(z)
        gates, i, f, o, g = z[:, : 3 * n], z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        for t in range(steps):
            np.matmul(wh, h, out=z)
            np.take(table[0], along[t], axis=1, out=drive[0], mode="clip")
            np.take(table[1], along[steps - 1 - t], axis=1, out=drive[1], mode="clip")
            z += drive
            np.abs(z, out=drive)
            drive += 1
            z /= drive
            gates += 1  # twice a gate: the halves are made up for below
            c *= f
            np.multiply(i, g, out=tmp)
            c += tmp
            c *= 0.5
            np.abs(c, out=tmp)
            tmp += 1
            np.divide(c, tmp, out=tmp)
            np.multiply(o, tmp, out=h)
            h *= 0.5
            states[0, t], states[1, steps - 1 - t] = h[0], h[1]
        e = np.matmul(p["out"][:n].T, states[0])
        e += np.matmul(p["out"][n:].T, states[1])
        e += p["bias"][:, None]
        return e

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients.

        Sums over paths are products of the transitions' exponentials, scaled
        to one at each step.
        """
        p = self.p
        e, kept = self._run(ids, True)
        rows, steps, _ = e.shape
        n = p["wh"].shape[1]
        ways, last = np.exp(p["trans"]), np.exp(p["end"])
        top = e.max(2)
        odds = np.exp(e - top[:, :, None])
        ahead, scale = np.empty_like(e), np.empty_like(top)
        for t in range(steps):
            now = odds[:, t] * (ahead[:, t - 1] @ ways if t else np.exp(p["begin"]))
            scale[:, t] = now.sum(1)
            ahead[:, t] = now / scale[:, t, None]
        ending = ahead[:, -1] @ last
        back = np.empty_like(e)
        back[:, -1] = last / ending[:, None]
        onward = np.empty_like(e)  # what each tag's own odds and the rest of the path make of a step
        for t in range(steps - 1, 0, -1):
            onward[:, t] = odds[:, t] * back[:, t] / scale[:, t, None]
            back[:, t - 1] = onward[:, t] @ ways.T
        whole = np.log(scale).sum(1) + top.sum(1) + np.log(ending)
        at = np.arange(rows)[:, None], np.arange(steps)[None], tags
        told = e[at].sum(1) + p["begin"][tags[:, 0]] + p["end"][tags[:, -1]] + p["trans"][tags[:, :-1], tags[:, 1:]].sum(1)

        de = ahead * back
        grad = {"begin": de[:, 0].sum(0), "end": de[:, -1].sum(0)}
        grad["trans"] = ways * np.tensordot(ahead[:, :-1], onward[:, 1:], ((0, 1), (0, 1)))
        np.subtract.at(grad["trans"], (tags[:, :-1], tags[:, 1:]), 1)
        np.subtract.at(grad["begin"], tags[:, 0], 1)
        np.subtract.at(grad["end"], tags[:, -1], 1)
        de[at] -= 1

        grad["bias"] = de.sum((0, 1))
        grad["out"] = np.tensordot(kept["joint"], de, ((0, 1), (0, 1)))
        dj = de @ p["out"].T
        dh_in = np.stack([dj[..., :n], dj[:, ::-1, n:]])
        grad["wh"] = np.zeros_like(p["wh"])
        dz_all = np.empty((2, rows, steps, 4 * n), e.dtype)
        dh = np.zeros((2, rows, n), e.dtype)
        dc = np.zeros_like(dh)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, h_before = kept["trace"][t]
            dh = dh + dh_in[:, :, t]
            dc = dc + dh * o * _slope(tc)
            dz = np.concatenate([dc * g * _gate_slope(i), dc * before * _gate_slope(f), dh * tc * _gate_slope(o), dc * i * _slope(g)], axis=2)
            dz_all[:, :, t] = dz
            grad["wh"] += h_before.transpose(0, 2, 1) @ dz
            dh = dz @ p["wh"].transpose(0, 2, 1)
            dc = dc * f
        flat = dz_all.reshape(2, rows * steps, 4 * n)
        grad["b"] = flat.sum(1, keepdims=True)
        grad["wx"] = kept["x"].reshape(2, rows * steps, -1).transpose(0, 2, 1) @ flat
        dx = flat @ p["wx"].transpose(0, 2, 1)
        grad["emb"] = np.zeros_like(p["emb"])
        np.add.at(grad["emb"], kept["both"].reshape(-1), dx.reshape(-1, dx.shape[-1]))
        return float((whole - told).mean()), {k: v / rows for k, v in grad.items()}

    def decode(self, ids: np.ndarray, caution: float = 0.0) -> np.ndarray:
        """The best tag sequence of every row (Viterbi); rows where no tag can pay need no path."""
        e = self.emissions(ids)
        trans, begin, end = self._cautious(caution)
        steps, n_tags, _ = e.shape
        tags = np.zeros(ids.shape, np.int8)
        hot = np.flatnonzero(self._most(e, trans, begin, end) > 0)
        if not len(hot):
            return tags
        e = np.ascontiguousarray(e[:, :, hot])
        best = begin[:, None] + e[0]
        came = np.empty(e.shape, np.int8)
        ways = np.empty((n_tags, n_tags, len(hot)), e.dtype)
        for t in range(1, steps):
            np.add(trans.T[:, :, None], best, out=ways)
            came[t] = ways.argmax(1)
            best = ways.max(1)
            best += e[t]
        path = np.empty((steps, len(hot)), np.int8)
        path[-1] = (best + end[:, None]).argmax(0)
        at = np.arange(len(hot))
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t, path[t], at]
        tags[hot] = path.T
        return tags

    def _cautious(self, caution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transitions, begins and ends where a step from outside into a span costs ``caution`` more."""
        trans, begin = self.p["trans"].copy(), self.p["begin"].copy()
        trans[0, 1:] -= caution
        begin[1:] -= caution
        return trans, begin, self.p["end"]

    @staticmethod
    def _most(e: np.ndarray, trans: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each row a bound on what a path with tags can score above the one that is outside throughout.

        It is the best score of a relaxed model, in which a kind's tags follow
        each other as in the true one and steps between kinds, into and out of
        spans cost what the cheapest of their sort does.
        """
        gain = trans - trans[0, 0]
        into_b, into_i, out = gain[0, 1::2, None], gain[0, 2::2, None], float(gain[1:, 0].max())
        within = [gain[1::2, 2::2].diagonal()[:, None].copy(), gain[2::2, 2::2].diagonal()[:, None].copy()]
        apart = gain[1:, 2::2].copy()
        for k in range(apart.shape[1]):
            apart[2 * k : 2 * k + 2, k] = -np.inf
        to_b, to_i = float(gain[1:, 1::2].max()), float(apart.max())
        b = e[0, 1::2] - e[0, 0] + (begin[1::2] - begin[0])[:, None]
        i = e[0, 2::2] - e[0, 0] + (begin[2::2] - begin[0])[:, None]
        best = np.maximum(b.max(0), i.max(0))
        most, other = best.copy(), np.empty_like(b)
        for now in e[1:]:
            # from the step before: a kind's own tags, any other's, or outside
            np.add(b, within[0], out=other)
            i += within[1]
            np.maximum(i, other, out=i)
            np.maximum(i, np.maximum(best + to_i, into_i), out=i)
            i += now[2::2]
            i -= now[0]
            np.subtract(now[1::2], now[0], out=b)
            b += np.maximum(best + to_b, into_b)
            best = np.maximum(b.max(0), i.max(0))
            np.maximum(most, best, out=most)
        return np.maximum(most + out, best + float((end[1:] - end[0]).max()))


SYLLABLES = "the an re tion ing es or ed nd ha st er ly ble th wh in ou ti éau que ment ção ó ía ß ü ch ge der die und la el ner zo mar vi pa lle ñ".split()


def _pick(r: random.Random, letters: str, low: int, high: int | None = None) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(low, high or low)))


def _word(r: random.Random) -> str:
    if r.random() < 0.5:
        w = "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 3, 4, 5, 6))))
    else:
        w = _pick(r, r.choice((string.ascii_lowercase, "aeionrstlàéèçñóäöüß", "абвгдежз")), 1, 14)
    return r.choice((w, w, w, w, w.capitalize(), w.upper())) + r.choice(("",) * 8 + (",", ".", "!", ":", "!!", "***", "###", "%%%", "&&&", "$$$", ";"))


DIGITS = string.digits


def _number(r: random.Random) -> str:
    """Digits and marks that identify no one."""
    d, m, y = f"{r.randint(1, 28):02d}", f"{r.randint(1, 12):02d}", f"{r.randint(1900, 2099)}"
    return r.choice((
        f"{r.randint(0, 99)}", y, f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", f"{d}.{m}.{y}", f"{y}-{m}-{d}", f"{d}/{m}/{y}",
        f"{y}/{d}", f"{y}-{int(y) + 5}", f"#{r.randint(1, 9999)}", f"{r.randint(1, 999)},{r.randint(0, 999):03d}", f"{r.randint(1, 999)},{r.randint(0, 999):03d}.{d}", f"{r.randint(1, 99)}%", f"{r.randint(1, 9)}/{r.randint(2, 9)}",
        f"{r.choice(string.ascii_uppercase)}{r.randint(1, 99)}", f"@{_word(r)}", f"${r.randint(1, 999)}.{r.randint(0, 99):02d}", f"978-{r.randint(0, 9)}-{_pick(r, DIGITS, 2)}-{_pick(r, DIGITS, 6)}-{r.randint(0, 9)}", f"{r.randint(1, 90)}.{_pick(r, DIGITS, 4)}, {r.randint(1, 90)}.{_pick(r, DIGITS, 4)}",
        _pick(r, DIGITS, 3, 8), f"http://{_pick(r, string.ascii_lowercase, 3, 9)}.example.com/{_pick(r, string.ascii_lowercase, 2, 5)}/{r.randint(1, 999)}?page={d}", f"{_pick(r, string.ascii_lowercase, 2, 8)}.txt", f"{_word(r)}={r.randint(0, 99)}",
    ))


NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "key", "Password", "PASSWORD", "passwort", "kennwort", "mot de passe", "contraseña", "clave", "client_secret", "API_KEY", "pass")
LURES = ("the password was", "a secret", "the key of", "token", "Password?", "his key:", "pass the", "secrets", "un secret", "la clave de", "tokens for", "by phone", "mail to", "card game", "the keys, all")


def _luhn_digits(r: random.Random, size: int) -> str:
    body = _pick(r, DIGITS, size - 1)
    total = sum(int(x) if i % 2 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(body)))
    return body + str(-total % 10)


def _secret(r: random.Random) -> tuple[str, str, str]:
    lot = r.random()
    if lot < 0.2:
        return "", r.choice(("AKIA", "ASIA")) + _pick(r, string.ascii_uppercase + DIGITS, 16), ""
    if lot < 0.35:
        return "", r.choice(("ghp_", "sk-", "xoxb-", "glpat-")) + _pick(r, string.ascii_letters + DIGITS, 20, 36), ""
    low = string.ascii_lowercase
    value = r.choice((
        _pick(r, "0123456789abcdef", 14, 44), _pick(r, string.ascii_letters + DIGITS, 8, 40), _pick(r, string.ascii_letters, 6, 18), _pick(r, low, 6, 14), "".join(r.choice(SYLLABLES[:20]) for _ in range(r.randint(3, 5))),
        _pick(r, low, 5, 9).capitalize() + _pick(r, DIGITS, 2, 4) + r.choice(("", "!", "#", "$")), _pick(r, string.ascii_letters + DIGITS + "!#$%&*+-_.", 8, 20) + _pick(r, low, 1),
    ))
    mark = r.choice(("", "", '"', "'"))
    return r.choice(NAMES) + r.choice(("=", " = ", ": ", ": ", ":")) + mark, value, mark


def _phone(r: random.Random) -> str:
    a, b, c = f"{r.randint(200, 999)}", f"{r.randint(100, 999)}", _pick(r, DIGITS, 4)
    pairs = " ".join(_pick(r, DIGITS, 2) for _ in range(4))
    return r.choice((
        f"+1 ({a}) {b}-{c}", f"+{r.randint(2, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{r.randint(20, 99)} ({r.randint(0, 9)}){a[:2]} {b}{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}",
        f"0{a[:2]}/{_pick(r, DIGITS, 6, 8)}", f"0{a[:2]}/{_pick(r, DIGITS, 6, 8)}", f"0{a}/{_pick(r, DIGITS, 5, 7)}", f"0{a} {b}{c}", f"0{r.randint(1, 9)} {pairs}", f"0{a[:2]} {_pick(r, DIGITS, 4)} {c}", f"0{a}-{b}{c}", f"+{r.randint(20, 99)}{a}{b}{c}",
    ))


def personal(r: random.Random, kind: str) -> tuple[str, str, str]:
    """(text before, a span of a kind, text after)."""
    low = string.ascii_lowercase
    name = _pick(r, low, 2, 9)
    if kind == "email":
        user = name + r.choice(("", f".{r.randint(0, 99)}", f"_{name[:3]}", f"+{name[:2]}", f"{r.randint(0, 999)}", f".{name[::-1]}"))
        host = r.choice(("mail", "post", "example", name[::-1], f"mail{r.randint(0, 9)}")) + r.choice(("", ".example", f"-{name[:2]}")) + r.choice((".com", ".org", ".net", ".de", ".co.uk", ".io", ".fr"))
        return "", f"{user}@{host}", ""
    if kind == "ip":
        return "", ".".join(str(r.randint(0, 255)) for _ in range(4)), ""
    if kind == "card":
        digits = _luhn_digits(r, r.choice((13, 14, 15, 15, 16, 16, 16, 16, 19)))
        cuts = (4, 10) if len(digits) == 15 and r.random() < 0.5 else range(4, len(digits), 4)
        gap = r.choice(("", "", " ", "-"))
        return "", gap.join(digits[a:b] for a, b in zip((0, *cuts), (*cuts, len(digits)), strict=True)), ""
    if kind == "phone":
        return "", _phone(r), ""
    if kind == "iban":
        text = r.choice(("DE", "FR", "GB", "ES", "IT", "NL", "CH", "AT")) + _pick(r, DIGITS, 2) + _pick(r, string.ascii_uppercase, 4) * (r.random() < 0.25) + _pick(r, DIGITS, 14, 22)
        return "", r.choice((text, " ".join(text[i : i + 4] for i in range(0, len(text), 4)))), ""
    return _secret(r)


def labelled_text(r: random.Random, size: int, share: float = 0.16) -> tuple[str, list[int], list[int]]:
    """Invented text of at least ``size`` characters, the tag of each, and where its items begin: words, harmless numbers, and spans for a share of them."""
    parts: list[str] = []
    marks: list[int] = []
    begins: list[int] = []

    def add(text: str, tags: list[int] | None = None) -> None:
        parts.append(text)
        marks.extend(tags or [0] * len(text))

    while len(marks) < size:
        begins.append(len(marks))
        lot = r.random()
        if lot < share:
            kind = r.choice((*KINDS, "secret", "secret", "secret", "phone"))
            before, span, after = personal(r, kind)
            tag = 1 + 2 * KINDS.index(kind)
            add(before)
            add(span, [tag] + [tag + 1] * (len(span) - 1))
            add(after)
        elif lot < share + 0.12:
            add(_number(r))
        elif lot < share + 0.16:
            add(r.choice(LURES))
        else:
            add(_word(r))
        add(r.choice((" ", " ", " ", " ", "\n", ". ", ", ", "! ", " (", ") ")))
    return "".join(parts), marks, begins


def labelled_windows(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and tags of ``count`` windows with labelled spans, made by rule; some have none, some end early."""
    r = random.Random(seed)
    ids, tags = np.zeros((count, WINDOW), np.uint8), np.zeros((count, WINDOW), np.int64)
    for row in range(count):
        text, marks, begins = labelled_text(r, 2 * WINDOW, r.choice((0.0, 0.05, 0.1, 0.2)))
        at = r.choice([b for b in begins if b <= WINDOW])  # spans are cut by a window's end only, or their beginning would say nothing
        size = r.choice((WINDOW, WINDOW, WINDOW, r.randint(8, WINDOW)))
        marks = marks[at : at + size]
        ids[row, :size], tags[row, :size] = char_ids(text[at : at + size]), marks
    return ids, tags


@functools.lru_cache(maxsize=1)
def trained(windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = 3) -> Tagger:
    """A tagger trained with Adam on labelled windows; the same each time."""
    model = Tagger(seed)
    ids, tags = labelled_windows(windows)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, total = 0, epochs * -(-windows // BATCH)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for at in range(0, windows, BATCH):
            part = order[at : at + BATCH]
            _, grad = model.loss(ids[part], tags[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = 0.015 * min(1.0, step / 20) * (1 - 0.95 * step / total)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(model.p[k].dtype)
    return model
