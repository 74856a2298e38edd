"""The labelled table for main-text extraction: pages put together by rule from parts whose blocks are known."""

from __future__ import annotations

import random
from collections.abc import Callable

#: Pages of the table, and the seed of their making.
PAGES, SEED = 320, 17
#: A page: its parts in order, each with what its blocks are (1: article, 0: beside it).
Page = list[tuple[str, int]]
SYLLABLES = "the an re tion ing es or ed nd ha st er ly ble th wh in ou ti éau ção ß ñ der die und la el que ner zo mar vi".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + r.choice(("",) * 12 + ("***", "###", "%%%", "!!"))


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentence(r: random.Random, low: int = 3, high: int = 18) -> str:
    return _words(r, low, high).capitalize() + r.choice("....!?")


def _prose(r: random.Random) -> str:
    """From one word to a long paragraph."""
    count = r.choice((1, 1, 1, 2, 3, 4, 6, 9))
    return _sentence(r, 1, 3) if r.random() < 0.12 else " ".join(_sentence(r) for _ in range(count))


def _link(r: random.Random, low: int = 1, high: int = 3) -> str:
    return f"<a href='/{r.randint(1, 99)}'>{_words(r, low, high)}</a>"


def _menu(r: random.Random) -> str:
    links = [_link(r) for _ in range(r.randint(3, 8))]
    return r.choice((
        "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>",
        "<div>" + r.choice((" ", " | ", " &middot; ")).join(links) + "</div>",
        "<p>" + " &gt; ".join(links) + "</p>",
        "<table><tr>" + "".join(f"<td>{x}</td>" for x in links) + "</tr></table>",
    ))


def _more(r: random.Random) -> str:
    """Links to other pages, with a line above them or without."""
    lead = r.choice(("", f"<div>{_words(r, 1, 3).capitalize()}</div>"))
    return lead + "".join(r.choice(("<div>{}</div>", "<li>{}</li>", "<p>{}</p>")).format(_link(r, 3, 9)) for _ in range(r.randint(2, 5)))


def _legal(r: random.Random) -> str:
    year = r.randint(1999, 2030)
    line = r.choice((
        f"&copy; {year} {_words(r, 1, 3)}", f"&copy; site.example &middot; {_prose(r)}", f"All rights reserved {year}", f"Copyright {_words(r, 1, 2)}. All rights reserved.", f"{_words(r, 1, 2)} (c) {year}",
    ))
    return r.choice(("<div>{}</div>", "<p>{}</p>")).format(line) + r.choice(("", f"<div>{_link(r)} | {_link(r)}</div>"))


def _body(r: random.Random, heading: bool = True) -> list[str]:
    """Blocks of an article."""
    out = [f"<h1>{_words(r, 1, 9).capitalize()}</h1>"] if heading else []
    for _ in range(r.randint(2, 12)):
        lot = r.random()
        if lot < 0.06:
            out.append(f"<h2>{_words(r, 1, 5).capitalize()}</h2>")
        elif lot < 0.12:
            out.append("<ul>" + "".join(f"<li>{_words(r, 1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif lot < 0.18:
            out.append(f"<p>{_prose(r)} {_link(r)} {_sentence(r)}</p>")
        elif lot < 0.22:
            out.append(f"<blockquote>{_prose(r)}</blockquote>")
        elif lot < 0.25:  # words of the law that are the article's own
            line = r.choice(("All rights reserved.", f"Copyright {_words(r, 1, 2)}", f"&copy; {r.randint(1999, 2030)} {_words(r, 1, 2)}"))
            out.append(f"<p>{line}</p><p>{_sentence(r, 12, 20)}</p>")
        elif lot < 0.29:
            out.append(f"<p><b>{_prose(r)}<br>{_prose(r)}")
        else:
            out.append(f"<p>{_prose(r)}</p>")
    if not any("<p>" in x for x in out):
        out.append(f"<p>{_sentence(r, 12, 20)} {_prose(r)}</p>")
    return out


def _named(r: random.Random) -> str:
    """A part beside the article that its name gives away."""
    name = r.choice(("ad", "cookie-notice", "sidebar", "newsletter", "share", "related", "promo", "advert", "notice", "widget", "disclaimer"))
    text = r.choice((f"<p>{_prose(r)}</p>", _prose(r), f"<p>{_sentence(r)}</p><p>{_prose(r)}</p>", _words(r, 1, 6)))
    return f"<div {r.choice(('class', 'id'))}='{name}'>{text}</div>"


def _aside(r: random.Random) -> str:
    return r.choice((
        f"<aside><p>{_prose(r)}</p></aside>", f"<form><label>{_words(r, 1, 4)}</label><p>{_sentence(r)}</p><button>{_word(r)}</button></form>", f"<aside>{_words(r, 1, 3)}: {_link(r, 2, 6)}</aside>", f"<nav><p>{_prose(r)}</p></nav>",
    ))


def _comments(r: random.Random) -> str:
    name = r.choice(("comments", "comment-list", "replies", "discussion"))
    each = [r.choice(("<p>{}</p>", "<div>{}</div>", "<article><p>{}</p></article>")).format(_prose(r)) for _ in range(r.randint(1, 6))]
    return f"<section class='{name}'><h3>{_words(r, 1, 2)}</h3>{''.join(each)}</section>"


def _between(r: random.Random, body: list[str], parts: tuple[Callable[[random.Random], str], ...]) -> Page:
    """A body with parts beside the article here and there inside it."""
    out: Page = []
    for x in body:
        out.append((x, 1))
        if r.random() < 0.08:
            out.append((r.choice(parts)(r), 0))
    return out


def _sectioned(r: random.Random) -> Page:
    """A page that says by its elements what is what."""
    box = r.choice(("article", "article", "main"))
    out: Page = [(f"<nav>{_menu(r)}</nav>", 0)] if r.random() < 0.8 else []
    if r.random() < 0.3:
        out.append((f"<header><p>{_prose(r)}</p>{_link(r)}</header>", 0))
    if r.random() < 0.7:
        out.append((r.choice((_named, _aside))(r), 0))
    body = _body(r, r.random() < 0.9)
    if r.random() < 0.2:
        body.append(f"<p>{r.choice(('All rights reserved.', 'Copyright ' + _word(r), _prose(r) + ' (c)'))}</p>")
    out += [(f"<{box}>", 1), *_between(r, body, (_named, _aside)), (f"</{box}>", 1)]
    if r.random() < 0.4:
        out.append((_comments(r), 0))
    if r.random() < 0.3:
        out.append((f"<div>{_prose(r)}</div>", 0))
    if r.random() < 0.9:
        out.append((f"<footer>{r.choice((_legal, _menu, lambda r: f'<p>{_prose(r)}</p>'))(r)}</footer>", 0))
    return out


def _plain(r: random.Random) -> Page:
    """A page of divisions without names: only the text tells."""
    out: Page = [(_menu(r), 0)] if r.random() < 0.85 else []
    body = _body(r, r.random() < 0.8)
    out += [("<div>", 1), *((x, 1) for x in body), (f"<p>{_sentence(r, 8, 20)} {_sentence(r)}</p>", 1), ("</div>", 1)]
    if r.random() < 0.6:
        out.append((_more(r), 0))
    if r.random() < 0.5:
        out.append((_menu(r), 0))
    if r.random() < 0.7:
        out.append((_legal(r), 0))
    return out


def _called(r: random.Random) -> Page:
    """A page of divisions with names, some of which mislead about the article."""
    out: Page = [(f"<div class='{r.choice(('menu', 'navbar', 'topbar'))}'>{_menu(r)}</div>", 0)]
    if r.random() < 0.6:
        out.append((_named(r), 0))
    box = r.choice(("content", "post tags", "widget-text", "entry", "text", "share page"))
    out += [(f"<div class='{box}'>", 1), *_between(r, _body(r), (_named,)), (f"<p>{_sentence(r, 10, 20)} {_prose(r)} {_prose(r)}</p>", 1), ("</div>", 1)]
    if r.random() < 0.4:
        out.append((_comments(r), 0))
    out.append((f"<div class='footer'>{r.choice((_legal, _menu))(r)}</div>", 0))
    return out


def _bare(r: random.Random) -> Page:
    return [(x, 1) for x in _body(r, r.random() < 0.5)]


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[Page]:
    r = random.Random(seed)
    kinds = (_plain, _sectioned, _plain, _called, _sectioned, _plain, _bare, _called)
    return [kinds[i % len(kinds)](r) for i in range(count)]
