import time
from html.parser import HTMLParser

import pytest

from modeloom.llm import html_text as H
from modeloom.llm.html_pages import labelled_pages

CASES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three &eacute;<p><b>Un</b>closed</article><footer>F</footer>": "A & B\n\nOne two three é\n\nUnclosed",
    "": "",
    None: "",
    "<article><p>a<script>var t='</p>';</script>b</p><!-- <p>no</p> --><aside>x</aside><form><p>y</p></form></article>": "ab",
    "<main><p>text &#65;&#x42;&nbsp;c</p></main><div class='comments'><p>a reader's remark</p></div>": "text AB c",
    "<article><p title=\"a > b\">kept</p></article><p": "kept",
    "<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body.</p></article>": "Title\n\nBody.",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert H.main_text(page) == CASES[page]


LONG = "Some of the older houses on the hill were rebuilt after the storm, and their owners kept the walls, the gates and most of the gardens."
SHORT = "The council met twice that year."
BODY = f"<p>{LONG}</p><p>{SHORT}</p><p>{LONG} {SHORT}</p>"
TEXT = f"{LONG}\n\n{SHORT}\n\n{LONG} {SHORT}"
NAMES = {
    f"<div class='post tags'>{BODY}</div>": TEXT,
    f"<section class='widget-text'>{BODY}</section>": TEXT,
    f"<main>{BODY}<div id='search-history'><p>{SHORT}</p></div></main>": f"{TEXT}\n\n{SHORT}",
    f"<h1>Walls</h1>{BODY}<div>All rights reserved 2024</div>": f"Walls\n\n{TEXT}",
    f"<article>{BODY}<p>All rights reserved.</p></article><div>&copy; 2024 The Paper</div>": f"{TEXT}\n\nAll rights reserved.",
    f"<div><a href=a>One</a> <a href=b>Two</a></div><div>{BODY}</div><div><a href=c>More</a> | <a href=d>About</a></div>": TEXT,
    f"<article>{BODY}<div class='ad'>{SHORT}</div></article><section class='comments'><article><p>{LONG}</p></article></section>": TEXT,
}


@pytest.mark.parametrize("page", NAMES)
def test_names_mislead_no_one(page):
    assert H.main_text(page) == NAMES[page]


def test_tree_on_pages_it_has_not_seen():
    x, y = H.labelled_rows(labelled_pages(200, seed=99))
    right = sum((H.score(row) > 0.5) == bool(label) for row, label in zip(x.tolist(), y.tolist(), strict=True))
    assert right / len(y) > 0.99
    assert H.FEATURES[H.tree()[0]] in H.FEATURES[:9]  # the counts lead


@pytest.mark.parametrize(
    "part", ['<a x="y ', "<b class=x><p>", "<!--", "<script>", "<", "</div ", "<p><span class='a'>", "<li><div class=q>", "&am", "<p a='", "<ul><li>", "<section></p>", "</é", "<svg/>x"]
)
def test_broken_markup_takes_time_in_proportion(part):
    H.tree()
    page = part * (160_000 // len(part))

    def seconds(text):
        began = time.process_time()
        H.main_text(text)
        return time.process_time() - began

    assert min(seconds(page) for _ in range(3)) < 1.0
    assert min(seconds(page) for _ in range(2)) < 4 * max(min(seconds(page[: len(page) // 2]) for _ in range(2)), 0.02)


class Plain(HTMLParser):
    """The text blocks of well-formed markup by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.found, self.now, self.raw = [], "", 0

    def flush(self):
        if self.now.split():
            self.found.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.raw += tag in H.RAW
        if tag == "br":
            self.now += " "
        if tag in H.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        self.raw -= tag in H.RAW
        if tag in H.BLOCK:
            self.flush()

    def handle_data(self, data):
        self.now += data * (not self.raw)


def test_blocks_equal_a_plain_parser():
    for page in labelled_pages(60, seed=5):
        text = "<!DOCTYPE html><style>p{}</style><!-- x --><script>var a='</p>'</script>" + "".join(p for p, _ in page)
        plain = Plain()
        plain.feed(text)
        plain.close()
        plain.flush()
        assert [b.text for b in H.blocks(text)] == plain.found


def test_extract(spark):
    rows = [(1, "u", p, 3) for p in CASES] + [(None, None, "<article>x</article>", 1), (1, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 20_000 * 6 - 2
    assert H.extract(pages.limit(0)).count() == 0
