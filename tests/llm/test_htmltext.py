import html
import re
from html.parser import HTMLParser

import pandas as pd
import pytest

from coppice.llm import htmltext as H
from coppice.llm.htmltext import blocks, extracted, main_text

A = "The history of the town is long, and it is told by those who have lived in it for most of their lives. It was built on a hill by the river, as many of them were."
B = "In the morning the market is full of people from all the villages that are on the other side of the river, and by noon they have gone home with what they bought."


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p><b>{A}<br><p>Short.</p></article><footer>&copy; x</footer>", ["Title & more", A, "Short."]),
        (f"<header><a href='/'>Site</a></header><div class='content'><h2>A heading</h2><p>{A}</p><p>Then.</p><p>{B}</p></div><div class=\"sidebar\"><p>{B}</p></div>", ["A heading", A, "Then.", B]),
        (f"<main><p>{A}</p><div class='cookie-notice'>We use cookies. {B}</div><p>{B}</p><section id=comments><p>I think that {A}</p></section></main>", [A, B]),
        (f"<article><header><h1>Head</h1><span>By someone</span></header><p>{A}</p><div class='ad'>{B}</div><form><input name=q>Search {A}</form><p>Last</article>", ["Head", A, "Last"]),
        (f"<article><p>one\n\t two&nbsp;three &lt;b&gt; &#233;<!-- {A} --> <a href='x>y'>link</a> and more of it</p><noscript>{A}</noscript></article>", ["one two three <b> é link and more of it"]),
        (f"<article><p>{A}<br><br>{B}<p><a href=1>See also</a> <a href=2>and this</a></p></article>", [A, B]),
        (f"<div><p>{A}</p></div><div><a href=1>{B}</a></div>", [A]),
        (f"<article><p>{A}<script>if (a < b) document.write('<p>x</p>')</SCRIPT><p>{B}", [A, B]),
    ],
)
def test_pages(body, want):
    assert main_text(page(body)) == "\n\n".join(want)


LONG_TALK = "".join(f"<article class='comment'><p>{A}</p></article>" for _ in range(4))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div><p>{A}</p><p>{B}</p></div><article class='comment'><p>{A}</p></article>", [A, B]),
        (f"<div><p>{A}</p><p>{B}</p></div><section class='comments-area'>{LONG_TALK}</section>", [A, B]),
        (f"<div class='content with-sidebar'><p>{A}</p><div class='sidebar'>{B}</div></div>", [A]),
        (f"<main class='has-header'><p>{A}</p></main>", [A]),
        (f"<article class='post no-comments category-social'><p>{A}</p><div id=comments>{B}</div></article>", [A]),
        (f"<div class='page withSidebar'><article><p>{A}</p></article><div class='side-bar'>{B}</div></div>", [A]),
        (f"<div class='sidebar-layout'><div class='cookie-notice'>{B}</div><main><p>{A}</p></main></div>", [A]),
        (f"<div class='layout sidebar-left'><p>{A}</p><p>{B}</p></div><div class='site-footer'>{B}</div>", [A, B]),
        (f"<div class='overlay'><article><p>{A}</p></article></div><div class='related-posts'><article>{B}</article></div>", [A]),
        (f"<article class='widget'><p>{A}</p></article><aside><article>{B}</article></aside>", [A]),
        (f"<div class='cookie-notice'><p>{A}</p></div>", []),
        (f"<article><p>{A}</p></article><div class='sidebar'><article><p>{A}</p><p>{B}</p></article></div>", [A]),
    ],
)
def test_marks_leave_the_article(body, want):
    assert main_text(page(body)) == "\n\n".join(want)


def test_subjects_in_class_names():
    assert main_text(page(f"<article><p>{A}</p><div class='social-history'><p>{B}</p></div><div class='social-links'><p>{B}</p></div><div class='share'>{B}</div></article>")) == f"{A}\n\n{B}"


def test_many_marks():
    assert main_text("<div class='x-menu'>" * 20000 + A) == A


def test_odd_pages(spark):
    odd = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "just text", "x"), (4, "u", "<", "x"), (5, "u", "<p", "x"), (5, "u", "<p", "x"), (6, "u", "<script>never closed", "x"), (7, "u", "<!-- never closed", "x"), (None, "u", "<a href=\"open>x" * 2000, "x"), (8, "u", "<div>" * 20000 + A, "x"), (9, "u", "<p><p></p>" * 5, "x")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string, text string")  # a column named like the result's
    got = {r.page_id: r for r in extracted(pages, ["page_id", "url"]).select("page.page_id", "text", "n_chars").collect()}
    assert [got[k].text for k in (1, 2, 3, 5, 6, 7, 8, 9)] == ["", "", "just text", "", "", "", A, ""]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extracted(pages.where("false"), ["page_id"]).count() == 0


class Plain(HTMLParser):
    """Blocks of a page as (text, characters in links, heading, article, bad), for the elements of the test tables."""

    def __init__(self, page):
        super().__init__()
        self.out, self.text, self.linked, self.open = [], "", "", []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        flat = lambda x: " ".join(x.split())
        if flat(self.text):
            self.out.append((flat(self.text), len(flat(self.linked)), "h1" in self.open, "article" in self.open, bool({"nav", "footer", "title", "ad", "head"} & set(self.open))))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK_TAGS:
            self.end()
            if "p" in self.open:
                self.open = self.open[: self.open.index("p")]
        if tag not in H.VOID_TAGS:
            self.open.append(dict(attrs).get("class") or tag if tag == "div" else tag)
        if tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in H.BLOCK_TAGS:
            self.end()
        names = [tag] if tag != "div" else ["div", "ad"]
        at = max((i for i, x in enumerate(self.open) if x in names), default=None)
        if at is not None and (tag != "b" or self.open[-1] == "b"):
            self.open = self.open[:at]

    def handle_data(self, data):
        if "script" not in self.open and "style" not in self.open:
            self.text += data
            self.linked += data if "a" in self.open else ""


def plain_labels(found):
    """The rules of both passes, each block looked at by itself and its neighbours searched one by one."""
    share = lambda t: (lambda w: sum(x.lower() in H.STOP_WORDS for x in w) / len(w) if w else 0)(re.findall(r"[^\W\d_]+", t))
    known = any(share(t) >= 0.1 for t, _, _, _, bad in found if not bad and len(t) >= 70)
    some = any(art and not bad for _, _, _, art, bad in found)
    points = []
    for t, linked, heading, _, bad in found:
        n = (H.HEADING_LINKS if heading else H.LINKS) * linked / len(t) - 2 * ("©" in t and len(t) < 200)
        if len(t) >= 70 and known:
            n += H.STOPS * ((share(t) >= 0.3) - (share(t) < 0.2))
        points.append(-9 if bad else n + H.LENGTH * (len(t) > 200))
    first = [False if n <= -1.5 else True if n >= 1 and len(b[0]) >= 70 else None for n, b in zip(points, found, strict=True)]
    for inside in (False, True):
        own = [i for i, b in enumerate(found) if b[3] == inside]
        left = [i for i in own if first[i] is None]
        if left and not any(first[i] for i in own):
            first[max(left, key=lambda i: (points[i], len(found[i][0]), -i))] = True
    out = []
    for i, (_, _, _, art, bad) in enumerate(found):
        own = [j for j, b in enumerate(found) if not b[4] and b[3] == art]
        label = first[i]
        if label is None:
            before, after = ([j for j in side if first[j] is not None] for side in (own[: own.index(i)][::-1], own[own.index(i) + 1 :]))
            if not before or not after:
                label = next((first[j] for j in before[:1] + after[:1]), True)
            elif first[before[0]] == first[after[0]]:
                label = first[before[0]]
            elif art or (first[after[0]] and all(found[j][2] for j in own[own.index(i) : own.index(after[0])])):
                label = True
            else:
                back, on = own.index(i) - own.index(before[0]), own.index(after[0]) - own.index(i)
                label = back != on and first[before[0] if back < on else after[0]]
        out.append(bool(label) and not bad and (art or not some))
    return out


def plain_text(page):
    found = Plain(page).out
    return "\n\n".join(b[0] for b, good in zip(found, plain_labels(found), strict=True) if good)


def without_article(h):
    return h.replace("<article>", "<div>").replace("</article>", "</div>")


def without_marks(h):
    """No element says what it is: menu, advert, article and footer are plain divisions."""
    return re.sub(r"</(?:nav|footer|article)>", "</div>", re.sub(r"<(?:nav|footer|article|div class=.ad.)>", "<div>", h))


@pytest.fixture(scope="module")
def pages():
    return list(pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html)


def test_a_plain_version_agrees(pages):
    """All pages, as they are, with their articles as plain divisions, and without any mark."""
    for h in pages:
        for own in (h, without_article(h), without_marks(h)):
            assert main_text(own) == plain_text(own)


def test_pages_without_marks(pages):
    """The article's tag isn't needed; without any mark hardly a character is lost, and nothing of menus is kept."""
    whole = [main_text(h) for h in pages]
    assert [main_text(without_article(h)) for h in pages] == whole
    bare = [main_text(without_marks(h)).split("\n\n") for h in pages]
    right = sum(len(x) for own, w in zip(bare, whole, strict=True) for x in own if x in w.split("\n\n"))
    assert right >= 0.97 * sum(len(x) for w in whole for x in w.split("\n\n"))
    assert all(any(own) for own in bare) and sum(x not in w.split("\n\n") for own, w in zip(bare, whole, strict=True) for x in own) <= 0.02 * sum(map(len, bare))


@pytest.mark.parametrize("weight", ["STOPS", "LENGTH", "LINKS"])
def test_each_feature_flips_labels(pages, weight, monkeypatch):
    """Without marks, on which the features then depend, each of them decides labels."""
    before = [H.labels(blocks(without_marks(h))) for h in pages]
    monkeypatch.setattr(H, weight, 0.0)
    if weight == "LINKS":
        monkeypatch.setattr(H, "HEADING_LINKS", 0.0)
    after = [H.labels(blocks(without_marks(h))) for h in pages]
    assert sum(x != y for a, b in zip(before, after, strict=True) for x, y in zip(a, b, strict=True)) > 50


def test_neighbours_decide_both_ways():
    link = "<p><a href=1>More of this sort</a></p>"
    assert main_text(page(f"<article><p>{A}</p><p>In between.</p><p>{B}</p>{link}<p>Left over.</p>{link}</article>")) == f"{A}\n\nIn between.\n\n{B}"
    assert main_text(page(f"<article><p>{A}</p><p>Share on Facebook</p><p>Subscribe to our newsletter!</p><p>ADVERTISEMENT</p><p>{B}</p></article>")) == f"{A}\n\n{B}"
    assert main_text(page(f"<article><p>{A}</p><p>Shared land was common.</p><p>{B}</p></article>")) == f"{A}\n\nShared land was common.\n\n{B}"
    prose = f"{A} {B}"
    assert main_text(page(f"<article><p>{A}</p><p><a href=1>{prose}</a></p><p>{B}</p></article>")) == f"{A}\n\n{prose}\n\n{B}"
    assert main_text(page(f"<article><p>Tiny.</p></article><p>{A}</p>")) == "Tiny."


def test_formulas_drawings_and_long_pages():
    assert main_text(page(f"<article><p>{A} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>")) == f"{A} x=1 holds."
    assert main_text(page(f"<article><p>{A} <svg viewBox='0'><title>T</title><desc>D</desc><text>label</text></svg> and <canvas>c</canvas>.</p></article>")) == f"{A} label and c."
    assert main_text(page(f"<div role='main' class='with-menu'><p>Short.</p></div><div><p>{B}</p></div>")) == "Short."
    many = "".join(f"<h2>Part {i}</h2><p>{A}</p>" for i in range(20_000))
    assert len(main_text(page(f"<div>{many}</div>"))) == sum(len(f"Part {i}") + len(A) + 4 for i in range(20_000)) - 2
    assert main_text("<h2>x</h2>" * 50_000 + f"<p>{A}</p><a href=1>{B}</a>").count("x\n\n") == 50_000


def test_pages_of_the_test_tables():
    """Articles of the synthetic pages, cut out in a plain way."""
    for h in pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html:
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert main_text(h) == "\n\n".join(x for x in parts if x)
