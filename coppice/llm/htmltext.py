"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags.  Blocks in a menu, header, footer, sidebar, form,
notice, advert or comment (by element name, role, class or id) go, and say nothing of what is
beside them.  A class, id or role marks its element by the words of its tokens,
but not by those behind *with*, *has* or *no*, and a mark doesn't count on main, on what
holds main, or on what holds most of the page's text (see ``_resolved``).

Pass one scores every other block by the share of stop words among its words, its length and the
share of its text in links; small print and a short block that begins like a call to share,
subscribe or the like lose points.  Where a block stands is no part of it.  A score of ``GOOD`` or more is text if the
block isn't short, of ``BAD`` or less is not; all others are left open.

Pass two gives an open block the label of its nearest decided neighbours in the same
article, or outside of articles: theirs if both agree; else text within an article and before
it the label of the nearer one, bad at the same distance; a heading right before text is text.  With one neighbour it
is that one's.  Where nothing of an article, or of a page without one, was decided to be text, its best open block is.
What stands outside of a page's article isn't part of it.

Fixed values below are lengths in characters, shares and weights, and stop words of the
four languages; a page in none of them is judged by length, links and place.

Defined results: null or empty html gives the empty text; a page without tags is
one block; unclosed elements end with the page; texts of formulas and drawings stay;
very long pages are read whole; ties go as said above; repeated rows are treated alike;
further columns pass through a struct, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped

#: Characters of a short and of a long block, and shares of stop words.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
#: Scores from which a block is decided, and what features add to it.
GOOD, BAD = 1.0, -1.5
STOPS, LENGTH = 1.0, 1.0
LINKS, HEADING_LINKS, SMALL_PRINT, CALL = -3.0, -1.5, -2.0, -2.0
#: Stop words.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or not have but an they you which were their".split()
    + "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()
    + "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou".split()
    + "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split()
)

#: Element names.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe xmp noembed noframes".split())
#: Raw within a drawing.
SVG_RAW = frozenset("title desc metadata".split())
BAD_TAGS = frozenset("nav footer aside form head title button select menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what isn't the article.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside widget related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search pagination pager toolbar toc complementary contentinfo".split()
)

#: Bad words that are also subjects, and the words beside which they are still bad.
SUBJECT_WORDS = frozenset("social notice share sharing side promotion promo banner consent comment reply".split())
LAYOUT_WORDS = frozenset("links link bar box icon icons button buttons media list block section area wrapper wrap container content col column panel pane left right top bottom main site page post posts article articles form text message btn group".split())

#: How short calls to share, follow or subscribe, and labels of adverts, begin.
CALLS = re.compile(
    r"(?:share (?:on|this|via|with)\b|tweet(?: this)?\b|(?:please )?subscribe (?:to|now|here|for)\b|subscribe$|sign up (?:for|to|now)\b|follow us\b|like us\b|print this\b|email this\b|advertisement$|advertising$|sponsored(?: content| by\b|$)|read more$|leave a comment|related (?:articles|posts|stories)"
    r"|teilen (?:auf|via)\b|jetzt abonnieren|newsletter (?:abonnieren|bestellen)|folgen sie uns|anzeige$|werbung$|mehr lesen$|partager (?:sur|cet|par)\b|abonnez[- ]vous|suivez[- ]nous|publicité$|lire la suite$|compartir en\b|suscríbe(?:te|nse)\b|síguenos|publicidad$|leer más$)", re.I
)

#: Words that turn what follows in a token into a feature of the layout, and, on an article, into its subject.
MODIFIERS = frozenset("has with without no not hide show".split())
SUBJECTS = frozenset("tag category cat topic".split())
#: The bad words of what can rightly be longer than the article.
OUTGROWING = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MAIN = re.compile(r"""(?:^|\s)(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""")
_WORD_PARTS = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    article: int  # number of the article it is in, -1 for none
    bad: bool  # within what isn't text


@dataclass
class Mark:
    """An element whose class, id or role has a bad word."""

    parent: int  # the marked element around it, -1 for none
    whole: bool  # a token of bad words only
    outgrowing: bool
    article: bool = False  # is or holds an article
    main: bool = False  # holds main


def _mark(attributes: str, article: bool) -> tuple[bool, bool] | None:
    """Whether a token is of bad words only and whether one is of OUTGROWING; None without a bad word."""
    found, whole, outgrowing = False, False, False
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for token in (a or b or c).split():
            words = _WORD_PARTS.findall(_CAMEL.sub(r"\1 \2", token).lower())
            if BAD_WORDS.isdisjoint(words) or (article and words[0] in SUBJECTS):
                continue
            own = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
            bad = BAD_WORDS.intersection(words[:own])
            if bad <= SUBJECT_WORDS and not (BAD_WORDS | LAYOUT_WORDS).issuperset(words[:own]):
                continue  # a section on social history or side effects
            found = found or bool(bad)
            whole = whole or (bool(bad) and BAD_WORDS.issuperset(words))
            outgrowing = outgrowing or not OUTGROWING.isdisjoint(bad)
    return (whole, outgrowing) if found else None


def _resolved(out: list[Block], inside: list[int], marks: list[Mark]) -> list[Block]:
    """Blocks within marks that count become bad.

    A mark doesn't count on what holds main.  Nor on what holds over half of the text
    (that of elements bad by name, and of other marks that count for certain, is left
    out), where the bad word is a part of a longer token, or where the element is or
    holds an article and hardly a text stands outside of marks.
    """
    if not marks:
        return out
    for m in reversed(marks):  # what is held further in is held further out
        if m.parent >= 0:
            marks[m.parent].article |= m.article
            marks[m.parent].main |= m.main
    own, outside = [0] * len(marks), 0
    for b, k in zip(out, inside, strict=True):
        if not b.bad and k < 0:
            outside += len(b.text) - b.linked
        elif not b.bad:
            own[k] += len(b.text) - b.linked
    open_ = [m.main or (not m.outgrowing and (not m.whole or (m.article and outside < SHORT))) for m in marks]
    reached = []
    for k, m in enumerate(marks):
        reached.append(open_[k] and (m.parent < 0 or reached[m.parent]))
    total = outside + sum(n for n, yes in zip(own, reached, strict=True) if yes)
    counts = [True] * len(marks)
    for k in reversed(range(len(marks))):
        m = marks[k]
        counts[k] = not (m.main or (open_[k] and 2 * own[k] > total))
        if not counts[k] and m.parent >= 0:
            own[m.parent] += own[k]
    for k, m in enumerate(marks):
        counts[k] = counts[k] or (m.parent >= 0 and counts[m.parent])
    for b, k in zip(out, inside, strict=True):
        b.bad = b.bad or (k >= 0 and counts[k])
    return out


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, whether it is bad by name, whether it is an article, whether it is marked
    marks: list[Mark] = []
    inside: list[int] = []  # the innermost mark of each block
    mark = -1
    open_: dict[str, int] = {}
    depth_bad = links = svg = 0
    articles, met = [-1], 0  # the articles that are open, and how many there were
    heading = head_of_article = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                size = len(_SPACE.sub(" ", unescape(" ".join(linked))).strip()) if linked else 0
                out.append(Block(text, size, heading, articles[-1], depth_bad > 0 or (head_of_article and not heading)))
                inside.append(mark)
        parts, linked = [], []

    at, lowered, breaks = 0, None, 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if links:
                linked.append(piece)
            if not piece.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "svg" and not attributes.endswith("/"):
            svg = max(0, svg + (-1 if closing else 1))
        if name in RAW_TAGS or (svg and name in SVG_RAW):
            if not closing and not attributes.rstrip().endswith("/"):
                if lowered is None:
                    lowered = page.lower() if len(page.lower()) == n else "".join(c.lower() if c < "\x80" else c for c in page)
                end = lowered.find(f"</{name}", at)
                at = n if end < 0 else end
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                parts.append(" ")
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if name in BLOCK_TAGS:
            close()
            links, breaks = 0, 0
            heading = name in HEADINGS and not closing
            while stack and stack[-1][0] == "p":  # a block ends an open paragraph
                open_["p"] -= 1
                _, bad, _, marked = stack.pop()
                depth_bad -= bad
                mark = marks[mark].parent if marked else mark
        if name == "header" and len(articles) > 1:
            head_of_article = not closing
            continue
        if closing:
            if open_.get(name) and name not in BLOCK_TAGS:
                close()
            while open_.get(name):  # what was opened within ends with it
                inner, bad, good, marked = stack.pop()
                open_[inner] -= 1
                depth_bad -= bad
                if good:
                    articles.pop()
                mark = marks[mark].parent if marked else mark
                if inner == name:
                    break
            head_of_article = head_of_article and len(articles) > 1
            continue
        if name in VOID_TAGS:
            continue
        bad, good = name in BAD_TAGS or name == "header", name in GOOD_TAGS or ("main" in attributes or "articleBody" in attributes) and name in BLOCK_TAGS and bool(_MAIN.search(attributes))
        word = _mark(attributes, good) if attributes and not bad and name not in ("html", "body", "main") else None
        if (bad or word) and name not in BLOCK_TAGS:
            close()
        if word:
            marks.append(Mark(mark, *word))
            mark = len(marks) - 1
        if good and mark >= 0 and not depth_bad:
            marks[mark].article = True
            marks[mark].main |= name != "article"
        if bad or good or word or (name in BLOCK_TAGS and name not in HEADINGS and name not in ("p", "li", "td", "th", "tr", "dt", "dd", "option")):
            stack.append((name, bad, good, bool(word)))
            open_[name] = open_.get(name, 0) + 1
            depth_bad += bad
            if good:
                articles.append(met)
                met += 1
    close()
    return _resolved(out, inside, marks)


def scored(found: list[Block]) -> list[bool | None]:
    """Pass one: whether each block is text; None where its score leaves it open."""
    density = []
    for b in found:
        words = [w.lower() for w in _WORDS.findall(b.text)]
        density.append(sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0)
    known = max((d for d, b in zip(density, found, strict=True) if len(b.text) >= SHORT and not b.bad), default=0.0) >= STOP_LOW / 2
    out: list[bool | None] = []
    best: dict[int, tuple] = {}
    for i, (b, stops) in enumerate(zip(found, density, strict=True)):
        size = len(b.text)
        score = (HEADING_LINKS if b.heading else LINKS) * b.linked / size
        if size < LONG and "©" in b.text:
            score += SMALL_PRINT
        if size < SHORT and CALLS.match(b.text.rstrip(".!:… ")):
            score += CALL
        if size >= SHORT and known:
            score += STOPS * ((stops >= STOP_HIGH) - (stops < STOP_LOW))
        if size > LONG:
            score += LENGTH
        out.append(False if b.bad or score <= BAD else True if score >= GOOD and size >= SHORT else None)
        if out[i] is not False:
            best[b.article] = max(best.get(b.article, (False,)), (bool(out[i]), score, size, -i))
    for decided, *_, at in best.values():
        if not decided:
            out[-at] = True
    return out


def labels(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the article: pass one, and pass two for what it leaves open."""
    first = scored(found)
    out = [bool(x) for x in first]
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b.bad:
            groups.setdefault(b.article, []).append(i)
    has_article = any(a >= 0 for a in groups)
    for article, own in groups.items():
        if has_article and article < 0:
            for i in own:
                out[i] = False
            continue
        decided = [p for p, i in enumerate(own) if first[i] is not None]
        plain = len(own)  # the next place without a heading
        k = len(decided) - 1
        for p in reversed(range(len(own))):
            i = own[p]
            plain = plain if found[i].heading else p
            while k >= 0 and decided[k] >= p:
                k -= 1
            if first[i] is not None:
                continue
            sides = [decided[j] for j in (k, k + 1) if 0 <= j < len(decided)]
            near = [bool(first[own[q]]) for q in sides]
            if len(near) < 2 or near[0] == near[1]:
                out[i] = not near or near[0]
            elif article >= 0 or (near[1] and plain >= sides[1]):
                out[i] = True
            else:
                before, after = p - sides[0], sides[1] - p
                out[i] = before != after and near[before > after]
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, an empty line between them."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extracted(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """(page: struct of ``keep``, text, n_chars) of each row."""
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = T.StructType([own.schema["page"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=schema.names)

    return mapped(own, scan, schema)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages."""
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page.page_id", "page.url", "text", "n_chars")
