"""Main text of web pages from flat text blocks (op 6).

A page is cut into flat blocks of text at block-level tags. Each block is
described by its words and link density, those of the blocks before and after
it, and by where it stands: inside an article or main element, inside an
element that holds no article text (menus, headers, footers, sidebars, notices,
adverts, forms, comments), a heading or not, and whether the page marks its
main part at all. A class or id whose whole name is that of an advert, a comment
list, a menu or the like (``SURE_WORDS`` and general parts of names) marks its
element as surely as a tag does, and so does a style that hides it. Other names,
and forms, are weak marks: words and links of a block and its neighbours decide
there. A decision tree, grown on the labelled cases below, says which blocks are
article text.

Text inside script, style and the like never becomes a block. Pages are
independent, so Spark deals them out and a task holds one batch of pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea select".split())
#: Of these, the ones that hold the rest of the page when they are left open.
RAW_TO_END = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget "
    "related recommended recommendations comment comments reply replies discussion disqus respond menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager toolbar masthead topbar footer copyright legal search form".split())
#: Of these and a few more, the ones that name nothing else: such an element holds no article text, wherever it stands.
SURE_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promoted promotion cookie cookies consent gdpr "
    "notice notification alert popup modal newsletter subscribe signup login share sharing sidebar related recommended recommendations "
    "comment comments replies disqus menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer".split())
MAIN_WORDS = frozenset("article main content post entry story maincontent articlebody".split())
#: Further parts that a compound name of such an element may have: "has-sidebar" names a wrapper, "sidebar-box" the thing itself.
NAME_PARTS = frozenset(
    "bar bars box block area list lists item items wrap wrapper container inner outer section group site main global page top bottom left right "
    "primary secondary post posts article articles entry entries stories link links icon icons button buttons text title".split())
#: Parts that only follow such a word: "sponsored-content" is an advert, "content-sidebar" may wrap both.
LAST_PARTS = frozenset("content body message thread author meta count".split())
#: Parts that go with words that name nothing else.
SURE_PARTS = NAME_PARTS | frozenset("slot unit google user reader module tools teaser card panel".split())
MAIN_PARTS = frozenset("body text area wrap wrapper container inner outer section block page single site primary blog news title lead intro header".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag whose quotes balance: values in either kind of quotes, or without any.
_END = re.compile(r"""(?:[^<>="']++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)?+)*+>""")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)))?""")
MARKING = frozenset("class id role itemprop hidden aria-hidden style".split())
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: int  # 2: inside an element that is a main part, 1: only inside one that is named so, 0: neither
    boiler: int  # the same for elements that hold no article text (2 also for names of ``SURE_WORDS``)
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _named(value: str) -> tuple[bool, int]:
    """Whether a class or id names the main part, and how surely it names text that isn't the article's: whole names only."""
    main, boiler = False, 0
    for name in value.split():
        parts = [w.lower() for w in _TOKEN.findall(name)]
        words = set(parts)
        main |= not MAIN_WORDS.isdisjoint(words) and words <= MAIN_WORDS | MAIN_PARTS
        if not SURE_WORDS.isdisjoint(words) and words <= SURE_WORDS | SURE_PARTS | (LAST_PARTS if parts[0] not in LAST_PARTS else set()):
            boiler = 2
        elif not BOILER_WORDS.isdisjoint(words) and words <= BOILER_WORDS | NAME_PARTS:
            boiler = max(boiler, 1)
    # an element that is named as the main part too may be laid out beside such a thing
    return main, min(boiler, 1) if main else boiler


def _marks(tag: str, attributes: str, in_main: bool) -> tuple[int, int]:
    """How far an element marks the main part, and text that isn't the article's: 2 surely, 1 by its name or as a form."""
    main = 2 * (tag in ("article", "main"))
    boiler = 1 if tag == "form" else 2 * (tag in BOILER_TAGS or (tag == "header" and not in_main))
    if attributes and tag not in ("body", "html"):
        for name, a, b, c in _ATTR.findall(attributes):
            name, value = name.lower(), a or b or c
            if name not in MARKING:
                continue
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                boiler = 2
            elif name == "role":
                value = value.lower()
                main = max(main, 2 * (value in ("main", "article")))
                boiler = max(boiler, 2 * (value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu")))
            elif name == "style":
                boiler = 2 if _UNSEEN.search(value) else boiler
            elif name != "aria-hidden":
                named, other = _named(value)
                main, boiler = max(main, int(named)), max(boiler, other)
    return main, boiler


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order; blocks without words are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # open elements (inline ones only if marked): tag, main, boiler
    opened: Counter[str] = Counter()  # how many of each tag, and of each mark, are open
    pieces: list[str] = []
    linked = links = 0
    heading = False

    def push(tag: str, main: int, boiler: int) -> None:
        stack.append((tag, main, boiler))
        opened.update((tag, f"*main{main}", f"*boiler{boiler}"))

    def level(mark: str) -> int:
        return 2 if opened[mark + "2"] else int(opened[mark + "1"] > 0)

    def pop_to(tag: str) -> None:
        while opened[tag]:
            own, main, boiler = stack.pop()
            opened.subtract((own, f"*main{main}", f"*boiler{boiler}"))
            if own == tag:
                break

    def flush() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), level("*main"), level("*boiler"), heading))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.split())

    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:  # a lone "<"; at the page's end, a tag that is cut off
            if lt + 1 == size:
                break
            add("<")
            at = lt + 1
            continue
        # a ">" inside a quoted value doesn't end the tag; where quotes don't balance the first one does
        whole = _END.match(page, m.end())
        end = whole.end() - 1 if whole else page.find(">", m.end())
        if end < 0:  # a tag that the page's end cuts off
            break
        attributes, tag, at = page[m.end():end], m[2].lower(), end + 1
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if opened[tag] or (tag not in INLINE and tag not in VOID):
                flush()
                heading &= tag not in HEADINGS
                pop_to(tag)
            continue
        if tag in RAW:
            if attributes.endswith("/") or tag in unclosed:
                continue
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            if close:
                end = page.find(">", close.end())
                at = size if end < 0 else end + 1
            elif tag in RAW_TO_END:
                at = size
            else:  # what follows is the page's text
                unclosed.add(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        main, boiler = _marks(tag, attributes, level("*main") > 0)
        links += tag == "a"
        if tag in INLINE:
            if boiler:  # an inline element that holds no article text is a block of its own
                flush()
                push(tag, 0, boiler)
            continue
        flush()
        if tag in ("p", "div", "article", "main", "section"):
            links = 0
        heading = tag in HEADINGS
        # paragraphs and headings are often left open: they count only if they are marked
        if main or boiler or (tag != "p" and not heading):
            push(tag, main, boiler)
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "main", "boiler", "marked", "heading")
# (words, density) of sample blocks, and of what stands before or after them
_SHORT, _MID, _LONG, _LINK = ((1, 0.0), (9, 0.1)), ((16, 0.0), (28, 0.2)), ((45, 0.0), (80, 0.1), (200, 0.0)), ((1, 1.0), (10, 0.8), (35, 0.9))
_FEW, _MANY, _LINKS = ((0, 0.0), (3, 0.0), (20, 0.0)), ((45, 0.1), (120, 0.0)), ((1, 1.0), (12, 0.8))
_TEXT, _ANY, _BOTH = _FEW + _MANY, _FEW + _MANY + _LINKS, (0, 1)
# (main, boiler, marked): in a main part, in one by name, on a page that marks none, outside a main part
_IN, _NAMED, _PLAIN, _OUT = ((2, 0, 2),), ((1, 0, 1), (1, 0, 2)), ((0, 0, 0), (2, 1, 0)), ((0, 0, 2), (2, 1, 2), (0, 1, 2))
# ... outside a part that is main by name only, or in what is boiler by name only; in what is boiler by what it is
_LOOSE, _BOILER = ((0, 0, 1), (0, 1, 0), (1, 1, 0), (1, 1, 1), (0, 1, 1)), tuple((main, 2, marked) for main in (0, 1, 2) for marked in (0, 1, 2))
#: Labelled cases: every combination of (blocks, those before, those after, marks, heading) has the label, 1 for article text.
_CASES = (
    # in a main part text is the article's, short or long; links are it between text, in a run of links not
    (_SHORT + _MID + _LONG, _ANY, _ANY, _IN, _BOTH, 1),
    (_LINK, _TEXT, _TEXT, _IN + _NAMED, (0,), 1), (_LINK, _LINKS, _ANY, _IN + _NAMED, (0,), 0), (_LINK, _TEXT, _LINKS, _IN + _NAMED, (0,), 0),
    # a wrapper that is only named so may hold menus too
    (_MID + _LONG, _ANY, _ANY, _NAMED, _BOTH, 1), (_SHORT, _TEXT, _ANY, _NAMED, _BOTH, 1), (_SHORT, _LINKS, _TEXT, _NAMED, _BOTH, 1), (_SHORT, _LINKS, _LINKS, _NAMED, _BOTH, 0),
    # pages that mark nothing: long text, shorter text that follows text, short text and headings that no links adjoin
    (_LONG + _MID[1:], _ANY, _ANY, _PLAIN, _BOTH, 1), (_MID[:1] + _SHORT[1:], _TEXT, _ANY, _PLAIN, (0,), 1), (_MID[:1], _LINKS, _TEXT, _PLAIN, (0,), 1),
    (_SHORT[1:], _LINKS, _MANY, _PLAIN, (0,), 1), (_SHORT[1:], _LINKS, _FEW + _LINKS, _PLAIN, (0,), 0), (_MID[:1], _LINKS, _LINKS, _PLAIN, (0,), 0),
    (_SHORT[:1], _TEXT, _TEXT, _PLAIN, (0,), 1), (_SHORT[:1], _LINKS, _ANY, _PLAIN, (0,), 0), (_SHORT[:1], _TEXT, _LINKS, _PLAIN, (0,), 0),
    (_LINK, _MANY, _MANY, _PLAIN, (0,), 1), (_LINK, _FEW + _LINKS, _ANY, _PLAIN, (0,), 0), (_LINK, _MANY, _FEW + _LINKS, _PLAIN, (0,), 0),
    (_SHORT + _MID[:1], _ANY, _TEXT, _PLAIN, (1,), 1), (_SHORT + _MID[:1], _ANY, _LINKS, _PLAIN, (1,), 0),
    # where names speak against it: long text with more of it on one side and no links on the other
    (_LONG, _MANY, _TEXT, _LOOSE, _BOTH, 1), (_LONG, _FEW, _MANY, _LOOSE, _BOTH, 1), (_LONG, _LINKS, _ANY, _LOOSE, _BOTH, 0), (_LONG, _MANY, _LINKS, _LOOSE, _BOTH, 0),
    (_LONG, _FEW, _FEW + _LINKS, _LOOSE, _BOTH, 0), (_SHORT + _MID + _LINK, _ANY, _ANY, _LOOSE, _BOTH, 0),
    # where the page has a main part elsewhere: long text with more of it on both sides
    (_LONG, _MANY, _MANY, _OUT, _BOTH, 1), (_LONG, _FEW + _LINKS, _ANY, _OUT, _BOTH, 0), (_LONG, _MANY, _FEW + _LINKS, _OUT, _BOTH, 0), (_SHORT + _MID + _LINK, _ANY, _ANY, _OUT, _BOTH, 0),
    # menus, asides, hidden text and the like: never
    (_SHORT + _MID + _LONG + _LINK, _FEW[1:2] + _MANY[1:] + _LINKS[:1], _FEW[1:2] + _MANY[1:] + _LINKS[:1], _BOILER, _BOTH, 0),
)
#: The labelled table, in the order of FEATURES (main, boiler and marked: 0 to 2); the last value is the label.
LABELLED = tuple((*own, *before, *after, *marks, heading, label) for *case, label in _CASES for own, before, after, marks, heading in product(*case))


def grow(rows: tuple, depth: int = 20):
    """A binary decision tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above it)."""
    ones = sum(r[-1] for r in rows)
    majority = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return majority

    def impurity(n: int, ones: int) -> float:
        return ones * (n - ones) / n

    best = None
    for j in range(len(rows[0]) - 1):
        n, good = Counter(r[j] for r in rows), Counter(r[j] for r in rows if r[-1])
        values, below, hits = sorted(n), 0, 0
        for a, b in zip(values, values[1:]):
            below, hits = below + n[a], hits + good[a]
            score = impurity(below, hits) + impurity(len(rows) - below, ones - hits)
            if best is None or score < best[0] - 1e-12:  # ties: the earlier feature, the lower threshold
                best = score, j, (a + b) / 2
    if best is None:
        return majority
    _, j, t = best
    return j, t, grow(tuple(r for r in rows if r[j] <= t), depth - 1), grow(tuple(r for r in rows if r[j] > t), depth - 1)


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def classify(features: tuple, node) -> int:
    while not isinstance(node, int):
        j, t, low, high = node
        node = low if features[j] <= t else high
    return node


def described(found: list[Block]) -> list[tuple]:
    """FEATURES of each block; beyond the first and the last block there are 0 words."""
    marked = max((b.main for b in found if not b.boiler), default=0)
    around = [(0, 0.0), *((b.words, b.density) for b in found), (0, 0.0)]
    return [(b.words, b.density, *around[i], *around[i + 2], b.main, b.boiler, marked, int(b.heading)) for i, b in enumerate(found)]


def main_text(page: str | None) -> str:
    """Article blocks of a page joined by an empty line; null and pages without any give the empty text."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, x in zip(found, described(found)) if classify(x, tree()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null html counts as empty. Repeated rows each get a row, an empty table
    gives none, other columns are ignored.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [main_text(x) for x in part["html"].tolist()]
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")).mapInPandas(
        run, "page_id long, url string, text string, n_chars long")
