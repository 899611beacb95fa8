"""HTML extraction: flat text blocks, their shallow features, and a trained decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import others, quoted

# HTML element names by what they do, and words that name page parts in classes and ids.
SILENT = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "select", "object", "head", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a start tag ends if they are open, with no element between that bounds them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}}
BOUNDS = set(
    "address article aside blockquote body button caption center details dialog dir div dl fieldset figcaption figure footer form header hgroup html li main menu nav object ol pre search section select summary table td template th ul".split()
)
TABLE_TAGS, TABLE_BOUNDS = {"tr", "td", "th", "tbody", "tfoot"}, {"html", "table", "template"}
# Start tags that end an open p.
ENDS_P = (BOUNDS - {"body", "button", "caption", "html", "object", "select", "td", "template", "th"}) | {"dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "p"}
PARTS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
WHOLE = {"html", "body", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PART_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus "
    "footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination pager popup promo promotion related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
# Words of names that say nothing about a part's kind; those that an article's own opening may have; and elements like them.
NEUTRAL_WORDS = set("area bar block box container content group inner item js left list main outer page reader right section site top user wrap wrapper".split())
OPENING_WORDS, OPENING = {"header", "masthead", "banner"}, {"header"}
PART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PLAIN, _HUMPS = re.compile(r"[a-z]+"), re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    """Text between two block boundaries, with its words and those in links."""

    text: str
    words: int
    linked: int
    main: bool
    part: bool
    named: float
    heading: bool
    item: bool
    label: str | None = None


@dataclass
class _Open:
    tag: str
    main: bool
    part: bool
    named: float
    label: str | None


@lru_cache(maxsize=1 << 14)
def _marks(tag: str, attributes: str, within: bool) -> tuple[bool, bool, float, str | None]:
    """Whether an element names main text, whether its tag or role names another part of a page, how much of a name of its
    does so (of the words of one class or id that say anything), and its label (in training pages). Within main
    text a header is its opening."""
    main, part, named, label = tag in MAIN, tag in PARTS and not (within and tag in OPENING), 0.0, None
    if attributes:
        for name, *values in _NAMED.findall(attributes):
            if name.lower() == "role":
                words = _PLAIN.findall("".join(values).lower())
                main, part = main or "main" in words, part or not PART_ROLES.isdisjoint(words)
            elif tag not in WHOLE:
                for one in "".join(values).split():
                    words = [w for w in _PLAIN.findall(_HUMPS.sub(r"\1 \2", one).lower()) if w not in NEUTRAL_WORDS]
                    meant = PART_WORDS - OPENING_WORDS if within else PART_WORDS
                    named = max(named, sum(w in meant for w in words) / max(1, len(words)))
        if m := re.search(r"data-is=(\w+)", attributes):
            label = m[1]
    return main, part, named, label


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Scripts, styles, comments and the head give none."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[tuple[str, bool]] = []
    links = silent = 0
    # An inline element that is a part by its whole name, and how many of its tag are open within it: its text breaks no block.
    aside, depth = "", 0

    def flush() -> None:
        nonlocal parts, aside
        aside = ""
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                top = stack[-1] if stack else _Open("", False, False, 0.0, None)
                linked = sum(len(t.split()) for t, on in parts if on)
                out.append(Block(text, text.count(" ") + 1, linked, top.main, top.part, top.named, any(o.tag in HEADINGS for o in stack[-3:]), any(o.tag == "li" for o in stack[-3:]), top.label))
            parts = []

    def close(tag: str) -> None:
        nonlocal silent
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                silent -= sum(o.tag in SILENT for o in stack[i:])
                del stack[i:]
                return

    def end_open(tags: set[str], bounds: set[str]) -> None:
        """Closes the innermost of `tags`, unless one of `bounds` is open within it."""
        for o in reversed(stack):
            if o.tag in tags:
                close(o.tag)
                return
            if o.tag in bounds:
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not silent and not aside:
            parts.append((html.unescape(text), links > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if aside and tag == aside:
            depth += -1 if m[1] else 1
            aside = aside if depth else ""
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                flush()
                links = 0
                close(tag)
            continue
        if tag == "a":
            links = 1
        elif tag == "br" or tag == "img":
            parts.append((" ", False))
        if tag in INLINE:
            if tag not in VOID and not aside and _marks(tag, m[3], False)[2] == 1:
                aside, depth = tag, 1
            continue
        if tag in RAW:
            # Its text is no markup and ends at its own end tag only; it breaks no block.
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        flush()
        links = 0
        if tag in ENDS_P:
            end_open({"p"}, BOUNDS)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag == "body":
            close("head")
        if tag in ENDS:
            end_open(ENDS[tag], TABLE_BOUNDS if tag in TABLE_TAGS else BOUNDS)
        above = stack[-1] if stack else _Open("", False, False, 0.0, None)
        main, part, named, label = _marks(tag, m[3], above.main)
        stack.append(_Open(tag, above.main or main, above.part or part, max(above.named, named), label or above.label))
        silent += tag in SILENT
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_main", "in_part", "part_name", "heading", "item")


def features(them: list[Block]) -> np.ndarray:
    n = len(them)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(them):
        out[i, 0], out[i, 1], out[i, 6:] = b.words, b.linked / b.words, (b.main, b.part, b.named, b.heading, b.item)
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
    return out


@dataclass
class Tree:
    """A binary decision tree: inner nodes test feature <= limit."""

    feature: list[int] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, limit, low, high = map(np.array, (self.feature, self.limit, self.low, self.high))
        while (inner := feature[at] >= 0).any():
            i = np.nonzero(inner)[0]
            f = feature[at[i]]
            at[i] = np.where(x[i, f] <= limit[at[i]], low[at[i]], high[at[i]])
        return np.array(self.value)[at] >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """CART with the Gini index; of equal splits the first feature and the lowest limit win."""
    tree = Tree()

    def node(rows: np.ndarray, left: int) -> int:
        me = len(tree.value)
        tree.feature.append(-1), tree.limit.append(0.0), tree.low.append(0), tree.high.append(0)
        tree.value.append(float(y[rows].mean()))
        gini = lambda p, n: 2 * p * (1 - p / n) if n else 0.0
        best = (gini(y[rows].sum(), len(rows)) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]) if left else ():
            v = np.unique(x[rows, f])
            for cut in (v[1:] + v[:-1]) / 2:
                below = rows[x[rows, f] <= cut]
                n = len(below)
                if min(n, len(rows) - n) < least:
                    continue
                p, q = y[below].sum(), y[rows].sum() - y[below].sum()
                score = gini(p, n) + gini(q, len(rows) - n)
                if score < best[0] - 1e-12:
                    best = (score, f, float(cut))
        if best[1] >= 0:
            tree.feature[me], tree.limit[me] = best[1], best[2]
            side = x[rows, best[1]] <= best[2]
            tree.low[me] = node(rows[side], left - 1)
            tree.high[me] = node(rows[~side], left - 1)
        return me

    node(np.arange(len(y)), depth)
    return tree


def _words(n: int) -> str:
    return " ".join(["word"] * n)


def labelled_pages() -> list[str]:
    """Small pages whose blocks are labelled by `data-is` (main or other) on the elements around them.

    The first kind has an article element; short, long, linked and listed blocks stand in it, and parts that are
    not main text, in and beside it. The second kind has no article element: only words and links tell.
    """
    links = lambda n, k=1: "".join(f"<li><a href=x>{_words(k)}</a></li>" for _ in range(n))
    para = lambda *n: "".join(f"<p>{_words(k)}</p>" for k in n)
    out = []
    for sizes in ((1, 40, 3, 120), (60, 2, 1, 7), (9,), (15, 1, 1, 300, 12), (1,), (25, 80), (4, 6, 5)):
        inner = f"<h1>{_words(7)}</h1>{para(*sizes)}<ul>{'<li>' + _words(4) + '</li>'}</ul><blockquote>{_words(12)}</blockquote><p>{_words(3)} <a href=x>{_words(5)}</a></p><p><a href=x>{_words(2)}</a></p>"
        extra = f"<aside data-is=other>{para(14)}</aside><div class=comments data-is=other>{para(11, 30, 3)}</div><div class=share data-is=other><a href=x>{_words(2)}</a></div>"
        out.append(
            f"<nav data-is=other><ul>{links(6)}</ul></nav><div class=ad data-is=other>{_words(9)}</div><div class='cookie-notice' data-is=other>{para(25)}</div>"
            f"<article data-is=main>{inner}{extra}</article><section class=comments data-is=other>{para(18, 50)}</section><footer data-is=other>{_words(11)}</footer>"
        )
        out.append(
            f"<header data-is=other>{_words(5)}</header><div class=sidebar data-is=other>{para(30)}<ul>{links(4, 3)}</ul></div><main data-is=main>{inner}</main>"
            f"<form data-is=other>{_words(4)}</form><div id=newsletter data-is=other>{para(22, 70)}</div><footer data-is=other>{para(40)}</footer>"
        )
        out.append(f"<article data-is=main>{inner}</article>")
        out.append(f"<article data-is=main>{para(*sizes)}</article>")
        out.append(f"<div data-is=main>{para(30, 12, 45, 25)}</div>")
        for k in sizes:
            # Other parts of any length, beside blocks of any length.
            out.append(f"<article data-is=main>{para(k, 30)}</article><footer data-is=other>{_words(k + 4)}</footer><div class=ad data-is=other>{para(3 * k, 21, 60)}</div>")
            out.append(f"<nav data-is=other>{para(k + 9)}</nav><article data-is=main>{para(20)}</article><footer data-is=other>{_words(k + 12)}</footer>")
            out.append(f"<div class=sidebar data-is=other>{para(40, k, 90)}</div><div data-is=main>{para(50, 70)}</div><footer data-is=other>{_words(k + 17)}</footer>")
        # Names that speak of a part and of something else; openings of articles; discussions under other names.
        out.append(f"<article data-is=main><div class='header-wrap'><h1>{_words(6)}</h1>{para(*sizes)}</div>{para(20, 9)}</article><section id='reader-discussion' data-is=other>{para(12, 33, 4)}</section>")
        out.append(f"<div class='legal-analysis' data-is=main><h1>{_words(8)}</h1>{para(30, *sizes, 45)}</div><div class='legal-notice' data-is=other>{para(30, 12)}</div>")
        out.append(f"<article class='post menu-engineering' data-is=main><header><h1>{_words(5)}</h1><p>{_words(12)}</p></header>{para(*sizes)}<div class='search-results-explained'>{para(26, 8)}</div></article>")
        out.append(f"<header class='site-header' data-is=other>{para(9)}</header><div class='shareholder cookie-recipes' data-is=main>{para(40, 15, *sizes, 33)}</div><div class='social-share' data-is=other>{para(4, 18)}</div>")
        out.append(f"<div data-is=other>{_words(6)}</div><main data-is=main>{para(*sizes)}</main><div data-is=other>{_words(8)}</div>")
        out.append(f"<div data-is=other>{_words(5)}</div><div data-is=other><ul>{links(5, 2)}</ul></div><div data-is=main>{para(45, 6, 90, 30, 3, 60)}{para(20, 16, 22)}</div><div data-is=other><ul>{links(2, 20)}</ul><p><a href=x>{_words(35)}</a> {_words(5)}</p></div><div data-is=other><a href=x>{_words(3)}</a> <a href=x>{_words(2)}</a></div><div data-is=other>{_words(4)}</div>")
    return out


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    pages = [blocks(p) for p in labelled_pages()]
    return grow(np.concatenate([features(p) for p in pages]), np.array([b.label == "main" for p in pages for b in p], float))


def main_text(page: str | None, tree: Tree) -> str:
    them = blocks(page or "")
    if not them:
        return ""
    keep = tree.predict(features(them))
    return "\n".join(b.text for b, k in zip(them, keep, strict=True) if k)


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """`pages` with `out string` for the markup in `html_col` (null: empty), the blocks that the tree calls main
    text, joined by line feeds; empty if there are none. A column called `out`, in upper or lower case, is replaced, others pass
    through, the markup does not. Broken markup is read as far as it goes; no length is too long."""
    rest = others(pages, html_col, out)
    df = pages.select(*[F.col(quoted(c)) for c in rest], F.col(quoted(html_col)))
    schema = StructType([*df.schema.fields[:-1], StructField(out, StringType())])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for batch in them:
            got = pa.array([main_text(x.as_py(), tree) for x in batch.column(len(rest))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*rest, out])

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(batches, schema)
