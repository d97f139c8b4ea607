"""Main text of web pages by tag-path ratios.

A page is read as text nodes with their root-to-leaf tag path, tags with classes and
ids. Per path, text length and punctuation are summed over its nodes and divided by
their number; along the page, both ratios are smoothed over neighbouring nodes, fused by
multiplication, and a node stays if the fused value reaches LEAST of its spread, or
ENOUGH characters. What lies in the element that holds a node that stays, stays with it,
however short; in the page's body itself, that is so for all but nodes that are nothing
but links. A heading stays with what it stands above. Paths that pass through an element
whose kind or name says boilerplate (a menu, header, footer, sidebar, notice, advert, form
or reader comments) weigh nothing; a name that articles bear too counts only where the
element does not hold most of the page's text, any name only where something else is left,
and none on html, body, main and article. Boilerplate without a telling name goes by the
ratios alone. A page is read in one pass, in time linear in its length.

Defined results: null and empty pages, and pages without content nodes, give an empty
text; unclosed tags end where their parent or a sibling does, a head at the first element
that it cannot hold, and a quote that does not end with its tag; a null page_id or url
stays null; repeated rows each give a row; an empty table gives none; other columns are
ignored; nothing is cut short.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.2
ENOUGH = 30.0
KERNEL = np.array([0.25, 0.5, 0.25])
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*|[^<>]*)>|<[!?][^<>]*>""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_UNSEEN = re.compile(r"""\shidden(?:[\s=/]|\Z)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
#: words of a class list; what a page has not, or only has somewhere, says nothing of the element itself
_WORD = r"(?:^|(?<!\bno)(?<!\bhas)(?<!\bwith)(?<!\bwithout)[-_]|[ ])(?:%s)(?:$|[-_ ])"
_BOILERPLATE = re.compile(
    _WORD % r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|nav-?(?:bar|list|links?|menu|wrap)\w*|navigation\w*|menu\w*|breadcrumb\w*|masthead|foot|footer\w*|side-?bar\w*|cookie\w*|consent|popup|modal|newsletter|subscri\w*|sharing|comments?|commentlist|replies|respond|login|pagination|pager|complementary|contentinfo|dialog",
    re.I,
)
#: names that articles bear too: boilerplate unless the element holds more than half of the page's plain text
_DOUBTFUL = re.compile(_WORD % r"header|aside|widget\w*|notice\w*|alert|share|social|related|recommend\w*|search|copyright|disclaimer|legal", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg object select option button datalist".split())
_DROPPED = frozenset("head nav header footer aside form menu dialog label fieldset audio video canvas figure-ad".split()) | _RAW
#: what a head may hold; anything else ends it
_HEAD = frozenset("head title meta link base style script noscript template".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics annotation".split())
#: elements that hold a page or its article: their names say what the page has, not what they are
_WHOLE = frozenset("html body main article".split())

#: an opening tag ends an open sibling of these kinds
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul)(?=[\s/>])", re.I)
#: raw elements that cannot hold one of their own kind: a second one before the end tag says that the first is unclosed
_FLAT = frozenset("textarea title select option button".split())
_BROKEN = re.compile(r"<[a-zA-Z/!?][^<>]*(?:>|\Z)")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")


@dataclass
class Node:
    """One block's run of text."""

    path: int
    text: str
    weight: float  # 0 in an element of a boilerplate kind, or that is not seen
    doubtful: int  # the outermost block of a doubtful name that it lies in, or 0
    named: int  # the innermost element of a boilerplate name that it lies in, or 0
    block: int  # the block that it lies in; 0 is the page, as html and body are
    linked: bool  # nothing but links
    heading: bool


@dataclass
class Open:
    """An open element, with what it has from those that it lies in."""

    tag: str
    path: int
    dropped: bool
    doubtful: int
    named: int
    block: int
    leaf: str  # the tag of the innermost block
    link: bool
    head: bool


@dataclass
class Page:
    nodes: list[Node]
    holder: list[int]  # of each block the one that it lies in
    outer: dict[int, int]  # of each element of a boilerplate name the next one around it, or 0


_ROOT = Open("", 0, False, 0, 0, 0, "", False, False)


def read(page: str) -> Page:
    """The text nodes of a page, in one pass: each element takes over what it lies in, so that depth costs nothing."""
    out, holder, outer = [], [0], {}
    stack: list[Open] = []
    opened: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    closes: dict[str, re.Match | None] = {}
    held: list[str] = []
    at = plain = elements = 0

    def top() -> Open:
        return stack[-1] if stack else _ROOT

    def push(x: Open) -> None:
        stack.append(x)
        opened[x.tag] = opened.get(x.tag, 0) + 1

    def cut(level: int) -> None:
        for x in stack[level:]:
            opened[x.tag] -= 1
        del stack[level:]

    def put(raw: str) -> None:
        nonlocal plain
        if raw:
            held.append(entities.unescape(raw))
            if not top().link and raw.strip():
                plain += 1

    def end_block() -> None:
        nonlocal plain
        text, linked = " ".join("".join(held).split()), not plain
        held.clear()
        plain = 0
        if text:
            x = top()
            out.append(Node(x.path, text, 0.0 if x.dropped else 1.0, x.doubtful, x.named, x.block, linked, x.leaf in _HEADINGS))

    def close_of(tag: str) -> re.Match | None:
        """The next end tag of a kind; looked for once, as long as it lies ahead."""
        found = closes.get(tag, page)
        if found is page or (found and found.start() < at):
            closes[tag] = found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
        return found

    while m := _TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in _INLINE:
                end_block()
            if opened.get(tag):
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if top().head and tag not in _HEAD:
            end_block()
            cut(next(i for i, x in enumerate(stack) if x.tag == "head"))
        if tag in _RAW:
            if tag not in ("button", "option"):
                end_block()
            close = close_of(tag)
            if close and tag in _FLAT and re.compile(rf"<{tag}(?=[\s/>])", re.I).search(page, at, close.start()):
                close = None
            if close:
                at = close.end()
            else:
                block = _BLOCK.search(page, at)
                at = block.start() if block else len(page)
            continue
        if tag in _VOID:
            if tag == "wbr":
                continue
            if tag in ("br", "img", "input"):
                held.append(" ")
            else:
                end_block()
            continue
        names = ["".join(n) for n in _NAME.findall(m[3])] if m[3] else []
        told = [] if tag in _WHOLE else names
        named = any(_BOILERPLATE.search(n) for n in told)
        dropped = tag in _DROPPED or bool(m[3] and tag not in ("html", "body") and _UNSEEN.search(m[3]))
        if tag in _INLINE:
            if named or dropped:
                end_block()
            x = top()
        else:
            end_block()
            while stack and stack[-1].tag in _INLINE:
                cut(len(stack) - 1)
            if tag not in _ENDS:
                if stack and stack[-1].tag == "p":
                    cut(len(stack) - 1)
            else:
                scope = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
                for i in range(len(stack) - 1, -1, -1) if any(opened.get(k) for k in _ENDS[tag]) else ():
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in _ENDS[tag]:
                        cut(i)
                        break
            x = top()
        inner = x.named
        if named:
            elements += 1
            inner = elements
            outer[inner] = x.named
        if tag in _INLINE:
            push(Open(tag, x.path, x.dropped or dropped, x.doubtful, inner, x.block, x.leaf, x.link or tag == "a", x.head))
            continue
        block = x.block
        if tag not in ("html", "body"):
            block = len(holder)
            holder.append(x.block)
        doubtful = x.doubtful or (block if any(_DOUBTFUL.search(n) for n in told) else 0)
        path = paths.setdefault((x.path, ".".join([tag, *names])), len(paths) + 1)
        push(Open(tag, path, x.dropped or dropped, doubtful, inner, block, tag, x.link, x.head or tag == "head"))
    put(_BROKEN.sub(" ", page[at:]))
    end_block()
    return Page(out, holder, outer)


def nodes(page: str) -> list[Node]:
    return read(page).nodes


def _seen(page: Page) -> list[Node]:
    """Nodes outside elements of a boilerplate kind or name. Where such names leave nothing but links, an element with one of
    them that holds most of the plain text is the article, whatever its name: others inside it still go."""
    found = [n for n in page.nodes if n.weight > 0]
    free = [n for n in found if not n.named]
    if not any(n.named for n in found) or any(not n.linked for n in free):
        return free
    size = dict.fromkeys(page.outer, 0)
    for n in found:
        if n.named and not n.linked:
            size[n.named] += len(n.text)
    for e in sorted(page.outer, reverse=True):  # the inner ones first
        if page.outer[e]:
            size[page.outer[e]] += size[e]
    total = sum(len(n.text) for n in found if not n.linked)
    kept = {0}
    for e in sorted(page.outer):
        if page.outer[e] in kept and 2 * size[e] > total:
            kept.add(e)
    return [n for n in found if n.named in kept]


def path_ratios(page: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Per node: text length and punctuation marks of its path, by the path's number of nodes."""
    number: dict[int, int] = {}
    of = np.array([number.setdefault(n.path, len(number)) for n in page], np.int64)
    count = np.bincount(of)
    length = np.bincount(of, [len(n.text) for n in page]) / count
    marks = np.bincount(of, [len(_PUNCTUATION.findall(n.text)) for n in page]) / count
    return length[of], marks[of]


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 1, mode="edge"), KERNEL, "valid")


def _undoubted(page: list[Node]) -> list[Node]:
    """page without blocks of doubtful names, but for one with more than half of the plain text."""
    size: dict[int, int] = {}
    for n in page:
        if not n.linked:
            size[n.doubtful] = size.get(n.doubtful, 0) + len(n.text)
    total = sum(size.values())
    return [n for n in page if not n.doubtful or 2 * size.get(n.doubtful, 0) > total]


def content(page: str) -> str:
    read_page = read(page)
    own = _undoubted(_seen(read_page))
    if not own:
        return ""
    length, marks = path_ratios(own)
    fused = _smooth(length) * (1 + _smooth(marks))
    keep = fused >= min(LEAST * float(fused.std()), float(fused.max()), ENOUGH)
    holder = read_page.holder
    holders = {holder[n.block] for n, k in zip(own, keep.tolist(), strict=True) if k and not n.linked}
    inside = [False] * len(holder)  # whether a block lies in one of the holders, the page itself left out
    for block in range(1, len(holder)):
        inside[block] = block in holders or inside[holder[block]]
    for i, n in enumerate(own):
        keep[i] |= inside[n.block] or (0 in holders and not n.linked)
    for i in range(len(own) - 2, -1, -1):
        if own[i].heading:
            keep[i] |= keep[i + 1]
    return " ".join(n.text for n, k in zip(own, keep.tolist(), strict=True) if k)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [content(h) for h in batch["html"]]})

    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op10_tag_path_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
