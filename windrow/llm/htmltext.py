"""Main text of web pages by tag-path ratios.

Text blocks are grouped by their root-to-leaf tag path.  Each path has a text ratio (characters outside links a block)
and a punctuation ratio (punctuation marks a block); both are smoothed along the page, fused by multiplication, and
averaged over the path.  Paths over a share of the best are content.  The container is the innermost element that holds
nearly all content; in it, blocks of content paths are the text, with the headings, short paragraphs and lists that stand
among them.  Names weigh paths: inside article and main more, in what a class, id or role names as advert, menu and the
like less; such blocks aren't taken along with content, but may be it.  Elements for menus, headers, footers, asides and
forms are left out by themselves.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[A-Za-z][^>]*\Z",
    re.S,
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¡¿«»„“”]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
_RAW = frozenset("script style title textarea noscript template xmp iframe svg object canvas".split())
_SWALLOWS = frozenset("script style title textarea xmp iframe".split())  # without an end tag, all to the end of the page
_NOT_TEXT = frozenset("head nav header footer aside form button select option dialog menu fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = frozenset("p pre blockquote figcaption".split())
_LISTED = frozenset("li dt dd td th caption".split())
#: Elements that a new element of the kind ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_IMPLIED = frozenset("p li dt dd tr td th option thead tbody tfoot html body head".split())  # may do without end tags
#: Elements that don't stand within an unclosed menu, footer or the like, so that it ends before them.
_BEGINS = frozenset("main article section p".split()) | _HEADINGS
#: Elements that the container isn't looked for in.
_NO_CONTAINER = frozenset("p pre blockquote ul ol dl li dt dd figure figcaption table".split()) | _HEADINGS
#: Words of class, id and role that name what isn't the article, and those that may stand beside them in one name.
_OUTSIDE_WORD = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscri\w+|signup|login|social|share|sharing|nav\w*|menu\w*|breadcrumbs?|sidebar|widget\w*|related|recommend\w*|teasers?|footer|header|masthead|copyright|comments?|replies|reply|disqus|search|pagination|pager|tags?|toolbar|complementary|contentinfo|navigation"
_BESIDE_WORD = r"site|page|main|global|primary|secondary|top|bottom|left|right|side|sticky|fixed|mobile|desktop|box|bar|list|links?|items?|wrap|wrapper|container|block|section|area|slot|inner|outer|buttons?|form|posts?|articles?|user|\d+"
_OUTSIDE = re.compile(rf"(?:(?:{_BESIDE_WORD})[-_])*(?:{_OUTSIDE_WORD})(?:[-_](?:{_BESIDE_WORD}|{_OUTSIDE_WORD}))*", re.I)


@dataclass
class Block:
    """A run of text: the number of its element's path, of its element and that one's name.

    ``outside``: in an element that holds no article text, as a menu or footer; ``marked``: in one whose name tells so;
    ``article``: the number of the innermost article or main element, 0 without one; ``links``: characters in links.
    """

    path: int
    element: int
    tag: str
    text: str
    outside: bool
    marked: bool
    article: int
    links: int


@dataclass
class Page:
    """Blocks in page order; of each element its parent's number (less than its own; 0 is the page) and name."""

    blocks: list[Block]
    parent: list[int]
    name: list[str]


def _events(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes) of texts, breaks, links, start and end tags in order."""
    found: list[tuple[str, str, str]] = []
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            found.append(("text", piece, ""))
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        closing = bool(m["close"] or m["close2"])
        if name == "a":
            found.append(("link", "" if closing else "a", ""))
        elif not name or name in _INLINE or name == "wbr":
            continue
        elif name in _VOID:
            if name in ("br", "hr"):
                found.append(("text", " ", ""))
        elif name in _RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end or name in _SWALLOWS:
                at = end.end() if end else len(page)
            found.append(("text", " ", ""))
        elif name not in _RAW:
            found.append(("close" if closing else "open", name, m["attrs"] or m["attrs2"] or ""))
    return found


def parsed(page: str) -> Page:
    """The page's blocks and elements, in time that follows its length.

    Text in elements that never hold text (scripts, styles, titles) is left out.  An element without an end tag ends
    where the next of its name begins; a menu, footer or the like without one ends before the next paragraph, heading,
    section, article or main element.  Of a header within an article the headings are article text, the rest isn't.
    """
    events = _events(page)
    open_: dict[str, list[int]] = {}
    closed = bytearray(len(events))
    for i, (kind, name, _) in enumerate(events):
        if kind == "open":
            open_.setdefault(name, []).append(i)
        elif kind == "close" and open_.get(name):
            closed[open_[name].pop()] = 1
    out = Page([], [0], [""])
    paths: dict[tuple[int, str], int] = {}
    top = (0, "", 0, 0, False, 0, True)  # element, name, path, outside (1: a header in an article), marked, article, closed
    stack = [top]
    standing: dict[str, int] = {}
    loose: list[int] = []  # where in the stack unclosed menus and the like stand
    parts: list[str] = []
    links = in_link = 0

    def end_block() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            element, name, path, outside, marked, article, _ = stack[-1]
            out.blocks.append(Block(path, element, name, text, outside == 2 or outside == 1 and name not in _HEADINGS, marked, article, links))
        parts.clear()
        links = 0

    def pop(k: int) -> None:
        """Leave the elements from place k of the stack on."""
        while len(stack) > k:
            standing[stack.pop()[1]] -= 1
        while loose and loose[-1] >= len(stack):
            loose.pop()

    for i, (kind, name, attrs) in enumerate(events):
        if kind == "text":
            parts.append(name)
            if in_link:
                links += len(name)
            continue
        if kind == "link":
            in_link = bool(name)
            continue
        end_block()
        in_link = 0
        if kind == "close":
            if standing.get(name):
                k = len(stack) - 1
                while stack[k][1] != name:
                    k -= 1
                pop(k)
            continue
        if name in _ENDS_P and stack[-1][1] == "p":
            pop(len(stack) - 1)
        while stack[-1][1] in _ENDS.get(name, ()):
            pop(len(stack) - 1)
        if name in _BEGINS and loose:
            pop(loose[0])
        while stack[-1][1] == name and not stack[-1][6]:
            pop(len(stack) - 1)
        marks = " ".join(filter(None, (a or b or c for a, b, c in _MARK.findall(attrs))))
        _, _, path, outside, marked, article, _ = stack[-1]
        own = name + ("." + ".".join(sorted(set(marks.lower().split()))) if marks else "")
        out.parent.append(stack[-1][0])
        out.name.append(name)
        element = len(out.parent) - 1
        if name in _NOT_TEXT:
            outside = max(outside, 1 if name == "header" and article else 2)
        if name not in ("html", "body", "article", "main"):
            marked = marked or any(_OUTSIDE.fullmatch(m) for m in marks.split())
        whole = bool(closed[i]) or name in _IMPLIED
        if name in _NOT_TEXT and not whole:
            loose.append(len(stack))
        standing[name] = standing.get(name, 0) + 1
        stack.append((element, name, paths.setdefault((path, own), len(paths) + 1), outside, marked, element if name in ("article", "main") else article, whole))
    end_block()
    return out


def blocks(page: str) -> list[Block]:
    return parsed(page).blocks


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = math.ceil(2 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def path_scores(found: list[Block], sigma: float = 1.0, inside_article: float = 4.0, when_marked: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """(path number of each block, score of each path): the mean over its blocks of the fused, smoothed ratios.

    A path scores at most four times its own ratios, so that a menu beside long paragraphs doesn't pass by them, and
    ``inside_article`` times as much within article or main elements, ``when_marked`` times in what is named otherwise.
    """
    index: dict[int, int] = {}
    path = np.array([index.setdefault(b.path, len(index)) for b in found], int)
    n = np.bincount(path)
    length = np.bincount(path, [max(0, len(b.text) - b.links) for b in found]) / n
    marks = np.bincount(path, [len(_PUNCTUATION.findall(b.text)) for b in found]) / n
    fused = _smooth(length[path], sigma) * (1 + _smooth(marks[path], sigma))
    score = np.minimum(np.bincount(path, fused) / n, 4 * length * (1 + marks))
    weigh = lambda flags, w: np.where(np.bincount(path, flags) > 0, w, 1.0)
    return path, score * weigh([bool(b.article) for b in found], inside_article) * weigh([b.marked for b in found], when_marked)


def content_blocks(found: list[Block], share: float = 0.2) -> np.ndarray:
    """Which blocks are on content paths, those that score at least ``share`` of the best path."""
    path, score = path_scores(found)
    return ((score >= share * score.max()) & (score > 0))[path]


def _container(page: Page, found: list[Block], content: np.ndarray, most: float = 0.7) -> int:
    """The innermost element with ``most`` of its parent's content, not going into article and main elements, lists, paragraphs or single blocks."""
    n = len(page.parent)
    mass, size, own = [0] * n, [0] * n, [0] * n
    for b, c in zip(found, content.tolist(), strict=True):
        mass[b.element] += max(0, len(b.text) - b.links) if c else 0
        size[b.element] += 1
        own[b.element] += 1
    best = [0] * n  # the child with most content, the first of equals
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        mass[up] += mass[e]
        size[up] += size[e]
        if size[e] and (not best[up] or mass[e] >= mass[best[up]]):
            best[up] = e
    here = 0
    while True:
        inner = best[here]
        if not inner or mass[inner] < most * mass[here] or page.name[inner] in _NO_CONTAINER or size[inner] == own[inner] == 1:
            break
        here = inner
        if page.name[here] in ("article", "main"):
            break
    return here


def main_text(page: str | None) -> str:
    """The page's main text; empty for a null or empty page, or one without text but in menus, footers and the like."""
    whole = parsed(page or "")
    found = [b for b in whole.blocks if not b.outside]
    if not found:
        return ""
    content = content_blocks(found)
    if not content.any():  # nothing but links: those of an article, if there is one
        return " ".join(b.text for b in found if b.article and not b.marked)
    top = _container(whole, found, content)
    under = [0] * len(whole.parent)  # of each element the child of the container that it is in, itself included
    inside = bytearray(len(whole.parent))
    inside[top] = 1
    for e in range(1, len(under)):
        up = whole.parent[e]
        if e != top and inside[up]:
            inside[e], under[e] = 1, e if up == top else under[up]
    here = [i for i, b in enumerate(found) if inside[b.element]]
    holds = {under[found[i].element] for i in here if content[i]}  # children of the container that hold content
    first, last = min(i for i in here if content[i]), max(i for i in here if content[i])
    text = []
    for i in here:
        b = found[i]
        c, direct = under[b.element], under[b.element] == b.element
        if b.tag in _HEADINGS:
            belongs = i < last or c in holds
        elif b.tag in _LISTED:  # of a list without content too, if it follows some
            belongs = i > first or c in holds
        else:
            belongs = b.tag in _PLAIN and (c in holds or direct and (first < i < last or i > last and bool(b.article)))
        if content[i] or belongs and not b.marked and 2 * b.links <= len(b.text):
            text.append(b.text)
    return " ".join(text)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row; null html gives an empty text; repeated rows repeat; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in column_rows(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(pages: DataFrame) -> DataFrame:
    """``extract`` of every row: null and empty html give an empty text, repeated rows repeated results, an empty table none."""
    return extract(pages)
