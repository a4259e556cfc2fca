"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into flat blocks of text. A block is described by its words, its share of linked words, the same of its
neighbours, and what its enclosing elements say of it; a decision tree, trained on a small labelled table of blocks,
says which blocks belong to the article. An element that holds the article itself says nothing, whatever its name.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of

# Elements whose content is no text of the page, elements without an end, inline elements.
SILENT = "script style noscript template textarea title select option iframe object svg math canvas audio video head".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
# Elements that hold no article, and the words of class, id and role that say so.
OUTSIDE = "nav header footer aside form menu dialog button fieldset".split()
CUES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside widget related recommended recommendations share sharing social comment comments reply replies "
    "disqus respond menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright legal pagination pager toolbar search form skip"
).split()
FEATURES = "in_article outside cued heading words linked words_before linked_before words_after linked_after".split()

_ATTRIBUTES = r"""(?>[^>"']+|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SILENT, _VOID, _INLINE, _OUTSIDE, _CUES = map(frozenset, (SILENT, VOID, INLINE, OUTSIDE, CUES))
# First or last parts of names of states, first parts of names of an article's own parts.
_STATES = frozenset("has no not with without is enabled disabled open opened closed active inactive visible hidden allowed layout".split())
_PARTS = frozenset("entry post article content story page main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Starting one of these ends an open one of the same kind, as the end tag may be left out.
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _cued(attributes: str) -> bool:
    """Whether a class, id or role says that the element holds no article.

    A name says so by its first or last part (``cookie-notice``, ``userComments``); names of a state (``has-sidebar``,
    ``comment-open``) and of a part of the article (``entry-header``) don't.
    """
    for found in _NAMED.findall(attributes):
        for name in found.strip("\"'").split():
            parts = _WORDS.findall(_CAMEL.sub(" ", name).lower())
            if not parts or parts[0] in _STATES or parts[-1] in _STATES:
                continue
            if parts[-1] in ("header", "head", "title") and parts[0] in _PARTS:
                continue
            if parts[0] in _CUES or parts[-1] in _CUES:
                return True
    return False


@dataclass
class _Element:
    tag: str
    parent: int
    cued: bool
    words: int = 0
    spans: bool = False  # the article's element is inside, or most of a page without one


def _blocks_and_elements(html: str) -> tuple[list[tuple[str, int, int, float]], list[_Element]]:
    """(text, element, words, linked share) of the page's flat blocks in order, and its elements, parents first."""
    elements = [_Element("", -1, False)]
    found: list[tuple[str, int, int, float]] = []
    text: list[str] = []
    open_ = [0]  # places in ``elements``
    linked = silent = links = inline_p = 0

    def flush() -> None:
        nonlocal linked
        words = unescape("".join(text)).split()
        text.clear()
        if words:
            found.append((" ".join(words), open_[-1], len(words), min(1.0, linked / len(words))))
            elements[open_[-1]].words += len(words)
        linked = 0

    def close(at: int) -> None:
        nonlocal silent, links, inline_p
        for k in open_[at:]:
            tag = elements[k].tag
            silent -= tag in _SILENT
            links -= tag == "a"
            inline_p -= tag == "p"
        del open_[at:]

    def say(part: str) -> None:
        nonlocal linked
        if part and not silent:
            text.append(part)
            if links:
                linked += len(part.split())

    at = 0
    for m in _TOKEN.finditer(html):
        say(html[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group("raw"):
                say(" ")
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            say(" ")
        if m.group("end"):
            where = next((k for k in range(len(open_) - 1, 0, -1) if elements[open_[k]].tag == tag), None)
            if where is not None:
                close(where)
            continue
        if tag == "body":
            close(next((k for k in range(1, len(open_)) if elements[open_[k]].tag == "head"), len(open_)))
        ends = _CLOSES.get(tag, ())
        while len(open_) > 1:
            last = elements[open_[-1]].tag
            if last not in ends and not (tag in _BLOCK_ENDS_P and (last == "p" or last in _INLINE and inline_p)):
                break
            close(len(open_) - 1)
        attributes = m.group("attributes")
        if tag in _VOID or attributes.endswith("/"):
            continue
        elements.append(_Element(tag, open_[-1], tag not in ("html", "body", "main") and tag not in _HEADINGS and _cued(attributes)))
        open_.append(len(elements) - 1)
        silent += tag in _SILENT
        links += tag == "a"
        inline_p += tag == "p"
    say(html[at:])
    flush()
    return found, elements


def _mark_wrappers(elements: list[_Element]) -> None:
    """Marks the elements that hold the article whatever they are called: they and what encloses them judge nothing.

    The article is the wordiest of the article and main elements with a tenth of the page's words, those without a cue first. On a page without any it
    is in every element that holds more than half of the words, and a first heading if the page has one.
    """
    firsts = [e.tag == "h1" for e in elements]
    for k in range(len(elements) - 1, 0, -1):
        elements[elements[k].parent].words += elements[k].words
        firsts[elements[k].parent] |= firsts[k]
    articles = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and 10 * e.words > elements[0].words]
    if articles:
        k = max(articles, key=lambda k: (not elements[k].cued, elements[k].words, -k))
        while k >= 0:
            elements[k].spans = True
            k = elements[k].parent
    else:
        for e, first in zip(elements, firsts):
            e.spans = 2 * e.words > elements[0].words and (first or not firsts[0])


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """The page's flat text blocks in order: (text, features). White space inside a block is one space."""
    found, elements = _blocks_and_elements(html)
    _mark_wrappers(elements)
    flags = [(False, False, False, False)]  # in article, outside, cued, heading
    for e in elements[1:]:
        article, outside, cued, heading = flags[e.parent]
        judges = not e.spans
        article = article or e.tag in ("article", "main")
        outside = outside or (judges and e.tag in _OUTSIDE and not (e.tag == "header" and article))
        flags.append((article, outside, cued or (judges and e.cued), heading or e.tag in _HEADINGS))
    out = []
    for k, (words, element, *own) in enumerate(found):
        before, after = (found[k - 1][2:] if k else (0, 0.0)), (found[k + 1][2:] if k + 1 < len(found) else (0, 0.0))
        out.append((words, [float(x) for x in (*flags[element], *own, *before, *after)]))
    return out


# The labelled table is built from rules: kinds of blocks, (in_article, outside, cued, heading), least and most words,
# least and most linked share, label.
KINDS = {
    "paragraph": ((1, 0, 0, 0), 1, 200, 0.0, 0.4, 1), "linked paragraph": ((1, 0, 0, 0), 1, 60, 0.4, 1.0, 1), "title": ((1, 0, 0, 1), 1, 14, 0.0, 1.0, 1),
    "menu": ((0, 1, 0, 0), 1, 6, 0.5, 1.0, 0), "outside": ((0, 1, 0, 0), 1, 80, 0.0, 0.6, 0),
    "outside title": ((0, 1, 0, 1), 1, 8, 0.0, 1.0, 0), "cued": ((0, 0, 1, 0), 1, 120, 0.0, 1.0, 0), "cued title": ((0, 0, 1, 1), 1, 8, 0.0, 1.0, 0),
    "inner cued": ((1, 0, 1, 0), 1, 120, 0.0, 1.0, 0), "inner outside": ((1, 1, 0, 0), 1, 80, 0.0, 1.0, 0), "inner cued title": ((1, 0, 1, 1), 1, 8, 0.0, 1.0, 0),
    "outside cued": ((0, 1, 1, 0), 1, 80, 0.0, 1.0, 0),
    # Of elements that say nothing: words, links and neighbours decide.
    "prose": ((0, 0, 0, 0), 14, 200, 0.0, 0.3, 1), "line": ((0, 0, 0, 0), 1, 13, 0.0, 0.3, 1), "linked line": ((0, 0, 0, 0), 1, 10, 0.7, 1.0, 1),
    "bare title": ((0, 0, 0, 1), 1, 14, 0.0, 0.3, 1), "link": ((0, 0, 0, 0), 1, 10, 0.7, 1.0, 0), "credit": ((0, 0, 0, 0), 2, 13, 0.0, 0.4, 0),
    "list title": ((0, 0, 0, 1), 1, 5, 0.0, 0.3, 0),
}
# Pages as sequences of kinds; each is drawn several times.
LAYOUTS = tuple(tuple(x.split(", ")) for x in (
    "menu, menu, cued, title, paragraph, paragraph, linked paragraph, paragraph, outside",
    "inner outside, title, paragraph, inner cued, paragraph, paragraph, inner cued title, inner cued, outside cued",
    "cued title, cued, menu, outside title, bare title, prose, prose, cued, prose, outside",
    "outside, menu, paragraph, inner outside, paragraph, title, paragraph, outside title, outside",
    "menu, menu, title, linked paragraph, linked paragraph, linked paragraph, title, linked paragraph, linked paragraph, title, title, paragraph, menu",
    "title, title, linked paragraph, title, linked paragraph, title, paragraph, title, linked paragraph, linked paragraph, title",
    "linked paragraph, paragraph, linked paragraph, title, linked paragraph, inner cued, linked paragraph, title, menu, menu",
    "link, link, link, link, bare title, prose, prose, line, prose, linked line, prose, link, link, link, credit",
    "link, link, bare title, line, prose, prose, bare title, prose, list title, link, link, link, credit",
    "bare title, prose, line, line, line, prose, prose, link, link, link, link, link",
    "link, link, link, credit, link, link, bare title, prose, linked line, prose, bare title, line, line, prose, list title, link, link",
    "cued, bare title, prose, line, line, outside",
    "link, cued, cued, bare title, prose, cued, line, cued title, cued, prose, cued title, cued, cued, link, cued",
    "cued, cued, cued, prose, cued, prose, line, cued, cued title, cued, cued title, cued title, cued, cued",
    "prose, linked line, prose, linked line, prose",
    "line", "prose", "line, line", "prose, prose", "line, line, line",
))


def labelled_blocks(draws: int = 12, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of some 2,100 blocks of the LAYOUTS."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for layout in LAYOUTS * draws:
        page = []
        for kind in layout:
            flags, w0, w1, l0, l1, label = KINDS[kind]
            words = int(np.exp(rng.uniform(np.log(w0), np.log(w1 + 1))))
            page.append((*flags, words, round(rng.uniform(l0, l1) * words) / words, label))
        for k, (*own, label) in enumerate(page):
            before, after = (page[k - 1][4:6] if k else (0, 0.0)), (page[k + 1][4:6] if k + 1 < len(page) else (0, 0.0))
            x.append([*own, *before, *after])
            y.append(label)
    return np.array(x, float), np.array(y, float)


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4):
    """A binary decision tree: (feature, threshold, at most, above), or a leaf's share of positives."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) >= least:
                cost = _gini(y[left]) + _gini(y[~left])
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, float(t), left)
    if best is None or best[0] >= _gini(y) - 1e-9:
        return float(y.mean())
    _, f, t, left = best
    return f, t, train_tree(x[left], y[left], depth - 1, least), train_tree(x[~left], y[~left], depth - 1, least)


def belongs(tree, features: Sequence[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(html: str, tree) -> str:
    return "\n".join(text for text, features in blocks(html) if belongs(tree, features))


def _extracted(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = [main_text(h, tree) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text (blocks of the article, joined by \\n; empty if none) and n_chars of every row of ``pages``.

    Null html counts as empty; ids and urls pass through, null or repeated as they are; other columns are ignored. The
    whole page is read. An empty table gives no rows. ``labelled``: features (FEATURES) and labels to train on instead.
    """
    tree = train_tree(*(labelled or labelled_blocks()))
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return d.mapInArrow(lambda it: _extracted(it, tree), "page_id long, url string, text string, n_chars long")
