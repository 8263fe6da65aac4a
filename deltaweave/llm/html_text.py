"""Main text of HTML pages by shallow features of text blocks.

A page becomes a flat list of text blocks. Each is described by its own and its
neighbours' word counts and link densities, and a decision tree, grown from a
small labelled table, says which blocks are content (after Kohlschütter,
Fankhauser and Nejdl, "Boilerplate Detection using Shallow Text Features",
2010).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, positional

FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after")
#: Blocks labelled by hand: the features, then 1 for content.
LABELLED = [
    # lists of links: navigation, breadcrumbs, related pages
    (0, 0, 1, 1, 1, 1, 0), (0, 0, 2, 1, 2, 1, 0), (0, 0, 7, 1, 9, 0, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 2, 1, 1, 1, 0), (2, 1, 3, 1, 2, 1, 0), (1, 1, 1, 1, 8, 0, 0), (1, 1, 1, 1, 40, 0, 0),
    (2, 1, 6, 0.9, 5, 1, 0), (30, 0, 6, 1, 7, 1, 0), (60, 0, 4, 1, 5, 1, 0), (5, 1, 9, 1, 0, 0, 0), (9, 0, 12, 0.8, 0, 0, 0), (80, 0.02, 18, 0.7, 20, 0.8, 0), (20, 0.7, 22, 0.6, 3, 1, 0), (0, 0, 25, 0.9, 60, 0, 0),
    (3, 0, 3, 1, 3, 1, 0), (50, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 0, 0, 0), (9, 0, 2, 1, 3, 0, 0), (12, 0, 5, 1, 60, 0, 0), (3, 1, 40, 0.75, 3, 1, 0),
    # short notices between links and the rest: advertisements, banners, captions of menus
    (1, 1, 4, 0, 6, 0, 0), (1, 1, 8, 0, 9, 0, 0), (2, 1, 12, 0, 7, 0, 0), (1, 1, 9, 0, 2, 0, 0), (3, 1, 3, 0, 1, 0, 0), (1, 1, 6, 0, 12, 0, 0), (1, 1, 2, 0, 1, 1, 0), (5, 1, 7, 0, 4, 1, 0), (1, 1, 12, 0, 14, 0, 0), (4, 1, 1, 0, 8, 0, 0),
    # the last lines of a page: rights, addresses
    (60, 0, 9, 0, 0, 0, 0), (4, 0, 10, 0, 0, 0, 0), (25, 0, 14, 0, 0, 0, 0), (2, 0, 6, 0, 0, 0, 0), (120, 0, 12, 0, 0, 0, 0), (9, 1, 8, 0, 0, 0, 0), (200, 0.05, 3, 0, 0, 0, 0), (10, 0, 18, 0, 0, 0, 0), (1, 0, 16, 0, 0, 0, 0), (30, 0, 20, 0.3, 0, 0, 0),
    # headings
    (9, 0, 6, 0, 60, 0, 1), (8, 0, 9, 0, 25, 0, 1), (1, 1, 7, 0, 70, 0, 1), (2, 1, 5, 0, 45, 0, 1), (12, 0, 10, 0, 3, 0, 1), (7, 0, 12, 0, 120, 0, 1), (60, 0, 3, 0, 80, 0, 1), (1, 1, 9, 0, 33, 0, 1), (5, 0, 8, 0, 1, 0, 1), (1, 1, 3, 0, 90, 0, 1), (0, 0, 5, 0, 60, 0, 1),
    # paragraphs
    (6, 0, 40, 0, 50, 0, 1), (50, 0, 80, 0.05, 30, 0, 1), (80, 0, 120, 0, 9, 0, 1), (30, 0, 25, 0, 25, 0, 1), (9, 0, 60, 0.1, 60, 0, 1), (60, 0, 200, 0.02, 0, 0, 1), (40, 0.1, 35, 0.2, 50, 0, 1), (1, 1, 90, 0, 70, 0, 1), (1, 1, 45, 0, 5, 0, 1),
    (0, 0, 60, 0, 0, 0, 1), (0, 0, 150, 0.01, 40, 0, 1), (70, 0, 55, 0, 10, 0, 1), (5, 0, 30, 0, 12, 0, 1), (200, 0, 35, 0, 0, 0, 1), (3, 0, 28, 0.1, 4, 0, 1), (60, 0, 300, 0, 4, 1, 1), (45, 0, 26, 0, 6, 1, 1),
    # short paragraphs among others
    (40, 0, 2, 0, 60, 0, 1), (60, 0, 1, 0, 30, 0, 1), (90, 0, 5, 0, 9, 0, 1), (8, 0, 3, 0, 40, 0, 1), (3, 0, 2, 0, 4, 0, 1), (35, 0, 9, 0, 2, 0, 1), (2, 0, 1, 0, 80, 0, 1), (100, 0, 12, 0.1, 100, 0, 1), (5, 0, 4, 0, 10, 0, 1), (20, 0, 14, 0, 11, 0, 1), (12, 0, 1, 0, 9, 0, 1), (1, 0, 8, 0, 12, 0, 1), (7, 0, 12, 0, 15, 0, 1), (10, 0, 6, 0, 1, 0, 1),
]

_TOKEN = re.compile(r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
#: What isn't shown: comments first, as they may hold tags; one that nothing closes ends with its tag. Only script, style and textarea reach to the end of the page if nothing closes them; a head ends at the first element that
#: can't stand in one, and of other unclosed elements only the tag goes. A self-closed svg is empty.
_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
_SKIP = re.compile(
    rf"(?is)(?P<comment><!--(?:-?>|.*?--!?>|[^>]*>?))|<svg\b{_ATTRIBUTES}/>"
    rf"|<(?P<raw>script|style|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<head\b[^>]*>(?:<!--.*?-->|<(?P<inner>script|style|noscript|template|title)\b[^>]*>.*?</(?P=inner)\s*>|<(?:meta|link|base|basefont|bgsound)\b[^>]*>|[^<]|<(?=[^A-Za-z/!]))*(?:</head\s*>)?"
    rf"|<(?P<pair>noscript|template|svg|select|iframe)\b[^>]*>.*?</(?P=pair)\s*>"
)
_PAIRED = re.compile(r"(?i)<(/?)(noscript|template|svg|select|iframe)\b")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())


class Tree:
    """A decision tree over numeric features, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((float(y.mean()),))
        if depth == 0 or y.min() == y.max():
            return at
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            n = np.arange(1, len(t))
            left, right = np.cumsum(t)[:-1], t.sum() - np.cumsum(t)[:-1]
            score = left * (1 - left / n) + right * (1 - right / (len(t) - n))
            score = np.where((v[1:] > v[:-1]) & (n >= least) & (len(t) - n >= least), score, np.inf)
            k = int(score.argmin())
            if np.isfinite(score[k]) and (best is None or score[k] < best[0] - 1e-12):
                best = (score[k], f, (v[k] + v[k + 1]) / 2)
        if best is None:
            return at
        _, f, cut = best
        m = x[:, f] <= cut
        a = self._grow(x[m], y[m], depth - 1, least)
        b = self._grow(x[~m], y[~m], depth - 1, least)
        self.nodes[at] = (f, cut, a, b)
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The share of content among the labelled blocks of each row's leaf."""
        out = np.zeros(len(x))
        work = [(0, np.arange(len(x)))]
        while work:
            at, rows = work.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            else:
                m = x[rows, node[0]] <= node[1]
                work += [(node[2], rows[m]), (node[3], rows[~m])]
        return out


@cache
def tree() -> Tree:
    t = np.array(LABELLED, dtype=float)
    return Tree(t[:, :-1], t[:, -1])


def _unpaired(page: str) -> str:
    """page with the openings that nothing closes as plain divisions, so that no search for their ends runs through all of it."""
    last = {m[2].lower(): m.start() for m in _PAIRED.finditer(page) if m[1]}
    return _PAIRED.sub(lambda m: m[0] if m[1] or m.start() < last.get(m[2].lower(), -1) else "<div", page)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each block, in order."""
    page = _SKIP.sub(lambda m: "" if m["comment"] else " <p> ", _unpaired(page)) if "<" in page else page
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    link, linked, at = False, 0, 0

    def flush() -> None:
        nonlocal linked
        s = " ".join(html.unescape("".join(text)).split())
        if s:
            n = s.count(" ") + 1
            out.append((s, n, min(n, linked)))
        text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            s = page[at : m.start()]
            text.append(s)
            if link:
                linked += len(s.split())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            link = not m[1]
        elif name not in _INLINE:
            flush()
    if at < len(page):
        text.append(page[at:])
        if link:
            linked += len(page[at:].split())
    flush()
    return out


def features(counts: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Features of all blocks, from (words, linked) and each block's page; a block without a neighbour has zeros for it."""
    w, d = counts[:, 0].astype(float), counts[:, 1] / np.maximum(counts[:, 0], 1)
    x = np.zeros((len(w), 6))
    x[:, 2], x[:, 3] = w, d
    same = pages[1:] == pages[:-1]
    x[1:, 0], x[1:, 1] = np.where(same, w[:-1], 0), np.where(same, d[:-1], 0)
    x[:-1, 4], x[:-1, 5] = np.where(same, w[1:], 0), np.where(same, d[1:], 0)
    return x


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tree()
    for batch in batches:
        for i in range(0, len(batch), 512):
            b = batch.slice(i, 512)
            got = [blocks(x) if x else [] for x in b.column(2).to_pylist()]
            n = np.array([len(g) for g in got], dtype=np.int64)
            counts = np.array([x[1:] for g in got for x in g], dtype=np.int64).reshape(-1, 2)
            good = t(features(counts, np.repeat(np.arange(len(got)), n))) > 0.5 if len(counts) else np.zeros(0, bool)
            bounds = np.concatenate(([0], np.cumsum(n)))
            null = b.column(2).is_null().to_pylist()
            text = [None if z else "\n".join(x[0] for x, k in zip(g, good[bounds[j] : bounds[j + 1]].tolist(), strict=True) if k) for j, (g, z) in enumerate(zip(got, null, strict=True))]
            kept = [int(good[bounds[j] : bounds[j + 1]].sum()) for j in range(len(got))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(n.astype(np.int32)), pa.array(kept, pa.int32())], names=["page_id", "url", "text", "n_blocks", "n_content"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks, n_content int) for each row of pages: its content blocks, one a line.

    A null page gives a null text and no blocks, an empty one an empty text;
    text without tags is one block, a very long page is handled whole. Ids and addresses are passed on as they are,
    null or repeated. An empty table gives an empty one.
    """
    pos, names = positional(pages)
    src = pos.select(F.col(column(names, "page_id")).cast("bigint").alias("page_id"), F.col(column(names, "url")).cast("string").alias("url"), F.col(column(names, "html")).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id bigint, url string, text string, n_blocks int, n_content int")
