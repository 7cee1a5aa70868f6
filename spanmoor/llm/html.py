"""Main text of HTML pages.

A page becomes a flat list of text blocks. Each block has its word count and
link density, those of its neighbours, and what its open elements say: whether
one of them is furniture (a menu, a footer, comments ...), whether one only has a
name that furniture often has, and whether it lies in the article. A decision
tree trained on a small labelled table tells from all of these which to keep.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Comments, other declarations and tags. A quote counts only after an equals
#: sign, and only if it is closed; what the page's end cuts off ends there.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style head title noscript template svg iframe object select button textarea canvas audio video math".split())
#: Elements that flow inside a block and leave it whole.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp nobr".split())
#: Elements that stay open until they are closed by name.
NESTED = frozenset("html body nav header footer aside form article main section div ul ol dl table blockquote figure details menu dialog".split())
AGAINST = frozenset("nav footer aside form menu dialog".split())
FOR = frozenset("article main".split())
#: Parts of names (of a class, id or role) that furniture has, parts that it and
#: the article's own sections have, and parts that make a header the article's.
FURNITURE = re.compile(
    r"nav|nav(?:bar|igation)|menus?|footer|header|masthead|sidebar|aside|ads?|adv|advert\w*|adslot|adbox|banners?|sponsor\w*|promos?|promoted|promotions?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|signup|login|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|widgets?|toolbar|skip|complementary|contentinfo",
)
DOUBTFUL = frozenset("side search legal copyright disclaimer tag tags".split())
OWN = frozenset("article entry post story page content main".split())
_PARTS = re.compile(r"[a-z]+")
#: The labelled table: words, link density, words and link density of the block
#: before and after, 1 under furniture, 1 under a doubtful name, 1 in the article,
#: and the label.
TABLE = np.array(
    """
    1 1.0 1 1.0 1 1.0 1 0 0 0
    2 1.0 0 0.0 1 1.0 1 0 0 0
    1 1.0 1 1.0 8 0.0 1 0 0 0
    6 0.0 1 1.0 9 0.0 1 0 0 0
    9 0.0 40 0.0 0 0.0 1 0 0 0
    14 0.0 90 0.0 0 0.0 1 0 0 0
    60 0.0 8 0.0 10 0.0 1 0 0 0
    35 0.1 12 0.0 25 0.0 1 0 1 0
    20 0.0 80 0.0 18 0.0 1 0 1 0
    3 1.0 20 0.0 3 1.0 1 0 1 0
    120 0.0 5 0.0 4 0.0 1 0 0 0
    5 0.4 30 0.0 4 0.5 1 0 0 0
    8 0.0 6 0.0 30 0.0 0 0 1 1
    1 0.0 60 0.0 45 0.0 0 0 1 1
    2 0.0 3 0.0 2 0.0 0 0 1 1
    1 0.0 1 0.0 0 0.0 0 0 1 1
    40 0.0 8 0.0 90 0.0 0 0 1 1
    90 0.05 40 0.0 70 0.0 0 0 1 1
    30 0.5 60 0.0 50 0.0 0 0 1 1
    4 1.0 60 0.0 50 0.0 0 0 1 1
    12 0.0 1 1.0 9 0.0 0 0 1 1
    15 0.0 90 0.0 6 0.5 0 0 1 1
    250 0.0 7 0.0 12 0.0 0 0 1 1
    3 1.0 2 1.0 4 1.0 0 0 1 1
    1 1.0 40 0.0 1 1.0 0 0 1 1
    2 1.0 3 1.0 60 0.0 0 0 1 1
    12 0.9 8 0.8 9 1.0 0 0 1 1
    30 0.8 6 1.0 50 0.0 0 0 1 1
    45 0.7 30 0.0 25 0.6 0 0 1 1
    5 0.0 2 1.0 3 1.0 0 0 1 1
    4 0.0 5 1.0 2 0.5 0 0 1 1
    7 0.0 60 0.0 2 1.0 0 0 1 1
    3 0.5 12 1.0 5 0.7 0 0 1 1
    40 0.0 2 1.0 35 0.0 0 0 0 1
    90 0.0 12 0.0 80 0.1 0 0 0 1
    25 0.1 60 0.0 40 0.0 0 0 0 1
    18 0.0 45 0.0 70 0.0 0 0 0 1
    30 0.2 80 0.0 2 1.0 0 0 0 1
    12 0.0 55 0.0 64 0.0 0 0 0 1
    9 0.0 70 0.0 38 0.0 0 0 0 1
    6 0.0 4 1.0 75 0.0 0 0 0 1
    150 0.0 0 0.0 0 0.0 0 0 0 1
    3 1.0 2 1.0 4 1.0 0 0 0 0
    1 1.0 40 0.0 1 1.0 0 0 0 0
    2 1.0 3 1.0 60 0.0 0 0 0 0
    12 0.9 8 0.8 9 1.0 0 0 0 0
    30 0.8 6 1.0 50 0.0 0 0 0 0
    45 0.7 30 0.0 25 0.6 0 0 0 0
    5 0.0 2 1.0 3 1.0 0 0 0 0
    4 0.0 5 1.0 2 0.5 0 0 0 0
    7 0.0 60 0.0 2 1.0 0 0 0 0
    3 0.5 12 1.0 5 0.7 0 0 0 0
    20 0.0 30 0.0 25 0.0 0 1 1 1
    8 0.0 40 0.0 35 0.0 0 1 1 1
    60 0.0 12 0.0 4 0.0 0 1 1 1
    14 0.1 90 0.0 50 0.0 0 1 1 1
    7 0.0 0 0.0 80 0.0 0 1 1 1
    110 0.05 30 0.0 0 0.0 0 1 1 1
    1 0.0 40 0.0 2 0.0 0 1 1 0
    2 0.0 60 0.0 0 0.0 0 1 1 0
    2 0.5 80 0.0 3 1.0 0 1 1 0
    3 1.0 2 1.0 4 1.0 0 1 1 0
    1 1.0 40 0.0 1 1.0 0 1 1 0
    9 0.9 50 0.0 2 1.0 0 1 1 0
    25 0.8 6 1.0 50 0.0 0 1 1 0
    4 0.0 20 1.0 3 1.0 0 1 1 0
    9 0.0 2 1.0 60 0.0 0 1 0 0
    30 0.0 90 0.0 12 0.0 0 1 0 0
    45 0.1 80 0.0 0 0.0 0 1 0 0
    70 0.0 30 0.0 25 0.0 0 1 0 0
    3 1.0 2 1.0 4 1.0 0 1 0 0
    """.split(),
    float,
).reshape(-1, 10)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int):
    """A binary tree of (feature, bound, below, above) and leaves 0 or 1, by
    Gini impurity; ties go to the first feature."""
    share = labels.mean()
    best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for bound in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] < bound
                p, q, w = labels[left].mean(), labels[~left].mean(), left.mean()
                cost = w * 2 * p * (1 - p) + (1 - w) * 2 * q * (1 - q)
                if cost < best[0]:
                    best = (cost, f, bound)
    if best[1] < 0:
        return int(share >= 0.5)
    left = rows[:, best[1]] < best[2]
    return best[1], best[2], grow(rows[left], labels[left], depth - 1), grow(rows[~left], labels[~left], depth - 1)


@lru_cache(1)
def tree():
    return grow(TABLE[:, :-1], TABLE[:, -1], 8)


def judge(node, row) -> bool:
    while not isinstance(node, int):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return bool(node)


@lru_cache(4096)
def hints(attributes: str) -> tuple[int, int]:
    """Whether the names among a tag's attributes are of furniture, and whether
    they are doubtful. The parts of a name count, as in ``nav-top``."""
    against = doubtful = 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() not in ("class", "id", "role"):
            continue
        for name in "".join(values).lower().split():
            parts = set(_PARTS.findall(name))
            found = {p for p in parts if FURNITURE.fullmatch(p)}
            if found and not (found == {"header"} and parts & OWN):
                against = 1
            elif parts & DOUBTFUL:
                doubtful = 1
    return against, doubtful


def blocks(html: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, furniture, doubtful, article) of the page's
    blocks in order."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, int, int, int]] = []  # name, furniture, doubtful, article: all that is open
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, text.count(" ") + 1, linked, *(stack[-1][1:] if stack else (0, 0, 0))))
            parts.clear()
        linked = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        rest, after, tag = (html[at:], n, None) if m is None else (html[at : m.start()], m.end(), m[2])
        if rest:
            parts.append(rest)
            if links:
                linked += len(unescape(rest).split())
        at = after
        if tag is None:
            continue
        name, closing = tag.lower(), m[1] == "/"
        if name in SILENT:
            if not closing and not m[3].endswith("/"):
                if name not in ("head", "title"):
                    end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                    at = end.end() if end else n
                else:
                    end = re.compile(rf"</{name}\s*>" + ("|(?=<body)" if name == "head" else ""), re.I).search(html, at)
                    at = end.end() if end else n
            if name not in ("script", "style"):
                flush()
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE:
            continue
        flush()
        if name not in NESTED and name != "p":
            links = 0 if name != "br" else links
            continue
        links = 0
        if name == "p" or m[3].endswith("/"):
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        _, against, doubtful, inside = stack[-1] if stack else ("", 0, 0, 0)
        furniture, doubt = (0, 0) if name in ("html", "body") else hints(m[3])
        if furniture or name in AGAINST or (name == "header" and not inside):
            against = 1
        elif name in FOR:  # its name tells what the article is about
            inside = 1
        else:
            doubtful |= doubt
        stack.append((name, against, doubtful, inside))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The blocks that the tree keeps, joined by spaces; null and empty pages
    have none. Where a page has an element for its article, blocks outside it
    are judged as beside it."""
    found = blocks(html or "")
    some = any(inside and not against for *_, against, _, inside in found)
    row = [(0, 0.0), *[(b[1], b[2] / b[1]) for b in found], (0, 0.0)]
    kept = []
    for i, (text, _, _, against, doubtful, inside) in enumerate(found):
        beside = int(against or (some and not inside))
        if judge(tree(), (*row[i + 1], *row[i], *row[i + 2], beside, doubtful, inside)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; a null page has
    an empty text. Repeated rows have a row each; other columns of ``pages``,
    whatever their names, are not read. A page of any length is read whole, in
    linear time."""
    schema = pages.select("page_id", "url").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{schema}, text string, n_chars long")
