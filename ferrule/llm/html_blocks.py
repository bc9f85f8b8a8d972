"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level elements; inline markup vanishes, character
references are decoded, white space becomes one space.  A block has its word count and link
density, those of the block before and after it, and what the elements around it say (article or
main; menus, headers, footers, sidebars, notices, adverts, forms, comments).  A decision tree grown
by Gini impurity on the small labelled table of ``html_labels`` decides block by block; the blocks
it accepts are joined in page order.

Pages are independent: one pass, no shuffle; the tree has a few dozen nodes.

Cases: null and empty html give an empty text; unclosed elements, comments, scripts and references
end where a browser would end them or at the end of the page; pages without markup are one block;
repeated rows give a row each; an empty table gives no rows; pages may be of any length.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import ship
from ferrule.llm.html_labels import BLOCKS

# Element names by the role HTML gives them.
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
 figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p
 pre section summary table tbody td tfoot th thead tr ul caption title""".split())
UNSEEN = "script style noscript template svg math iframe object select textarea button title head".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
CORE = {"article", "main"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILER_WORDS = set("""ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb
 breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright
 disqus discussion dropdown footer foot form gdpr head header hidden legal login masthead menu meta modal nav
 navbar navigation newsletter notice notification notifications pager pagination popup promo promoted
 promotion recommended related reply replies respond responses search share sharing sidebar side signup
 skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets""".split())
CORE_WORDS = set("article articlebody content entry main maincontent post story text".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in UNSEEN}


def _hint(name: str, marks: str) -> int:
    """-1 boilerplate, +1 article, 0 silent: the element's name, then its class, id and role."""
    if name in ("html", "body"):
        return 0
    words = set(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", marks).lower()))
    if name in BOILER or words & BOILER_WORDS:
        return -1
    return 1 if name in CORE or words & CORE_WORDS else 0


class Block:
    __slots__ = ("parts", "linked", "near", "inside", "head")

    def __init__(self, path: list[tuple[str, int]]):
        self.parts: list[str] = []
        self.linked: list[str] = []
        hints = [h for _, h in path if h]
        self.near = hints[-1] if hints else 0  # what the innermost hint says
        # boilerplate outside any article counts for all that is in it
        outer = hints[0] if hints else 0
        self.inside = -1 if outer < 0 or self.near < 0 else outer
        self.head = int(any(n in HEADS for n, _ in path))
        if any(n == "header" for n, _ in path) and self.head and any(n in CORE for n, _ in path) and \
                [n for n, h in path if h < 0] == ["header"]:
            self.near = self.inside = 1  # a heading in the article's own header


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, near, inside, heading) of each flat block in page order."""
    path: list[tuple[str, int]] = []
    found: list[Block] = []
    now, links, at, n = Block(path), 0, 0, len(page)

    def text(piece: str) -> None:
        if piece:
            now.parts.append(piece)
            if links:
                now.linked.append(piece)

    def fresh() -> Block:
        if now.parts:
            found.append(now)
        return Block(path)

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in END_OF:
            if not closing and not m[3].endswith("/") and name != "head":
                end = END_OF[name].search(page, at)
                at = end.end() if end else n
                text(" ")
            elif name == "head":
                now = fresh()
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            text(" ")
        elif name in BLOCK or any(name == x for x, _ in path):
            if closing:
                for i in range(len(path) - 1, -1, -1):
                    if path[i][0] == name:
                        del path[i:]
                        break
            elif name not in VOID:
                if (name in HEADS or name in ("p", "li")) and path and path[-1][0] == name:
                    path.pop()  # not closed before
                if path and path[-1][0] == "p":
                    path.pop()  # a block ends a paragraph
                marks, hidden = [], False
                for key, *value in ATTR.findall(m[3]):
                    key, value = key.lower(), "".join(value)
                    if key in ("class", "id", "role"):
                        marks.append(value)
                    hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or \
                        key == "style" and "display:none" in value.replace(" ", "").lower()
                path.append((name, -1 if hidden else _hint(name, " ".join(marks))))
            if closing or name not in VOID or name == "hr":
                links = 0 if name in BLOCK and links and not closing else links
                now = fresh()
    if now.parts:
        found.append(now)
    out = []
    for b in found:
        words = htmllib.unescape("".join(b.parts)).split()
        if words:
            linked = len(htmllib.unescape(" ".join(b.linked)).split()) if b.linked else 0
            out.append((" ".join(words), len(words), min(linked, len(words)), b.near, b.inside, b.head))
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after",
            "near", "inside", "heading")


def features(rows: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Rows of (words, linked, near, inside, heading) -> FEATURES, with the neighbours' columns."""
    x = np.array(rows, float).reshape(-1, 5)
    own = np.column_stack([x[:, 0], x[:, 1] / np.maximum(x[:, 0], 1)])
    none = np.zeros((1, 2))
    return np.column_stack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:], x[:, 2:]])


class Tree:
    """Binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.answer = int(y.mean() >= 0.5)
        self.feature = None
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        gini = lambda k, n: 2 * k * (n - k) / n  # noqa: E731  impurity times rows
        best = gini(y.sum(), len(y)) - 1e-9
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
                if least <= i <= len(y) - least:
                    cost = gini(ones[i - 1], i) + gini(ones[-1] - ones[i - 1], len(y) - i)
                    if cost < best:
                        best, self.feature, self.cut = cost, f, (v[i - 1] + v[i]) / 2
        if self.feature is not None:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.answer)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), int)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table, page by page (neighbours stay within a page)."""
    pages: dict[str, list] = {}
    for line in BLOCKS.strip().splitlines():
        page, path, words, linked, keep = line.split()
        steps = []
        for step in path.split(">"):
            name, *marks = re.split(r"[.#]", step)
            steps.append((name, _hint(name, " ".join(marks))))
        b = Block(steps)
        pages.setdefault(page, []).append(((int(words), int(linked), b.near, b.inside, b.head), int(keep)))
    x = np.vstack([features([r for r, _ in rows]) for rows in pages.values()])
    return x, np.array([k for rows in pages.values() for _, k in rows])


@lru_cache(maxsize=1)
def classifier() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = tree.predict(features([b[1:] for b in found]))
    return " ".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = classifier()
        for part in parts:
            text = [main_text(h, tree) for h in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(batches, "page_id long, url string, text string, n_chars long")
