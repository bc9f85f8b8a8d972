"""Token counts by byte-pair merging on a heap and a linked list.

The symbols of a pretoken form a doubly linked list; a heap holds its adjacent pairs by merge rank
and place.  The lowest pair is popped again and again; a pair whose ends have changed since it was
pushed is skipped.  Each merge takes one symbol away, so the count is the number of initial
symbols minus the merges: n log n in the length of the pretoken, and no identifiers are made.

Cases: null and empty texts have 0 tokens; a text may be one unbroken pretoken of any length; a
special token's string inside a text is one token, as the library takes it; repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import ship, text_or_empty
from ferrule.llm.pieces import Chunks, Memo, splitter


def _printable() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points
    from 256 on (fixed by the file format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge rules on integer symbols: bytes are 0..255, the product of merge r is 256 + r."""

    def __init__(self, pairs: list[tuple[str, str]], alphabet: list[str]):
        number = {a: i for i, a in enumerate(alphabet)}
        self.left, self.right, self.rank = [], [], {}
        for r, (a, b) in enumerate(pairs):
            x, y = number[a], number[b]
            number.setdefault(a + b, 256 + r)
            self.left.append(x)
            self.right.append(y)
            self.rank.setdefault(x << 32 | y, r)
        self.made = [number[a + b] for a, b in pairs]

    def count(self, data: bytes) -> int:
        """Symbols left of a pretoken after all merges."""
        n = len(data)
        if n < 2:
            return n
        rank, left, right, made = self.rank, self.left, self.right, self.made
        sym = list(data)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank[p] << 40 | i for i, p in enumerate([a << 32 | b for a, b in zip(sym, sym[1:])]) if p in rank]
        heapify(heap)
        merged = 0
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFFFF, top >> 40
            j = nxt[i]
            if sym[i] != left[r] or j >= n or sym[j] != right[r]:
                continue  # an end has changed since the pair was pushed
            new = sym[i] = made[r]
            sym[j] = -1
            merged += 1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                p = new << 32 | sym[k]
                if p in rank:
                    heappush(heap, rank[p] << 40 | i)
            h = prv[i]
            if h >= 0:
                p = sym[h] << 32 | new
                if p in rank:
                    heappush(heap, rank[p] << 40 | h)
        return n - merged


class Counter:
    """Tokens of a text under a byte-level BPE file in the JSON format."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        merges = Merges(pairs, _printable())
        find = splitter(pattern)
        piece = Memo(lambda piece: merges.count(piece.encode("utf-8")), 1_000_000)
        chunks = Chunks(lambda text: sum(map(piece.__getitem__, find(text))))
        specials = [t["content"] for t in spec["added_tokens"] if t["special"]]

        def plain(text: str) -> int:
            return sum(chunks(text))

        def whole(text: str, rest: list[str] = specials) -> int:
            if not rest:
                return plain(text)
            parts = text.split(rest[0])
            return len(parts) - 1 + sum(whole(p, rest[1:]) for p in parts if p)

        self.count = whole


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path, pattern).count
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": part["n_bytes"],
                                "n_tokens": [count(t) for t in part["text"]]})

    ship(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(batches, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
