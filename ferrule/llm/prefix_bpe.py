"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pretoken's bytes exactly one token can be the last of that prefix's encoding.
The encoder stores it: of the tokens that end at a place (found by an Aho-Corasick automaton over
the vocabulary) it is the one that byte-pair merging would leave standing beside the last token of
the prefix before it.  Walking back from the end gives the encoding.  Because the table is by
prefix, appending bytes only extends it, cutting only shortens it, and after an edit the table is
recomputed only until it agrees with the old one for as long as the longest token.

Cases: null and empty texts encode to no ids and decode to no bytes; pretokens may be of any
length (time is linear in it); repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import give_back, ship, text_or_empty
from ferrule.llm.pieces import Recent, ranks_of, splitter


class Vocabulary:
    """Ranks, the automaton over token bytes, and how each token was last merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}  # answers so far, by left << 32 | right
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a single byte."""
        if token not in self._halves:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self._halves[token]

    def stand_side_by_side(self, left: int, right: int) -> bool:
        """``_border_stays``, remembered (bounded)."""
        if len(self.pairs) >= 250_000:
            self.pairs.clear()
        answer = self.pairs[left << 32 | right] = self._border_stays(left, right)
        return answer

    def _border_stays(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between these neighbouring tokens.

        Undo merges on both sides of the border from the latest back: at each step the pair that
        touches the border would have merged across it, had that merge come earlier than the
        one just undone."""
        before = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            # the later of the two merges is undone; at equal ranks the left one came first
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(ranks_of(path))


class Prefixes:
    """Last token of every prefix of a growing byte string: ``append``, ``cut``, ``edit``."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self._extend(start)

    def cut(self, length: int) -> None:
        self.data, self.last = self.data[:length], self.last[:length]

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; prefixes beyond the edit are taken over from the old table as
        soon as ``longest`` of them in a row come out as before."""
        old, shift = self.last, len(new) - (stop - start)
        tail = self.data[stop:]
        self.cut(start)
        self.data = self.data + new + tail
        self._extend(start, settled=start + len(new), old=old, shift=shift)

    def _extend(self, start: int, settled: int | None = None, old: list[int] = (), shift: int = 0) -> None:
        vocab, last = self.vocab, self.last
        known, beside = vocab.pairs, vocab.stand_side_by_side
        back = max(0, start - vocab.longest)
        at, same = start, 0  # the next prefix to settle ends at byte ``at``
        for end, (token, length) in vocab.automaton.iter(self.data[back:].decode("latin-1")):
            end += back
            if end != at:
                continue  # before the start, or settled by a longer token
            before = end - length
            if before >= 0:
                pair = last[before] << 32 | token
                if not (known[pair] if pair in known else beside(last[before], token)):
                    continue
            last.append(token)
            if settled is not None and at >= settled:
                same = same + 1 if token == old[at - shift] else 0
                if same >= vocab.longest:
                    last.extend(old[at - shift + 1:])
                    return
            at += 1
        if len(last) != len(self.data):
            raise ValueError("a byte that the vocabulary lacks")

    def ids(self) -> list[int]:
        out, at, bytes_of = [], len(self.data), self.vocab.bytes_of
        while at:
            out.append(self.last[at - 1])
            at -= len(bytes_of[out[-1]])
        return out[::-1]


class Codec:
    """encode(text) -> ids and decode(ids) -> bytes for one rank file and pretoken pattern."""

    def __init__(self, path: str, pattern: str):
        self.vocab = vocabulary(path)
        self.find = splitter(pattern)
        self.pieces = Recent(lambda piece: tuple(Prefixes(self.vocab, piece.encode("utf-8")).ids()))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [c.encode(t) for t in part["text"]]})
        give_back()

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(batches, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, whole (the decoded bytes
    are the text's)."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        sha = hashlib.sha256
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids = c.encode(text)
                decoded = c.decode(ids)
                rows.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()).hexdigest(),
                             sha(decoded).hexdigest(), decoded == text.encode("utf-8")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"])
        give_back()

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(
        batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean")
