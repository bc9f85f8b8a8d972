"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages; passages and benchmark items are TF-IDF vectors over
the benchmark's terms.  Document frequencies are counted over all documents, but words inside a run of
``RUN`` adjacent words of an item do not count: copies of an item make its own terms no more common.  A
randomised SVD of the passage matrix, computed in Spark as products with a thin matrix and its
orthonormal basis, gives a latent space; the passages whose cosine with an item reaches ``cosine``
there, or which hold ``WITHIN`` of the item there whatever else they hold, are candidates.  The longest
common subsequence with the item is taken over the passage and ``AROUND`` times the item's words on either
side.  A candidate is a leak if it covers ``verbatim`` of the item's words and the answer is there too
(``answer`` of the telling words of the item's last sentence), however many other words stand between.
Inside the closest stretch of one and a half times the item's length, ``verbatim`` is enough without the
answer, and ``paraphrase`` with it: so long a stretch of other texts does not hold the words by chance.

The latent space is fitted on the items and every passage of every document, as are document
frequencies, the search and the checks: one pass adds up the products of the passages' terms, and
the thin matrix is multiplied by those sums, tile by tile.  The items are a stated query set, taken in blocks of ``block``, each with its own latent
space, so what a task holds is bounded by the benchmark and a block's work by its size.

Cases: null and empty texts and items match nothing; items longer than ``PIECE`` words are searched
for by overlapping pieces; items of fewer than ``SHORTEST`` words leak only where all their words stand next to
each other in order (cosine, common and answer are 1); repeated rows are judged each; empty tables give no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import discard, give_back, ship, stored, text_or_empty
from ferrule.llm.words import BLANKS, PUNCTUATION, Words, buffers, mix

WINDOW, STRIDE = 64, 32   # words of a passage, and from one passage to the next
PIECE, STEP = 48, 24      # words of an item's piece, and from one to the next
SHORTEST = 6
COMMON = 0.05             # terms in more documents than this share carry no weight in the search
RUN = 3                   # adjacent words by which a word is taken as part of an item's copy
WITHIN = 0.45             # share of an item in a passage: ``paraphrase`` of it, a quarter of that in the next passage
AROUND = 2                # the check reads so many times the item's words on either side of a passage
TILE = 512                # terms a side of a tile of the terms' products
HELD = 1 << 20            # products a task holds unmerged
SENTENCES = re.compile(rb"[.!?\n]+")


class Item:
    """A piece of a benchmark item: its word hashes, and those of its answer."""

    __slots__ = ("item_id", "words", "answer", "at")

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray):
        self.item_id, self.words, self.answer = item_id, words, answer
        self.at: dict[int, int] = {}  # bit mask of each word's places
        for i, w in enumerate(words.tolist()):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence, by bit rows."""
        n = len(self.words)
        full = (1 << n) - 1
        row = full
        for m in map(self.at.get, words):
            if m is not None:
                u = row & m
                row = (row + u | row - u) & full
        return n - row.bit_count()


def _hashes(text: bytes) -> np.ndarray:
    return Words([text], BLANKS + PUNCTUATION).hashes()


def items_of(benchmark: DataFrame) -> tuple[list[Item], list[Item]]:
    """Pieces of all items that are long enough, and the shorter items that have words."""
    out, short = [], []
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text)):
        text = r.text.encode("utf-8")
        words = _hashes(text)
        if len(words) < SHORTEST:
            if len(words):
                short.append(Item(r.item_id, words, words))
            continue
        last = [s for s in SENTENCES.split(text) if s.strip()][-1:]
        answer = _hashes(last[0]) if last else words
        starts = [0] if len(words) <= PIECE else [*range(0, len(words) - PIECE, STEP), len(words) - PIECE]
        out += [Item(r.item_id, words[s:s + PIECE] if len(words) > PIECE + STEP // 2 else words, answer)
                for s in (starts if len(words) > PIECE + STEP // 2 else [0])]
    return out, short


def _adjacent(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by its first."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n])
    return out


class Terms:
    """The benchmark's terms (or other hashes): sorted, and a sieve that most other words fall through."""

    def __init__(self, items: list[Item], bits: int = 20, run: int = 1):
        self.hashes = np.unique(np.concatenate([i.words if run == 1 else _adjacent(i.words, run) for i in items]))
        self.bits = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self.hashes >> self.bits] = True

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for other words."""
        out = np.full(len(words), -1, np.int32)
        maybe = np.flatnonzero(self.sieve[words >> self.bits])
        at = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
        ok = self.hashes[at] == words[maybe]
        out[maybe[ok]] = at[ok]
        return out


def frequencies(docs: DataFrame, terms: Terms, runs: Terms) -> tuple[np.ndarray, int]:
    """Documents that have each term outside the items' ``runs``, and all documents (counted over all rows)."""
    sent = docs.sparkSession.sparkContext.broadcast((terms, runs))  # bounded by the benchmark

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, r = sent.value
        n = np.zeros(len(t.hashes) + 1, np.int64)
        for part in parts:
            texts = [x.encode("utf-8") for x in part["text"]]
            n[-1] += len(texts)
            for _, run in buffers(texts):
                w = Words(run, BLANKS + PUNCTUATION)
                hashes = w.hashes()
                term = t.find(hashes)
                doc = np.repeat(np.arange(len(run), dtype=np.int64), w.first[1:] - w.first[:-1])
                copied = np.flatnonzero(r.find(_adjacent(hashes, RUN)) >= 0)
                copied = copied[doc[copied] == doc[copied + RUN - 1]]
                for j in range(RUN):
                    term[copied + j] = -1
                both = np.unique(doc[term >= 0] * (1 << 32) + term[term >= 0])
                n[:-1] += np.bincount(both & 0xFFFFFFFF, minlength=len(n) - 1)
        give_back()
        yield pd.DataFrame({"term": np.flatnonzero(n), "n": n[n > 0]})

    rows = docs.select(text_or_empty().alias("text")).mapInPandas(count, "term int, n long")
    out = np.zeros(len(terms.hashes) + 1, np.int64)
    for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def passages(term: np.ndarray, first: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (passage, term) of the weighted words of all passages, and the first word of each
    passage.  A passage is two neighbouring half-windows; the last one of a text may be one."""
    doc = np.repeat(np.arange(len(first) - 1), first[1:] - first[:-1])
    halves = np.maximum(-(-(first[1:] - first[:-1]) // STRIDE), 1)  # of each text
    base = np.cumsum(halves) - halves
    hit = np.flatnonzero((term >= 0) & (weight[term] > 0))
    half = base[doc[hit]] + (hit - first[doc[hit]]) // STRIDE
    total = int(halves.sum())
    begin = np.repeat(first[:-1], halves) + (np.arange(total) - np.repeat(base, halves)) * STRIDE
    before = half - 1  # the passage that began one half earlier, if of the same text
    same = (half > base[doc[hit]])
    return (np.concatenate([half, before[same]]), np.concatenate([term[hit], term[hit[same]]]), begin)


def vectors(passage: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) with (1 + log tf) * idf, ordered by passage."""
    key, tf = np.unique(passage.astype(np.int64) * (1 << 32) + term, return_counts=True)
    term = key & 0xFFFFFFFF
    return key >> 32, term, ((1 + np.log(tf)) * weight[term]).astype(np.float32)


def _times(passage: np.ndarray, term: np.ndarray, value: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (sparse passages x terms) @ thin, and which passages they are."""
    if not len(passage):
        return np.zeros(0, np.int64), np.zeros((0, thin.shape[1]), np.float32)
    cut = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    return passage[cut], np.add.reduceat(thin[term] * value[:, None], cut, axis=0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _item_entries(items: list[Item], terms: Terms, weight: np.ndarray):
    found = [terms.find(i.words) for i in items]
    at = np.repeat(np.arange(len(items)), [len(f) for f in found])
    term = np.concatenate(found)
    ok = (term >= 0) & (weight[term] > 0)
    return vectors(at[ok], term[ok], weight)


def _products(passage: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of every two terms (the smaller first) of a passage, numbered tile by tile."""
    at = np.arange(len(passage))
    many = np.searchsorted(passage, passage, "right") - at
    left = np.repeat(at, many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + left
    (a, x), (b, y) = np.divmod(term[left], TILE), np.divmod(term[right], TILE)
    return ((a << 24 | b) * TILE + x) * TILE + y, value[left] * value[right]


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sum a number, in order."""
    key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([v for _, v in held]), len(key))


def _tiles(key: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """A row a tile: its number, the places in it and their values."""
    tile, cut = np.unique(key // TILE ** 2, return_index=True)
    at, value = (key % TILE ** 2).astype(np.int32), value.astype(np.float32)
    return pd.DataFrame({"tile": tile, "at": [x.tobytes() for x in np.split(at, cut[1:])] if len(tile) else [],
                         "value": [x.tobytes() for x in np.split(value, cut[1:])] if len(tile) else []})


def term_products(docs: DataFrame, terms: Terms, weight: np.ndarray) -> DataFrame:
    """A'A of all passages of ``docs`` as unit vectors, stored: the tiles (numbered ``a << 24 | b``) on
    and above the diagonal that are not empty, as places and values."""
    sent = docs.sparkSession.sparkContext.broadcast((terms, weight))  # bounded by the benchmark
    schema = "tile long, at binary, value binary"

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, w = sent.value
        held, size = [], 0
        for part in parts:
            for _, run in buffers([x.encode("utf-8") for x in part["text"]]):
                words = Words(run, BLANKS + PUNCTUATION)
                passage, term, value = vectors(*passages(t.find(words.hashes()), words.first, w)[:2], w)
                value = value / np.sqrt(np.bincount(passage, value.astype(np.float64) ** 2))[passage]
                for s in range(0, len(passage), 1 << 15):  # a bounded number of entries at a time
                    lo, hi = Finder._whole(passage, s), Finder._whole(passage, s + (1 << 15))
                    held.append(_products(passage[lo:hi], term[lo:hi], value[lo:hi]))
                    size += len(held[-1][0])
                    if size >= HELD:
                        held = [_added(held)]
                        size = len(held[0][0])
                        if size >= HELD // 2:
                            yield _tiles(*held[0])
                            held, size = [], 0
        if held:
            yield _tiles(*_added(held))
        give_back()

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for tile, at, value in zip(part["tile"], part["at"], part["value"]):
                if tile not in sums:
                    sums[tile] = np.zeros(TILE ** 2)
                sums[tile][np.frombuffer(at, np.int32)] += np.frombuffer(value, np.float32)
        for tile, every in sums.items():
            at = np.flatnonzero(every)
            yield _tiles(at + tile * TILE ** 2, every[at])
        give_back()

    side = -(-len(terms.hashes) // TILE)
    parts = docs.select(text_or_empty().alias("text")).mapInPandas(multiply, schema)
    parts = parts.repartition(min(256, side * (side + 1) // 2), "tile")
    return stored(parts.mapInPandas(total, schema), "latent-products")


def svd_basis(products: DataFrame, terms: Terms, weight: np.ndarray, items: list[Item], rank: int,
              spare: int = 16, rounds: int = 2, tasks: int = 8) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages whose ``term_products`` are given and the items.

    Each round multiplies A'A with a thin matrix, tiles being spread over ``tasks`` tasks that
    send back one thin matrix each, and orthonormalises the product."""
    n, width = len(terms.hashes), rank + spare
    spark = products.sparkSession
    rng = np.random.default_rng(0)
    thin = rng.standard_normal((n, width)).astype(np.float32)
    rows = products.coalesce(tasks)

    def product(thin: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(thin)

        def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = sent.value
            out = np.zeros(x.shape, np.float32)
            for part in parts:
                for tile, at, value in zip(part["tile"], part["at"], part["value"]):
                    full = np.zeros(TILE ** 2, np.float32)
                    full[np.frombuffer(at, np.int32)] = np.frombuffer(value, np.float32)
                    full = full.reshape(TILE, TILE)
                    a, b = (slice(k * TILE, min((k + 1) * TILE, len(x))) for k in (tile >> 24, tile & 0xFFFFFF))
                    full = full[:a.stop - a.start, :b.stop - b.start]
                    if a == b:
                        full = full + np.triu(full, 1).T
                    else:
                        out[b] += full.T @ x[a]
                    out[a] += full @ x[b]
            give_back()
            yield pd.DataFrame({"m": [out.tobytes()]})

        out = np.zeros(thin.shape, np.float32)
        for r in rows.mapInPandas(multiply, "m binary").toLocalIterator():
            out += np.frombuffer(r.m, np.float32).reshape(out.shape)
        # the items are rows as well; they are what the space is for, so they weigh as much as the rest
        own = np.zeros(thin.shape, np.float32)
        _accumulate(own, *_item_entries(items, terms, weight), thin)
        return out + own * max(1.0, np.linalg.norm(out) / max(np.linalg.norm(own), 1e-9))

    for _ in range(rounds):
        basis, _ = np.linalg.qr(product(thin))
        thin = basis.astype(np.float32)
    small = basis.T @ product(thin)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vector[:, np.argsort(-value)[:rank]]).astype(np.float32)


def _accumulate(out: np.ndarray, passage: np.ndarray, term: np.ndarray, value: np.ndarray, thin: np.ndarray) -> None:
    """out += A' (A thin) for unit-length passages."""
    which, y = _times(passage, term, value, thin)
    norm = np.sqrt(np.bincount(passage, value * value, (passage[-1] + 1) if len(passage) else 0))
    row = np.searchsorted(which, passage)
    value = value / norm[passage] ** 2 if len(passage) else value
    order = np.argsort(term, kind="stable")
    t = term[order]
    for s in range(0, len(order), 1 << 16):
        o, tt = order[s:s + (1 << 16)], t[s:s + (1 << 16)]
        cut = np.flatnonzero(np.concatenate([[True], tt[1:] != tt[:-1]]))
        out[tt[cut]] += np.add.reduceat(y[row[o]] * value[o, None], cut, axis=0)


class Short:
    """Items found only by all their words in a row: by length, sieves of runs and the items of each."""

    def __init__(self, items: list[Item]):
        self.runs: dict[int, tuple[Terms, list[list[int]]]] = {}
        for k in sorted({len(i.words) for i in items}):
            own = [i for i in items if len(i.words) == k]
            runs = Terms(own, run=k)
            ids: list[list[int]] = [[] for _ in runs.hashes]
            for i in own:
                ids[int(runs.find(_adjacent(i.words, k) if k > 1 else i.words)[0])].append(i.item_id)
            self.runs[k] = runs, ids

    def leaks(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item id)."""
        out = set()
        for k, (runs, ids) in self.runs.items():
            found = runs.find(_adjacent(hashes, k) if k > 1 else hashes)
            at = np.flatnonzero(found >= 0)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[doc + 1]
            for d, run in {*zip(doc[inside].tolist(), found[at[inside]].tolist())}:
                out.update((d, i) for i in ids[run])
        return out


class Finder:
    """Finds the leaks of texts; built once, sent to the tasks."""

    def __init__(self, items: list[Item], terms: Terms | None, weight: np.ndarray, bases: list[np.ndarray], block: int,
                 cosine: float, verbatim: float, paraphrase: float, answer: float, short: list[Item] = ()):
        self.short = Short(list(short))
        self.items, self.terms, self.weight, self.block = items, terms, weight.astype(np.float32), block
        self.bases, self.latent, self.size = bases, [], []
        for b, basis in enumerate(bases):
            own = items[b * block:(b + 1) * block]
            which, y = _times(*_item_entries(own, terms, weight), basis)
            z = np.zeros((len(own), basis.shape[1]), np.float32)
            z[which] = y
            self.latent.append(_unit(z))
            self.size.append(np.maximum(np.linalg.norm(z, axis=1), 1e-12))
        self.cosine, self.verbatim, self.paraphrase, self.answer = cosine, verbatim, paraphrase, answer
        telling = [np.unique(i.answer) for i in items]
        self.telling = [set(a[self._tells(a)].tolist()) or set(a.tolist()) for a in telling]

    def _tells(self, words: np.ndarray) -> np.ndarray:
        t = self.terms.find(words)
        return (t >= 0) & (self.weight[t] > 0)

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, cosine, share of the item in common, share of the answer)."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for at, run in buffers(texts):
            w = Words(run, BLANKS + PUNCTUATION)
            hashes = w.hashes()
            for d, item in self.short.leaks(hashes, w.first):
                best[at + d, item] = (1.0, 1.0, 1.0)
            if not self.items:
                continue
            which, term, begin = passages(self.terms.find(hashes), w.first, self.weight)
            if not len(which):
                continue
            entries = vectors(which, term, self.weight)
            norm = np.sqrt(np.bincount(entries[0], entries[2].astype(np.float64) ** 2))
            for b, (basis, latent, size) in enumerate(zip(self.bases, self.latent, self.size)):
                for s in range(0, len(entries[0]), 1 << 17):  # a bounded number of entries at a time
                    lo, hi = self._whole(entries[0], s), self._whole(entries[0], s + (1 << 17))
                    if lo == hi:
                        continue
                    rows, y = _times(*(e[lo:hi] for e in entries), basis)
                    along = y @ latent.T
                    near = along / np.maximum(norm[rows], 1e-12)[:, None].astype(np.float32)
                    for r, i in zip(*np.nonzero((near >= self.cosine) | (along >= WITHIN * size))):
                        p, i_all = rows[r], b * self.block + int(i)
                        start = begin[p]
                        doc = int(np.searchsorted(w.first, start, "right")) - 1
                        beside = max(STRIDE, AROUND * len(self.items[i_all].words))
                        self._check(best, at + doc, i_all, float(near[r, i]),
                                    hashes[max(w.first[doc], start - beside):min(w.first[doc + 1], start + WINDOW + beside)])
        return [(d, item, *v) for (d, item), v in best.items()]

    @staticmethod
    def _whole(passage: np.ndarray, at: int) -> int:
        """The first entry of the passage that entry ``at`` belongs to."""
        return len(passage) if at >= len(passage) else int(np.searchsorted(passage, passage[at]))

    def _check(self, best: dict, doc: int, i: int, cosine: float, words: np.ndarray) -> None:
        item = self.items[i]
        n = len(item.words)
        mine = np.isin(words, item.words)
        if mine.sum() < self.paraphrase * n:
            return
        # the stretch of about the item's length that shares most telling words with it
        reach, close = n + n // 2 + 4, words
        if len(words) > reach:
            t = self.terms.find(words)
            worth = np.concatenate([[0], np.cumsum(np.where(mine & (t >= 0), self.weight[t] + 0.1, 0))])
            s = int(np.argmax(worth[reach:] - worth[:-reach]))
            close = words[s:s + reach]
        common = item.common(words[mine].tolist()) / n  # other words are in no common subsequence
        if common < self.paraphrase:
            return
        told = self.telling[i]
        answer = len(told & set(words[mine].tolist())) / len(told)
        near = item.common(close.tolist()) / n
        if near >= self.verbatim or answer >= self.answer and (near >= self.paraphrase or common >= self.verbatim):
            key = (doc, item.item_id)
            if key not in best or (common, cosine) > (best[key][1], best[key][0]):
                best[key] = (cosine, common, answer)


def build(docs: DataFrame, benchmark: DataFrame, block: int = 256, cosine: float = 0.35,
          verbatim: float = 0.8, paraphrase: float = 0.6, answer: float = 0.6) -> Finder | None:
    """Statistics over all documents, the latent spaces, and the checks' thresholds."""
    ship(docs.sparkSession)
    items, short = items_of(benchmark)
    if not items and not short:
        return None
    if not items:
        return Finder([], None, np.zeros(0), [], block, cosine, verbatim, paraphrase, answer, short)
    terms = Terms(items)
    n, total = frequencies(docs, terms, Terms(items, run=RUN))
    weight = np.log((total + 1) / (n + 0.5))
    rare = n <= COMMON * max(total, 1)
    for i in items:  # an item of common words keeps its rarest ones
        t = np.unique(terms.find(i.words))
        if rare[t].sum() < 4:
            rare[t[np.argsort(n[t])[:4]]] = True
    weight = np.where(rare, np.maximum(weight, 0.01), 0).astype(np.float32)
    products = term_products(docs, terms, weight)
    bases = []
    for b in range(0, len(items), block):
        rank = min(block, len(items[b:b + block]) + 32, len(terms.hashes))
        bases.append(svd_basis(products, terms, weight, items[b:b + block], rank, min(16, len(terms.hashes) - rank)))
    discard(products)
    return Finder(items, terms, weight, bases, block, cosine, verbatim, paraphrase, answer, short)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, common (share of
    the item's words in common, in order), answer (share of the answer's telling words)."""
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    finder = build(docs, benchmark, **parameters)
    if finder is None:
        return docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext.broadcast(finder)  # bounded by the benchmark

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = sent.value.leaks([t.encode("utf-8") for t in part["text"]])
            ids = part["doc_id"].to_numpy()
            yield pd.DataFrame([(ids[d], *rest) for d, *rest in found],
                               columns=["doc_id", "item_id", "cosine", "common", "answer"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(batches, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents without a leak, with all their columns."""
    finder = build(docs, benchmark, **parameters)
    if finder is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(finder)
    at = docs.columns.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = np.ones(part.num_rows, bool)
            for d, *_ in sent.value.leaks([(t or "").encode("utf-8") for t in part.column(at).to_pylist()]):
                keep[d] = False
            yield part.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(batches, docs.schema)
