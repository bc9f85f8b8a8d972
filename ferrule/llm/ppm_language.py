"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes up to order 3.  A context that has seen ``N`` bytes of
``q`` kinds gives a seen byte the probability n / (N + q); else it escapes with q / (N + q) to the
context that is one byte shorter, where the bytes already ruled out are excluded; below order 0
all 256 byte values are equally likely.  The statistics are frozen after training, so the code
length of a text is an exact sum over its bytes, and the shortest code wins.

Training reads every byte of every labelled row that may be learnt from: tasks count their runs of
four bytes by language, Spark adds them up, and the driver gets a row for each language and run (their
number follows the alphabets, not the rows) and sends the finished cost tables to the tasks.  Scoring
reads every byte of every text, vectorised over batches of texts.

Cases: null texts and texts without a letter are ``und`` with score 0; with no labelled rows all
texts are; ties go to the language that sorts first; repeated rows are scored each; an empty table
gives no rows; texts of any length are scored in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import fold, give_back, ship

ORDER = 3
START = b"\n" * ORDER  # the context of a text's first bytes
BLOCK = 1 << 20        # bytes counted or scored at a time
HELD = 1 << 21         # counts of runs a task holds unmerged
letter = regex.compile(r"\p{L}").search


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of four bytes in ``texts`` between ``START``s, first byte highest, and their counts."""
    d, held = np.frombuffer(START + START.join(texts) + START, np.uint8), []
    for b in range(0, len(d) - ORDER, BLOCK):
        x = d[b:b + BLOCK + ORDER].astype(np.uint32)
        held.append(np.unique(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:], return_counts=True))
    return held[0] if len(held) == 1 else _added(held)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One count a run."""
    run, at = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
    return run, np.bincount(at, np.concatenate([n for _, n in held]), len(run)).astype(np.int64)


class Trees:
    """Cost tables, in bits, of all languages.

    ``cls`` maps a byte to its class (bytes that no training text has share class 0: they have the
    same cost in any context).  ``low[c1, c2, s]`` has the cost of byte class s after two classes, one
    column a language; ``node[c1, c2, c3]`` numbers the order-3 contexts; there, ``entry[node, s]``
    leads to the cost of a byte seen by some language, and else ``escape[node]`` is added to ``low``.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self._grow({k: runs_of(v) for k, v in texts.items()})

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
        """From each language's runs of four bytes and how often they come."""
        trees = cls.__new__(cls)
        trees._grow(counts)
        return trees

    def _grow(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        seen = np.zeros(256, bool)
        seen[START[0]] = True
        for run, _ in counts.values():
            seen[run & 255] = True
        self.cls = np.zeros(256, np.int32)
        self.cls[seen] = np.arange(1, seen.sum() + 1)
        a = self.a = int(seen.sum()) + 1
        unseen = 256 - int(seen.sum())
        grams, low = [], []
        for k in self.languages:
            run, count = counts[k]
            c = [self.cls[run >> 8 * j & 255].astype(np.int64) for j in range(ORDER + 1)]  # last byte first
            p = np.full(a, 1 / 256)  # order -1; a class-0 byte is one of ``unseen``
            mass = np.full(a, 1 / 256)
            mass[0] = unseen / 256
            for order in range(ORDER):
                key = sum(c[j] * a ** j for j in range(order + 1))
                n = np.bincount(key, count, a ** (order + 1)).reshape((a,) * (order + 1))
                n[(self.cls[START[0]],) * (order + 1)] += ORDER - order  # the first bytes, which end no run
                p, mass = self._down(n, p, mass)
            low.append(-np.log2(p).astype(np.float32))
            grams.append((sum(c[j] * a ** j for j in range(ORDER + 1)), count))
        self.low = np.stack(low, -1).reshape(-1, len(self.languages))
        self._top(grams)

    @staticmethod
    def _down(n: np.ndarray, p: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the probabilities of the shorter contexts to those with counts ``n`` (last axis:
        byte).  ``p`` is a single byte's probability, ``mass`` that of its class."""
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        p, mass = np.broadcast_to(p, n.shape), np.broadcast_to(mass, n.shape)
        ruled_out = np.where(n > 0, mass, 0).sum(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, kinds / (total + kinds) / np.maximum(1 - ruled_out, 1e-12), 1.0)
            own = n / (total + kinds)
            return np.where(n > 0, own, p * escape), np.where(n > 0, own, mass * escape)

    def _top(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, width = self.a, len(self.languages)
        every = np.unique(np.concatenate([kind for kind, _ in grams]))
        contexts = np.unique(every // a)
        self.node = np.full(a ** 3, -1, np.int32)
        self.node[contexts] = np.arange(len(contexts))
        self.entry = np.full((len(contexts), a), -1, np.int32)
        at = self.node[every // a]
        self.entry[at, every % a] = np.arange(len(every))
        below = self.low[every % a ** 3]
        self.escape = np.zeros((len(contexts), width), np.float32)
        self.cost = np.empty((len(every), width), np.float32)
        for j in range(width):
            kind, count = grams[j]
            n = np.zeros(len(every))
            n[np.searchsorted(every, kind)] = count
            total = np.bincount(at, n, len(contexts))
            kinds = np.bincount(at, n > 0, len(contexts))
            ruled_out = np.bincount(at, np.where(n > 0, 2.0 ** -below[:, j], 0), len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = -np.log2(kinds / (total + kinds) / np.maximum(1 - ruled_out, 1e-9))
            self.escape[:, j] = np.where(total > 0, bits, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.cost[:, j] = np.where(n > 0, np.log2((total + kinds)[at]) - np.log2(n), self.escape[at, j] + below[:, j])

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language (texts x languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0
        for i, t in enumerate(texts):
            for b in range(0, len(t), BLOCK):
                before = START if b == 0 else t[b - ORDER:b]
                held.append((i, before, t[b:b + BLOCK]))
                size += len(held[-1][2])
                if size >= BLOCK:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes, bytes]], out: np.ndarray) -> None:
        if not held:
            return
        a = self.a
        c = self.cls[np.frombuffer(b"".join(x + y for _, x, y in held), np.uint8)]
        tri = (c[:-2] * a + c[1:-1]) * a + c[2:]  # classes i, i+1, i+2
        low, node = tri[1:], self.node[tri[:-1]]  # of byte i + 3
        entry = np.where(node >= 0, self.entry[node, c[3:]], -1)
        cost = np.where((entry >= 0)[:, None], self.cost[entry],
                        self.low[low] + np.where((node >= 0)[:, None], self.escape[node], 0))
        # byte i of the joined blocks has its cost in row i - 3
        lengths = np.array([len(y) for _, _, y in held])
        starts = np.cumsum(lengths + ORDER) - lengths - ORDER
        cuts = np.stack([starts, starts + lengths], 1).ravel()
        cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
        sums = np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]
        np.add.at(out, [i for i, _, _ in held], sums)


def train(docs: DataFrame, train_rows: Column) -> Trees | None:
    """Trees of all the rows that ``train_rows`` allows and that have a language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), train_rows.alias("ok"))
    rows = rows.where(F.col("ok") & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        some: dict[str, int] = {}
        size = 0
        for part in parts:
            for lang, texts in part.groupby("lang")["text"]:
                texts = [t.encode("utf-8") for t in texts]
                some[lang] = some.get(lang, 0) + sum(map(bool, texts))
                held.setdefault(lang, []).append(runs_of(texts))
                size += len(held[lang][-1][0])
            if size >= HELD:
                held, size = {k: [_added(v)] for k, v in held.items()}, 0
        for lang, v in held.items():
            run, n = _added(v)
            yield pd.DataFrame({"lang": lang, "run": np.append(run.astype(np.int64), -1), "n": np.append(n, some[lang])})
        give_back()

    runs = rows.select("lang", "text").mapInPandas(count, "lang string, run long, n long")
    found = runs.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()  # run -1: texts that are not empty
    lang = found["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    code, run, n = (x.to_numpy(zero_copy_only=False) for x in (lang.indices, found["run"].combine_chunks(), found["n"].combine_chunks()))
    counts = {}
    for i, name in enumerate(names):
        mine = np.flatnonzero(code == i)
        mine = mine[np.argsort(run[mine])]
        if n[mine[0]]:
            counts[name] = run[mine[1:]].astype(np.uint32), n[mine[1:]]
    return Trees.of_counts(counts) if counts else None


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (posterior of the prediction under equal
    priors), bits (code length of the prediction)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(trees)  # size follows the languages' runs of four bytes

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for part in parts:
            known = [bool(t and model and letter(t)) for t in part["text"]]
            lang, score, bits = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
            where = np.flatnonzero(known)
            if len(where):
                cost = model.bits([t.encode("utf-8") for t, k in zip(part["text"], known) if k])
                best = cost.argmin(1)
                bits[where] = cost[np.arange(len(best)), best]
                score[where] = 1 / np.exp2(np.maximum(cost.min(1, keepdims=True) - cost, -1000)).sum(1)
                for i, b in zip(where, best):
                    lang[i] = model.languages[b]
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score, "bits": bits})
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(batches, "doc_id long, lang_pred string, score double, bits double")


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits; the rows whose fold is
    ``held`` are not learnt from."""
    trees = train(docs, fold("doc_id", folds) != held)
    out = identify(docs, trees)
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "bits")


def keep_identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The documents whose language is identified, with all their columns, in one pass over them.
    Rejected are texts without a letter, and texts that the best tree codes in no fewer bits than
    their bytes have: they are in none of the learnt languages."""
    spark = docs.sparkSession
    ship(spark)
    trees = train(docs, fold("doc_id", folds) != held)
    if trees is None:
        return docs.where(F.lit(False))
    sent = spark.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t.encode("utf-8") if t and letter(t) else b"" for t in part.column(at).to_pylist()]
            bits = sent.value.bits(texts).min(1)
            yield part.filter(pa.array(bits < 8 * np.array(list(map(len, texts)), np.int64)))
        give_back()

    return docs.mapInArrow(batches, docs.schema)
