"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else is unlabelled text, which holds toxic
texts too.  With the class prior p (share of toxic texts), the risk of calling unlabelled texts
clean is corrected by what the positives contribute to it:

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

Where the correction would go below zero the step goes the other way, so a flexible model cannot
profit from calling all unlabelled texts clean.  The classifiers are linear over hashed words and
word beginnings; a text's features are shares of its words, so whole texts of any length compare.
Several are trained with numpy on the driver, with different orders of the examples, and averaged.

Training reads a bounded, documented sample: at most about ``positives`` confirmed and
``unlabelled`` other texts, chosen by a hash of the text; scoring reads every byte of every text.

Cases: null texts count as empty; empty texts score the prior's value without evidence; with no
confirmed example every score is 0; repeated rows are scored each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import bounded_sample, fold, ship, text_or_empty
from ferrule.llm.words import BLANKS, PUNCTUATION, Words, buffers

BEGINNINGS = (4, 5, 6)     # besides whole words, their first bytes
SIEVE = 22                 # bits of the table that most words without weight fall through


def presence(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(index of the first text, feature hashes, text of each within the buffer, texts) by buffer."""
    for at, run in buffers(texts):
        w = Words(run, BLANKS + PUNCTUATION)
        kinds = np.stack([w.hashes()] + [w.hashes(k) ^ np.uint64(k) for k in BEGINNINGS], 1)
        doc = np.repeat(np.arange(len(run)), w.first[1:] - w.first[:-1])
        yield at, kinds, doc, len(run)


class Linear:
    """Classifiers over the presence of features: their sorted hashes, mean weight, and bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[features >> np.uint64(64 - SIEVE)] = True

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) of each distinct feature that a text has."""
        docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, kinds, doc, _ in presence(texts):
            hit, kind = np.nonzero(self.sieve[kinds >> np.uint64(64 - SIEVE)])
            h = kinds[hit, kind]
            f = np.minimum(np.searchsorted(self.features, h), max(len(self.features) - 1, 0))
            ok = self.features[f] == h if len(self.features) else np.zeros(len(h), bool)
            both = np.unique((at + doc[hit[ok]]) * (1 << 32) + f[ok])
            docs.append(both >> 32)
            found.append(both & 0xFFFFFFFF)
        return np.concatenate(docs), np.concatenate(found)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, f = self.rows(texts)
        margin = self.bias + np.bincount(doc, self.weights[f], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def candidates(positive: list[bytes], unlabelled: list[bytes], support: float = 0.01,
               posterior: float = 0.75, z: float = 5.0) -> tuple[np.ndarray, float]:
    """Features that mark toxic texts, and the class prior among the unlabelled texts.

    A feature that only toxic texts have is rarer in unlabelled texts by exactly the prior, any
    other is rarer by less: so the lowest quotients, weighted by how many positives have the
    feature, estimate the prior.  Chosen are the features of at least a share ``support`` of the
    positives, beyond ``z`` standard errors of chance, that make a text toxic with probability
    ``posterior`` or more (prior * share in positives / share in unlabelled texts)."""
    least = max(2, support * len(positive))

    def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for _, kinds, doc, _ in presence(texts):
            parts.append(_distinct(kinds, doc))
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, int))
    hp, cp = counts(positive)
    hp, cp = hp[cp >= least], cp[cp >= least]
    hu, cu = counts(unlabelled)
    at = np.minimum(np.searchsorted(hu, hp), max(len(hu) - 1, 0))
    n_u = np.where(hu[at] == hp, cu[at], 0) if len(hu) else np.zeros(len(hp))
    share_p, share_u = cp / len(positive), (n_u + 0.5) / (len(unlabelled) + 1)
    spread = np.sqrt(share_u * (1 - share_u) / len(positive))
    sure = share_p - share_u >= z * spread
    if not sure.any():
        return np.zeros(0, np.uint64), 0.5 / len(unlabelled)
    quotient = share_u / share_p
    rare = sure & (quotient <= 0.5)  # the prior is taken to be below one half; commoner words say little
    if not rare.any():
        return np.zeros(0, np.uint64), 0.5 / len(unlabelled)
    order = np.argsort(quotient[rare])
    weight = np.cumsum(share_p[rare][order] ** 2)
    prior = float(np.clip(quotient[rare][order][np.searchsorted(weight, 0.25 * weight[-1])], 1e-4, 0.5))
    sure &= prior * share_p >= posterior * share_u
    return hp[sure], prior


def _distinct(kinds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Feature hashes, once a text."""
    h, d = kinds.ravel(), np.repeat(doc, kinds.shape[1])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new]


def train(positive: list[bytes], unlabelled: list[bytes], members: int = 3,
          epochs: int = 40, batch: int = 512, rate: float = 16.0, decay: float = 1e-3) -> Linear:
    """nnPU with the logistic loss, plain gradient steps over mixed batches: features that many
    texts have move first, so chance features of few texts stay near zero."""
    features, prior = candidates(positive, unlabelled)
    base = Linear(features, np.zeros(len(features)), 0.0)
    texts, n_pos, width = positive + unlabelled, len(positive), len(features)
    doc, f = base.rows(texts)
    borders = np.searchsorted(doc, np.arange(len(texts) + 1))
    weights, biases = [], []
    for member in range(members):
        rng = np.random.default_rng(member)
        w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
        share = min(n_pos, batch // 2)
        for _ in range(epochs):
            order = rng.permutation(len(unlabelled)) + n_pos
            for s in range(0, len(order), batch):
                u = order[s:s + batch]
                rows = np.concatenate([rng.choice(n_pos, share, replace=False), u])
                n = borders[rows + 1] - borders[rows]
                at = np.repeat(borders[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                of, own = f[at], np.repeat(np.arange(len(rows)), n)
                m = np.clip(b + np.bincount(own, w[of], len(rows)), -30, 30)
                q = 1 / (1 + np.exp(-m))  # slope of the loss of calling a text clean
                clean = np.logaddexp(0, m)
                risk = clean[share:].mean() - prior * clean[:share].mean()
                grad = np.empty(len(rows))
                if risk >= 0:
                    grad[:share] = -prior / share  # p * (q - 1) - p * q
                    grad[share:] = q[share:] / len(u)
                else:  # the corrected risk is below zero: step back on it alone
                    grad[:share] = prior * q[:share] / share
                    grad[share:] = -q[share:] / len(u)
                w -= rate * (np.bincount(of, grad[own], width) + decay * w)
                b -= rate * grad.sum()
        weights.append(w)
        biases.append(b)
    w, b = np.mean(weights, 0), float(np.mean(biases))
    margin = b + np.bincount(doc, w[f], len(texts))
    scale, shift = _calibrated(margin[:n_pos], margin[n_pos:], prior)
    return Linear(features, w * scale, b * scale + shift)


def _calibrated(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of the margins: steps on few texts put texts in the right order but stop short
    of the level.  Half way between what nearly all confirmed texts reach (all but 2 %) and what the
    unlabelled texts beyond twice the toxic share stay below, the score is one half; there where
    the confirmed texts begin it is 0.8."""
    low = float(np.quantile(u, 1 - min(2 * prior, 0.5)))
    high = float(np.quantile(p, 0.02))
    if high - low < 1e-6:
        return 1.0, 0.0  # not parted: the margins stand as they are
    scale = np.log(0.8 / 0.2) / ((high - low) / 2)
    return float(scale), float(-scale * (low + high) / 2)


def fit(docs: DataFrame, labels: DataFrame, train_rows, positives: int = 3000, unlabelled: int = 6000) -> Linear | None:
    """Classifiers from confirmed examples and unlabelled text among the rows ``train_rows`` allows."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where(train_rows & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(train_rows)
    lab = lab.where("toxic = 1").select("doc_id")
    n = lab.count()
    if not n:
        return None
    # the sample of confirmed ids is drawn before the join; broadcast only by Spark's own size check
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) < min(1.0, positives / n) * (1 << 30)
    sure = rows.join(lab.where(pick), "doc_id", "left_semi")
    other = bounded_sample(rows.withColumn("all", F.lit(True)), F.col("all"), unlabelled, {True: rows.count()})
    pos = sorted(r.text.encode("utf-8") for r in sure.select("text").toLocalIterator())
    unl = sorted(r.text.encode("utf-8") for r in other.select("text").toLocalIterator())
    return train(pos, unl) if pos and unl else None


def score(docs: DataFrame, model: Linear | None, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score, predicted (1 if score >= ``threshold``)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS numbers

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for part in parts:
            s = m.scores([t.encode("utf-8") for t in part["text"]]) if m else np.zeros(len(part))
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": s})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = rows.mapInPandas(batches, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels of the fold ``held`` are not
    learnt from."""
    model = fit(docs, labels, fold("doc_id", folds) != held)
    return score(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")
