"""Contexts, dealing and sampling of the language model (op3)."""

import random

import numpy as np

from ferrule.llm import pitman_yor, tables
from ferrule.llm.words import Words, mix

from helpers import documents


def scores(docs, train, held):
    return {r.doc_id: r.score for r in pitman_yor.perplexity_scores(docs, train, held).collect()}


def test_contexts_that_agree_in_16_bits_stay_apart(spark):
    seen = {}
    for i in range(5000):
        w = f"w{i}"
        other = seen.setdefault(int(mix(Words([w.encode()]).hashes())[0] >> np.uint64(48)), w)
        if other != w:
            break
    rows = [(i, f"{other} x" if i % 2 else f"{w} y", None) for i in range(400)]
    rows += [(1000, f"{other} x", None), (1001, f"{other} y", None)]
    got = scores(documents(spark, rows), "doc_id < 1000", "doc_id >= 1000")
    assert got[1000] > got[1001] + 1


def test_scores_do_not_depend_on_dealing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", f"w{int(rng.paretovariate(0.7))}"]) for _ in range(40)), None) for i in range(300)]
    want = scores(documents(spark, rows), "doc_id % 10 > 0", "doc_id % 10 = 0")
    monkeypatch.setattr(pitman_yor, "LEAST_BUCKETS", 7)
    monkeypatch.setattr(pitman_yor, "HOT", 200)  # contexts dealt by cell
    assert len(pitman_yor._hot(documents(spark, rows).select("doc_id", "text"), 1)) > 2
    got = scores(documents(spark, rows).repartition(5), "doc_id % 10 > 0", "doc_id % 10 = 0")
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_tables_follow_their_exact_law():
    c, others, sent, root, d, d1 = 7, 5.0, 3.0, 40.0, 0.8, 0.6
    paths = np.zeros(c + 1)
    paths[1] = 1  # weights of all seatings, customer by customer
    for n in range(1, c):
        t = np.arange(c + 1)
        opened = paths * (1 + d * (others + t)) * (sent + t - d1) / (1 + root + t)
        paths = paths * np.maximum(n - d * t, 0)
        paths[1:] += opened[:-1]
    u = (np.arange(200_000) + 0.5) / 200_000
    x = [np.full(len(u), v) for v in (others, sent, root)]
    got = tables.draw_tables(np.full(len(u), c), *x, u, d, 1.0, d1, 1.0)
    assert np.allclose(np.bincount(got, minlength=c + 1) / len(u), paths / paths.sum(), atol=1e-4)


def test_large_cells_are_drawn_over_all_their_customers():
    u = (np.arange(4000) + 0.5) / 4000
    n = tables.EXACT
    for others, sent, root in ((50, 3, 1e5), (5000, 2000, 1e5), (300, 4000, 2e4)):
        x = [np.full(len(u), float(v)) for v in (others, sent, root)]
        exact = tables.draw_tables(np.full(len(u), n), *x, u, 0.8, 1.0, 0.7, 1.0)
        large = tables._draw_large(np.full(len(u), n), *x, u, 0.8, 1.0, 0.7, 1.0)
        assert abs(exact.mean() - large.mean()) < 0.01 * exact.mean() and abs(exact.std() - large.std()) < 0.05 * exact.std() + 0.05
    # a cell of 10^5 customers answers to its totals, which 32 moved customers could not
    x = [np.full(50, 3000.0), np.full(50, 2e4), np.full(50, 1e6)]
    few = tables.draw_tables(np.full(50, 100_000), *x, u[::80], 0.8, 1.0, 0.7, 1.0)
    many = tables.draw_tables(np.full(50, 100_000), 10 * x[0], *x[1:], u[::80], 0.8, 1.0, 0.7, 1.0)
    assert many.mean() > 2 * few.mean() and len(np.unique(many)) > 20


def test_score_is_that_of_the_states_by_hand(spark, monkeypatch):
    """One table a cell (no draw moves it): the predictive probability written out."""
    monkeypatch.setattr(pitman_yor, "draw_tables", lambda c, *rest: np.ones(len(c), np.int64))
    rows = [(0, "a b a b c", None), (1, "a b", None), (2, "c a", None), (9, "a c x", None)]
    got = scores(documents(spark, rows), "doc_id < 9", "doc_id >= 9")
    cells = {}
    for _, text, _ in rows[:3]:
        words = [None, *text.split(), "end"]
        for g, w in zip(words[:-1], words[1:]):
            cells[g, w] = cells.get((g, w), 0) + 1
    sent = {w: sum(v == w for _, v in cells) for _, w in cells}
    once, twice = (sum(n == k for n in sent.values()) for k in (1, 2))
    d, d1, root = 0.8, min(max(once / max(once + 2 * twice, 1), 0.1), 0.95), sum(sent.values())

    def probability(g, w):
        up = (sent[w] - d1 if w in sent else 1 + d1 * len(sent)) / (1 + root)
        c, t = (sum(f(n) for (h, _), n in cells.items() if h == g) for f in (lambda n: n, lambda n: 1))
        return (cells.get((g, w), 0) - d * ((g, w) in cells) + (1 + d * t) * up) / (1 + c)

    words = [None, "a", "c", "x", "end"]
    want = sum(np.log10(probability(g, w)) for g, w in zip(words[:-1], words[1:]))
    assert abs(got[9] - want) < 1e-9
