import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import jaccard_regions, latent_decontamination, pitman_yor, ppm_language, pu_toxicity
from ferrule.llm.words import BLANKS, PUNCTUATION, Words

from helpers import EDGE, documents

SF = "/root/testdata/sf0.01"


def crc(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n


# ---- words ----

def test_words_are_those_of_split():
    texts = [b"", b" a  b\tc", b"Hello hello HELLO", "ü x\x0by".encode(), b"tail ", b"x" * 5000]
    w = Words(texts)
    h = w.hashes()
    for i, t in enumerate(texts):
        assert [bytes(w.raw[a:b]) for a, b in zip(w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]])] == t.split()
    assert h[3] == h[4] == h[5] and len(set(h.tolist())) == len({x.lower() for t in texts for x in t.split()})
    assert len(Words([b"a,b c."], BLANKS + PUNCTUATION).start) == 3


# ---- language ----

def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ppm_language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_code_lengths_are_of_a_distribution():
    trees = ppm_language.Trees({"a": [b"banana bandana"], "b": [b"xyzzy plugh"]})
    before = trees.bits([b"ban"])[0]
    each = trees.bits([b"ban" + bytes([s]) for s in range(256)])
    assert np.allclose((2.0 ** -(each - before)).sum(0), 1, atol=1e-5)
    assert (trees.bits([b"", b"ban", b"xyz"]).argmin(1)[1:] == [0, 1]).all()
    long = b"banana " * 400_000  # more than one block
    assert np.isclose(trees.bits([long])[0, 0], trees.bits([long[:len(long) // 2]])[0, 0] * 2, rtol=1e-3)


def test_language_trees_count_every_labelled_row(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "éx", "cad"]) for _ in range(rng.randint(0, 9))), ["en", "de"][i % 2]) for i in range(2400)]
    rows += [(9000, "", "xx"), (9001, None, "yy"), (9002, "no language", None), (9003, "zz top", "held")]
    got = ppm_language.train(documents(spark, rows).repartition(7), F.col("lang").isNull() | (F.col("lang") != "held"))
    want = ppm_language.Trees({k: [t.encode() for _, t, la in rows if la == k] for k in ("en", "de")})
    assert got.languages == want.languages == ["de", "en"]
    texts = [b"ab ba", "éx cad".encode(), b"zz", b""]
    assert np.array_equal(got.bits(texts), want.bits(texts))
    long = [b"ab" * ppm_language.BLOCK, b"x"]
    run, n = ppm_language.runs_of(long)
    assert n.sum() == len(b"\n\n\n".join(long)) + 3 and len(run) == len(set(run.tolist()))


def test_language_edges(spark):
    got = ppm_language.language_id(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        if r.doc_id in (2, 3, 4):
            assert r.lang_pred == "und" and r.score == 0
        assert r.held_out == (crc(r.doc_id, 4) == 2)
    assert ppm_language.language_id(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in ppm_language.language_id(documents(spark, [(1, "text", None)])).collect()} == {"und"}
    docs = documents(spark, EDGE)
    kept = ppm_language.keep_identified(docs)
    assert kept.columns == docs.columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert ppm_language.keep_identified(documents(spark, [])).count() == 0


# ---- toxicity ----

def toxic_corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(20, 80))]
        bad = i % 8 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "vileness", "nastything"])
        rows.append((i, " ".join(words), "en"))
        if bad or i % 2:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in pu_toxicity.toxicity(documents(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    held = [d for d, _, _ in rows if crc(d, 3) == 1]
    assert all(got[d].held_out for d in held)
    bad = [d for d in held if d % 8 == 0]
    assert sum(got[d].predicted for d in bad) >= 0.9 * len(bad)
    assert sum(got[d].predicted for d in held if d % 8) <= 0.01 * len(held)


def test_toxicity_edges(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame(labels + [(None, None, None), (8, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = pu_toxicity.toxicity(documents(spark, rows[:600] + EDGE), lab).collect()
    assert len(got) == 600 + len(EDGE)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert pu_toxicity.toxicity(documents(spark, []), lab).count() == 0
    none = pu_toxicity.toxicity(documents(spark, EDGE), lab.where("doc_id < 0")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


# ---- language model ----

def model_by_hand(rows, held):
    toks = [(d, [*(t or "").encode().lower().split(), None]) for d, t, _ in rows]
    c = collections.Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in toks)


def test_language_model_base_is_exact_and_score_is_better(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    got = pitman_yor.language_model(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == \
        model_by_hand(rows, lambda d: crc(d, 10) == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark):
    got = pitman_yor.language_model(documents(spark, EDGE)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == \
        model_by_hand(EDGE, lambda d: crc(d, 10) == 0)
    assert all(r.score <= 0 for r in got)
    assert pitman_yor.language_model(documents(spark, [])).count() == 0
    untrained = pitman_yor.perplexity_scores(documents(spark, EDGE), "false", "true").collect()
    assert len(untrained) == len(EDGE) and all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_predictions_are_of_a_distribution(spark):
    """All texts of no, one and two words over the vocabulary and an unknown word have at most
    probability one together, and nearly one if training texts have at most two words."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(vocabulary[:1 + rng.randrange(12)]) for _ in range(rng.randint(0, 2))), None) for i in range(3000)]
    every = [*vocabulary, "unknown"]
    texts = ["", *every, *[f"{a} {b}" for a in every for b in every]]
    probes = [(10_000 + i, t, None) for i, t in enumerate(texts)]
    train = "doc_id < 10000"
    got = pitman_yor.perplexity_scores(documents(spark, rows + probes), train, f"NOT ({train})").where("held_out").collect()
    total = sum(10 ** r.score for r in got)
    assert len(got) == len(texts) and 0.5 < total <= 1 + 1e-9


def test_model_prefers_what_it_has_read(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    mixed = text.split()
    rng.shuffle(mixed)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(200)), None) for i in range(200)] + [(900 + i, text, None) for i in range(5)]
    docs = documents(spark, rows + [(5000, text, None), (5001, " ".join(mixed), None)])
    got = {r.doc_id: r.score for r in pitman_yor.perplexity_scores(docs, "doc_id < 5000", "doc_id >= 5000").collect()}
    assert got[5000] > got[5001] + 20


# ---- decontamination ----

def test_every_planted_item_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    planted = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(docs, bench).collect()}
    assert planted and planted <= got and len(got - planted) <= 0.02 * len(got) + 1


def test_paraphrases_are_found_and_clean_texts_left(spark):
    rng = random.Random(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    finder = latent_decontamination.build(docs, bench)
    pool = [r.text.split() for r in docs.limit(200).collect()]
    items = [(r.item_id, r.text.split()) for r in bench.collect()]
    texts = []
    for _, words in items:
        said = [rng.choice(rng.choice(pool)) if rng.random() < 0.1 else w for w in words]
        around = rng.choice(pool)
        texts.append(" ".join(around[:300] + said + around[300:600]).encode())
    found = {(d, i) for d, i, *_ in finder.leaks(texts)}
    assert sum((k, i) in found for k, (i, _) in enumerate(items)) >= 0.9 * len(items)
    shuffled = [" ".join(rng.sample(w, len(w))).encode() for _, w in items]
    assert len(finder.leaks(shuffled)) <= 0.05 * len(items)


def test_decontamination_edges(spark):
    item = "the quick brown fox jumps over the lazy sleeping dog. it barked loudly at midnight"
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, item + " again", "x")],
                                  "item_id long, text string, score string")
    rows = EDGE + [(50, "Before it: " + item.upper() + ", after it.", None), (51, LONG_WITH(item), None)]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(docs, bench).collect()}
    assert {(50, 1), (51, 1)} <= got and {d for d, _ in got} == {50, 51}
    kept = latent_decontamination.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, _ in EDGE)
    assert latent_decontamination.find_leaks(documents(spark, []), bench).count() == 0
    assert latent_decontamination.find_leaks(docs, bench.where("item_id = 4")).count() == 0
    assert latent_decontamination.drop_leaks(docs, bench.where("item_id = 4")).count() == len(rows)


def LONG_WITH(item):
    return "filler words here and there " * 2000 + item + " more filler words " * 500


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in "ab")
        item = latent_decontamination.Item(0, np.array(a, np.uint64), np.array(a, np.uint64))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert item.common(b) == row[-1]


# ---- near duplicates ----

def components_by_hand(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i), d) if sets[i] else d)) for i, (d, _, _) in enumerate(rows))


def near_corpus(seed, families=12, size=9):
    rng = random.Random(seed)
    rows, n = [], 0
    shared = " ".join(f"s{i}" for i in range(60))
    for f in range(families):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(500)}"
            text = " ".join(words + (shared.split() if rng.random() < 0.3 else []))
            rows.append((n, text if rng.random() < 0.5 else text.upper(), None))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_corpus(seed) + [(500 + (d or 0), t, la) for d, t, la in EDGE[:4]]
    got = jaccard_regions.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_hand(rows)


def test_large_regions_and_recursion_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_regions, "LARGE", 6)
    monkeypatch.setattr(jaccard_regions, "SMALL", 3)
    rows = near_corpus(3, families=4, size=30)
    got = jaccard_regions.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_hand(rows)


def test_near_duplicates_edges(spark):
    got = jaccard_regions.near_duplicates(documents(spark, EDGE)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_hand(EDGE)
    assert jaccard_regions.near_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, EDGE)
    kept = jaccard_regions.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 0 and ids.count(1) == 1 and {2, 3, 4, 5} <= set(ids)


def test_recursive_join_finds_all_components():
    rng = np.random.default_rng(4)
    sets, size = [], []
    for f in range(20):
        base = rng.choice(1000, 60, replace=False)
        for _ in range(12):
            keep = rng.random(60) < 0.93
            sets.append(np.unique(np.concatenate([base[keep], rng.choice(100_000, 3)])).astype(np.int64))
    size = np.array(list(map(len, sets)))
    join = jaccard_regions.Join(size, sets)
    join.run(np.arange(len(sets)))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            s = len(np.intersect1d(sets[i], sets[j]))
            if 7 * s >= 3 * (size[i] + size[j]):
                parent[root(i)] = root(j)
    pairs = {(root(i) == root(j)) == (join._root(i) == join._root(j)) for i in range(len(sets)) for j in range(i)}
    assert pairs == {True}


def test_linked_sets_share_enough_of_their_first_shingles():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = rng.choice(10_000, n, replace=False)
        y = x[rng.random(n) < rng.uniform(0.7, 1)]
        y = np.unique(np.concatenate([y, rng.choice(10_000, int(rng.integers(0, n // 4 + 1)), replace=False)]))
        x = np.unique(x)
        if len(y) and 7 * len(np.intersect1d(x, y)) >= 3 * (len(x) + len(y)):
            order = rng.permutation(10_000)  # any order of the shingles
            a, b = np.sort(order[x]), np.sort(order[y])
            assert len(np.intersect1d(a[:jaccard_regions.first_ones(len(a))], b[:jaccard_regions.first_ones(len(b))]))
            both = len(np.intersect1d(a[:jaccard_regions.shown(len(a))], b[:jaccard_regions.shown(len(b))]))
            need = jaccard_regions.least_shared(np.array([len(a), len(b)]))
            assert both >= need.max()
