"""Items that are common because of their copies (op6)."""

import random

import numpy as np
from pyspark.sql import functions as F

from ferrule.llm import latent_decontamination

from ferrule.llm.words import BLANKS, PUNCTUATION, Words

from helpers import documents

SF = "/root/testdata/sf0.01"


def test_an_item_in_a_third_of_differing_documents_is_found_in_each(spark):
    rng = random.Random(5)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    common = sorted(items)[:4]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 400).orderBy("doc_id").limit(900)
    rows, planted = [], set()
    for k, r in enumerate(docs.collect()):
        words = r.text.split()
        if k % 3 == 0:
            # among rare terms of other items, so that the copied item's own weights decide
            item, others = rng.choice(common[:1]), [w for i in rng.sample(sorted(items)[4:], 3) for w in items[i].split()]
            rng.shuffle(others)
            words[20:20] = [*others[:20], *items[item].split(), *others[20:40]]
            planted.add((r.doc_id, item))
        rows.append((r.doc_id, " ".join(words), None))
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(documents(spark, rows), bench).collect()}
    assert planted and len(planted - got) == 0


def test_short_items_are_found_by_all_their_words_in_a_row(spark):
    long = "the quick brown fox jumps over the lazy sleeping dog. it barked loudly at midnight"
    bench = spark.createDataFrame([(1, long), (2, "Where is Ulm?"), (3, "entropy"), (4, "Where, is Ulm"), (5, " . ")], "item_id long, text string")
    rows = [(1, "So: where is ULM, they asked", None), (2, "ulm is where", None), (3, "where is", None), (4, "ulm entropy", None),
            (5, "a " * 100 + long + " b" * 100, None), (6, None, None), (7, "and where is", None), (8, "ulm", None)]
    want = {(1, 2), (1, 4), (4, 3)}
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(documents(spark, rows), bench).collect()}
    assert got == want | {(5, 1)}
    only = bench.where("item_id > 1")
    assert {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(documents(spark, rows), only).collect()} == want
    kept = latent_decontamination.drop_leaks(documents(spark, rows), only)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 8}


def test_items_with_other_words_between_theirs_are_found_whole(spark):
    rng = random.Random(9)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    plain = [r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 900)
             .orderBy("doc_id").limit(300).collect()]
    others = [w for words in plain for w in words]
    rows, planted = [], {}
    for k, item in enumerate(sorted(items)[:60]):
        for between in (1, 2, 3):
            spaced = [x for w in items[item].split() for x in (w, *rng.sample(others, between))]
            words = list(plain[k])
            words[30:30] = spaced
            rows.append((10 * k + between, " ".join(words), None))
            planted[10 * k + between, item] = between
    rows += [(10 ** 6 + k, " ".join(rng.sample(words, len(words))), None) for k, words in enumerate(plain)]
    got = {(r.doc_id, r.item_id): r.common for r in latent_decontamination.find_leaks(documents(spark, rows), bench).collect()}
    for between in (1, 2, 3):
        mine = [p for p, b in planted.items() if b == between]
        assert sum(p in got for p in mine) >= 0.9 * len(mine), between
    found = [got[p] for p in planted if p in got]
    assert sum(c == 1.0 for c in found) >= 0.9 * len(found)
    assert not [d for d, _ in got if d >= 10 ** 6]


def test_latent_space_is_fitted_on_every_passage(spark):
    rng = random.Random(4)
    names = [f"t{i}" for i in range(610)]  # more terms than a tile's side
    bench = spark.createDataFrame([(k, " ".join(names[k * 50:k * 50 + 60])) for k in range(12)], "item_id long, text string")
    rows = [(d, " ".join(rng.choice(names) if rng.random() < 0.1 else f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 120))), None)
            for d in range(2600)] + [(2600, None, None)]
    finder = latent_decontamination.build(documents(spark, rows).repartition(5), bench)
    words = Words([(t or "").encode() for _, t, _ in rows], BLANKS + PUNCTUATION)
    passage, term, value = latent_decontamination.vectors(
        *latent_decontamination.passages(finder.terms.find(words.hashes()), words.first, finder.weight)[:2], finder.weight)
    dense = np.zeros((passage[-1] + 1, len(finder.weight)))
    dense[passage, term] = value
    dense = dense[dense.any(1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    at, term, value = latent_decontamination._item_entries(finder.items, finder.terms, finder.weight)
    items = np.zeros((len(finder.items), len(finder.weight)))
    items[at, term] = value
    items /= np.linalg.norm(items, axis=1, keepdims=True)

    def product(thin):
        out, own = dense.T @ (dense @ thin), items.T @ (items @ thin)
        return out + own * max(1.0, np.linalg.norm(out) / np.linalg.norm(own))

    rank = finder.bases[0].shape[1]
    assert rank < len(finder.weight) - 16
    basis = np.random.default_rng(0).standard_normal((len(finder.weight), rank + 16)).astype(np.float32)
    for _ in range(2):
        basis, _ = np.linalg.qr(product(basis))
    small = basis.T @ product(basis)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    want = basis @ vector[:, np.argsort(-value)[:rank]]
    assert np.linalg.norm(finder.bases[0] @ finder.bases[0].T - want @ want.T) < 0.01
