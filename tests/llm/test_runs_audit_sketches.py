import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from ferrule.llm import filter_audit, odd_sketches, periodic_runs
from ferrule.llm.registry import op12_periodic_runs

from helpers import EDGE, LONG, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF0001 = "/root/testdata/sf0.001"


# ---- filter audit ----

def audit_by_hand(rows, labels):
    def fails(d, t):
        w = WORD.findall(t)
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in rows)}
    docs = [(lang or "", fails(d, t or ""), labels.get(d, (0, 0))) for d, t, lang in rows]
    out, total = {}, defaultdict(int)
    for part in {p for p, _, _ in docs}:
        for order in permutations("ABCDE"):
            left = [x for x in docs if x[0] == part]
            gone = []
            for k, f in enumerate(order):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, "".join(order), k + 1] = [
                    len(left), len(removed), sum(x[1][f] for x in gone), sum(x[0] == part and x[1][f] and sum(x[1].values()) == 1 for x in docs),
                    sum(x[2][0] for x in removed), sum(x[2][1] for x in removed)]
                total[part, f] += len(removed)
                gone += removed
    return sorted((p, o, k, *v, total[p, o[k - 1]]) for (p, o, k), v in out.items())


def test_filter_audit_by_hand(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "delta", "x#", "é", "zeta", "a|b"] + [f"w{i}" for i in range(150)]
    rows = [(i % 40 if i % 11 else None, " ".join(r.choice(words[:r.choice([3, 8, 158])]) for _ in range(r.choice([3, 90, 130]))), r.choice(["en", "de", None]))
            for i in range(60)]
    rows += [(100 + i, rows[i % 4][1], r.choice(["en", "fr"])) for i in range(30)] + EDGE
    labels = {i: (r.randrange(2), r.randrange(2)) for i in range(0, 120, 2)}
    table = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(documents(spark, rows), table).collect()
    assert sorted(tuple(x) for x in got) == audit_by_hand(rows, labels)


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(documents(spark, []), labels).count() == 0


# ---- periodic runs ----

def lyndon_by_hand(s):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))
    return [max(e - i for e in range(i + 1, len(s) + 1) if is_lyndon(s[i:e])) for i in range(len(s))]


def runs_by_hand(s, shortest):
    out = []
    for q in range(1, len(s) // 2 + 1):
        same = [i + q < len(s) and s[i] == s[i + q] for i in range(len(s))]
        i = 0
        while i < len(s):
            j = i
            while same[j]:
                j += 1
            if j > i and j + q - i >= max(2 * q, shortest):
                w = s[i:j + q]
                if not any(w[r:] == w[:-r] for r in range(1, q)):
                    out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_lyndon_arrays():
    r = random.Random(1)
    for _ in range(500):
        s = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(1, 25))]
        assert periodic_runs.lyndon(s) == lyndon_by_hand(s)


@pytest.mark.parametrize("shortest", [2, 5, 12, 13])
def test_runs_of_documents(shortest):
    r = random.Random(shortest)
    docs = []
    for _ in range(300):
        base = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(0, 12))]
        s = (base * r.randrange(1, 6))[:r.randrange(1, 70)] + [r.randrange(4) for _ in range(r.randrange(0, 15))]
        docs.append([b"%d" % x for x in s + s[:r.randrange(0, 20)]])
    for doc, found in zip(docs, periodic_runs.document_runs(docs, shortest)):
        assert [tuple(x) for x in found.tolist()] == runs_by_hand(doc, shortest)


def test_runs_of_self_similar_words():
    s = [0]
    while len(s) < 1 << 11:
        s += [1 - x for x in s]
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    docs = [[b"%d" % x for x in s], [bytes([c]) for c in fib[-1]], [b"x"] * 3000]
    for doc, found in zip(docs, periodic_runs.document_runs(docs)):
        assert [tuple(x) for x in found.tolist()] == runs_by_hand(doc, 12)


def digests_by_hand(d, t):
    w = WORD.findall(t or "")
    n, h = len(w), zlib.crc32(("" if d is None else str(d)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w, 12)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return (d, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_edges(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 60))), "en") for i in range(120)] + EDGE
    rows = [(d, t if t != LONG else LONG[:2000], la) for d, t, la in rows]
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(documents(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests_by_hand(d, t) for d, t, _ in rows), key=str)
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


def test_long_text_is_one_run(spark):
    row = periodic_runs.periodic_runs(documents(spark, [(1, LONG, "en")])).first()
    assert [tuple(x) for x in row.runs] == [(0, 24000, 8)] and row.collapsed == "alpha beta gamma delta epsilon zeta eta theta"


def test_query_on_whole_table(spark):
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    short = {d: t for d, t in rows if len(t or "") < 6000}  # the plain version is quadratic
    got = [tuple(x) for x in op12_periodic_runs(spark, SF0001).collect()]
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[0] in short) == sorted(digests_by_hand(d, t) for d, t in short.items())


# ---- odd sketches ----

def components_by_hand(rows):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    out = []
    for i, (d, _, _) in enumerate(rows):
        c = min(ids[root(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def near_copies(r, n, words, most):
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, most + 1)):
            w[r.randrange(words)] = f"v{r.randrange(5000)}"
        out.append(" ".join(w))
    return out


def test_components_by_hand(spark):
    r = random.Random(3)
    texts = []
    for words in (6, 12, 40, 120, 300):
        for most in (1, 3, 8):
            texts += near_copies(r, 18, words, most)
    texts += [" ".join(t.split()[k:]) for t in texts[:60] for k in (1, 9)]  # chains of ever shorter texts
    r.shuffle(texts)
    rows = [(3 * i if i % 50 else None, t.upper() if i % 7 == 0 else t, "en") for i, t in enumerate(texts)] + EDGE
    got = odd_sketches.near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == components_by_hand(rows)


def test_chain_of_sets_at_the_threshold(spark):
    # every text is linked with the next alone: 92 common shingles of 108
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[8 * i:8 * i + 104]), "en") for i in range(60)]
    got = odd_sketches.near_duplicates(documents(spark, rows)).collect()
    assert {x.component_id for x in got} == {0} and [x.doc_id for x in got if x.kept] == [0]


def test_no_documents(spark):
    assert odd_sketches.near_duplicates(documents(spark, [])).count() == 0


def test_sketch_estimates_and_lets_links_through():
    rng = np.random.default_rng(0)
    cut, off = odd_sketches.most_bits(), []
    for _ in range(300):
        every = np.unique(rng.integers(0, 1 << 60, 2000))
        pair = [every[:1850], every[150:]]  # 1700 of 2000: 0.85
        a, b = odd_sketches.odd_sketch(odd_sketches.min_hashes(pair))
        count = int(np.bitwise_count(a ^ b).sum())
        assert count <= cut
        off.append(float(odd_sketches.estimate(count)) - 0.85)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05
    far = odd_sketches.odd_sketch(odd_sketches.min_hashes([every[:1500], every[500:]]))  # a half
    assert int(np.bitwise_count(far[0] ^ far[1]).sum()) > cut
