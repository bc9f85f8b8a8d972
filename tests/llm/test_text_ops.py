import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ferrule.llm import exact_dedup, html_blocks, prefix_bpe, sharding, token_counts
from ferrule.llm.pieces import ranks_of

from helpers import EDGE, documents

SPACE = re.compile(r"[\x20\x09-\x0D]")


# ---- exact dedup ----

def dedup_by_hand(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out, kept = [], set()
    for d, t, _ in rows:
        key = SPACE.sub("", t or "")
        best = min(groups[key])
        stays = d == best[3] and -len(t or "") == best[0] and key not in kept  # one row a group
        kept |= {key} if stays else set()
        out.append((d, best[3], len(groups[key]), stays, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(documents(spark, EDGE)).collect()
    assert sorted((tuple(r) for r in got), key=str) == dedup_by_hand(EDGE)


def test_exact_dedup_same_for_any_history(spark):
    rows = [(i, f"text {i % 37} " + " " * (i % 3), "en") for i in range(300)]
    from pyspark.sql import functions as F
    for history in (F.lit(True), F.lit(False), F.col("doc_id") < 150):
        got = exact_dedup.exact_dedup(documents(spark, rows), history).collect()
        assert sorted((tuple(r) for r in got), key=str) == dedup_by_hand(rows)


def test_exact_dedup_keeps_one_of_repeated_ids(spark):
    rows = [(5, "a b", "en"), (5, "a\tb", "en"), (5, "a b", "en"), (6, "ab", "en"), (None, "z", "en"), (None, "z ", "en"), (None, " z", "en"), (7, "a  b", "en"), (8, "q", "en")]
    rows += [(5, "a b", "en")] * 40
    for given in (rows, [r for r in rows if r[0] != 7]):
        docs = documents(spark, given)
        got = exact_dedup.exact_dedup(docs).collect()
        assert sorted((tuple(r) for r in got), key=str) == dedup_by_hand(given)
        kept = exact_dedup.kept_documents(docs).collect()
        assert len(kept) == 3 and len({SPACE.sub("", r.text) for r in kept}) == 3
        assert (5, "a b") in {(r.doc_id, r.text) for r in kept} or (5, "a\tb") in {(r.doc_id, r.text) for r in kept} or given is rows


def test_exact_dedup_empty_and_kept(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    docs = documents(spark, EDGE)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    texts = [SPACE.sub("", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub("", t or "") for _, t, _ in EDGE})


def test_minimal_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    mat = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    levels, slot = exact_dedup.mph_build(mat)
    assert sorted(slot.tolist()) == list(range(5000))
    assert (exact_dedup.mph_find(levels, mat) == slot).all()


def test_strangers_are_told_apart_byte_by_byte(spark):
    history = exact_dedup.groups(exact_dedup.digests(documents(spark, [(i, f"old {i}", None) for i in range(50)])))
    new = exact_dedup.groups(exact_dedup.digests(documents(spark, [(100 + i, f"new {i}", None) for i in range(50)])))
    merged = exact_dedup.merge(new, exact_dedup.build_index(history, 4), 4).collect()
    assert len(merged) == 100 and all(r.n == 1 for r in merged)


# ---- sharding ----

def check_shards(rows, got, n_shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in rows)
    assert sum(r["size"] for r in got) == sum(size(t) for _, t, _ in rows)
    for s in range(n_shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400) + str(i), None) for i in range(3000)]
    got = sharding.shards(documents(spark, rows), 8).collect()
    check_shards(rows, got, 8)
    by = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(by) - min(by) <= 0.02 * sum(by) / 8
    crc = {d: zlib.crc32(t.encode()) for d, t, _ in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got)


def test_groups_stay_whole_unless_they_overfill(spark):
    rows = [(i, "hot text " * 20, None) for i in range(1000)] + [(1000 + i, f"text {i // 5} " * 10, None) for i in range(2500)]
    got = sharding.shards(documents(spark, rows), 8, ranges=128).collect()
    check_shards(rows, got, 8)
    by = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(by) - min(by) <= 0.03 * sum(by) / 8  # the hot group is a third of the rows
    shards_of = {}
    for r in got:
        shards_of.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(shards_of.pop(zlib.crc32(("hot text " * 20).encode()))) > 1
    assert all(len(s) == 1 for s in shards_of.values())


def test_shards_edges(spark):
    check_shards(EDGE, sharding.shards(documents(spark, EDGE), 8).collect(), 8)
    assert sharding.shards(documents(spark, []), 8).count() == 0
    same = [(7, "same row", None)] * 400
    got = sharding.shards(documents(spark, same), 4).collect()
    check_shards(same, got, 4)
    assert [sum(r.shard == s for r in got) for s in range(4)] == [100] * 4


def test_shards_written(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 7), None) for i in range(200)]
    sharding.write_shards(documents(spark, rows, clash=False), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in back) == list(range(200)) and {r.shard for r in back} == {0, 1, 2, 3}


# ---- tokens ----

FUZZ = ["", "a" * 3000, " lead", "trail ", "two  blanks", "a\n\n b", "l'été don't WE'LL", "x<|endoftext|>y<|endoftext|>",
        "漢字かな交じり", "\x1c\x1d a\x85b c", "1234567890 12,5%", "\t\t\ttabs", "\U0001F469‍\U0001F4BB"]


@pytest.fixture(scope="module")
def library():
    ranks = ranks_of(P.path("byte_bpe_50k.tiktoken"))
    return (Tokenizer.from_file(P.path("byte_bpe_50k.json")),
            tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def test_token_counts_and_codec_equal_the_libraries(spark, library):
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 600), 0x2003, 0x3000, 0x20AC, 0x1F600]]
    texts = FUZZ + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(400)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + EDGE
    docs = documents(spark, rows)
    json_tok, tik = library
    counts = {(str(d), len((t or "").encode()), len(json_tok.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows}
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 20).collect()
    assert len(got) == len(rows) and {(str(r.doc_id), r.n_bytes, r.n_tokens) for r in got} == counts
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    ids = {(str(d), tuple(tik.encode_ordinary(t or ""))) for d, t, _ in rows}
    assert {(str(r.doc_id), tuple(r.ids)) for r in prefix_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()} == ids
    trip = prefix_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(trip) == len(rows) and all(r.whole for r in trip)
    assert {(str(r.doc_id), r.decoded_sha256) for r in trip} == {(str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows}
    empty = documents(spark, [])
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert prefix_bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_common_pieces_outlast_a_stream_of_new_ones():
    import public_tokenizers as P
    from ferrule.llm.pieces import Recent
    made = []
    memo = Recent(lambda p: made.append(p) or (p,), 100)
    for i in range(2000):
        assert memo["the"] == ("the",) and memo[str(i)] == (str(i),)
    assert made.count("the") == 1 and len(memo) + len(memo.older) <= 200
    codec = prefix_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    codec.encode(" ".join(f"the w{i}x" for i in range(50)))
    assert " the" in codec.pieces and not any(" " in p[1:] for p in codec.pieces)


def test_prefix_table_appends_cuts_and_edits():
    vocab = prefix_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    data = "".join(rng.choices("the and ing tion er ", k=600)).encode()
    p = prefix_bpe.Prefixes(vocab, data[:300])
    p.append(data[300:])
    assert p.last == prefix_bpe.Prefixes(vocab, data).last
    for _ in range(60):
        a = rng.randint(0, len(p.data))
        b = min(len(p.data), a + rng.randint(0, 9))
        new = "".join(rng.choices("there ing ", k=rng.randint(0, 9))).encode()
        want = p.data[:a] + new + p.data[b:]
        p.edit(a, b, new)
        assert p.data == want and p.last == prefix_bpe.Prefixes(vocab, want).last
    p.cut(100)
    assert p.ids() == prefix_bpe.Prefixes(vocab, p.data).ids()


# ---- html ----

PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1>"
    "<p>Some  <b>bold</b>text.<br>More</p><script>var a='</p>'</script><p>Is.</p><aside>not this</aside>"
    "<div class='ad'>buy</div></article><footer>&copy; me</footer></body></html>": "Head & tail Some boldtext. More Is.",
    "<div id=cookie-notice>We use cookies on this site for good</div><main><p>Long enough text of the page itself.</p>"
    "<section class='comments'><p>I was first to comment here, what a page</p></section><form><label>Mail</label></form></main>":
        "Long enough text of the page itself.",
    "<article><p>unclosed <i>tags<p>second": "unclosed tags second",
    "plain words only": "plain words only",
    "<article><!-- <p>hidden</p> --><p hidden>gone</p><p>a&#233;b &lt;x&gt;</p></article>": "aéb <x>",
    "": "", None: "", "<script>": "",
}


def test_html_blocks(spark):
    rows = [(i, f"http://x/{i}", h, "x", "y") for i, h in enumerate(PAGES)] + [(0, None, next(iter(PAGES)), "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = html_blocks.extract(pages).collect()
    want = list(PAGES.values()) + [next(iter(PAGES.values()))]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted(
        (r[0], t, len(t)) for r, t in zip(rows, want))
    assert html_blocks.extract(pages.where("page_id < 0")).count() == 0


def test_html_matches_articles_of_the_given_pages(spark):
    import html
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<(?!/?b>)[^>]*>", " ", article)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", plain)).split())


def test_tree_learns_the_labelled_table():
    x, y = html_blocks.labelled()
    assert (html_blocks.classifier().predict(x) == y).mean() > 0.97
