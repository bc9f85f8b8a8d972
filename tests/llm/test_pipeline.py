import hashlib

import corpus_pipeline
import public_tokenizers as P
import tiktoken

import __spark_entry__
from ferrule.llm.pieces import ranks_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "bpe_codec"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from ferrule.llm.common import stored
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert set(rows) <= set(before)
        if name == "language_id":
            assert rows == before  # all are text of a learnt language
        if name == "exact_dedup":
            bare = ["".join(t.split()) for t in rows.values()]
            assert len(bare) == len(set(bare)) == len({"".join(t.split()) for t in before.values()})
        if name == "jaccard_join":
            sets = []
            for t in rows.values():
                w = t.encode().lower().split()
                sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
            assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "decontamination":
            assert not any(i in t for i in items for t in rows.values())
            clean = {d for d, t in before.items() if not any(i in t for i in items)}
            assert set(rows) <= clean
        before = rows
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(last) == set(before)
    for d, t in before.items():
        ids = tik.encode_ordinary(t)
        assert last[d].n_tokens == len(ids)
        assert last[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_entry_registers_the_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
