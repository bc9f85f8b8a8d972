"""Exact duplicate removal against an index of historical digests (minimal perfect hash).

Texts are equal when they are identical after deleting space and the five ASCII control spaces;
their SHA-256 stands for them.  ``build_index`` turns the distinct digests of a history into a
table with one row per bucket: the bit arrays of a minimal perfect hash, and slots that hold the
full 32-byte digests with the locator of the group's winner.  ``merge`` looks the digests of a new
batch up in it.  A perfect hash maps strangers to some slot too, so membership is decided by
comparing all 32 bytes; nonmembers form groups of their own.  The merged groups are again a
history, so batches can follow one another.

A bucket is a share of the digest space, so buckets are even whatever the texts are; a group with
a third of all rows is one digest, aggregated on the map side.

Cases: a null text counts as empty; empty texts are all equal to each other; a null doc_id loses
ties against any other id; of rows of a group that agree in id and length the one whose text has the least hash
stays, and one of equal rows; repeated rows each get a result row; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import keep_once, ship, stored, text_or_empty
from ferrule.operators.expand import explode_counts

#: The characters [\x20\x09-\x0D] that do not count.
BLANKS = " \t\n\x0b\x0c\r"

GAMMA = 1.5  # bits per key that a level of the perfect hash starts with
GROUP = "digest binary, n_cp bigint, keep_id bigint, n bigint"
INDEX = "bucket int, bits array<binary>, digests binary, n_cp array<bigint>, keep_id array<bigint>, n array<bigint>"


# ---- minimal perfect hash over full digests (numpy) ----

def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes -> n mixed 64-bit keys that depend on every byte."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    h = np.zeros(len(w), np.uint64)
    for j in range(4):
        h = _mix(h ^ w[:, j])
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (_mix(keys + step) % np.uint64(size)).astype(np.int64)


def mph_build(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays per level, and for each input digest its slot in 0..n-1.  A key settles on the
    first level where no other key shares its position; the slot is the rank of its bit."""
    keys = _words(digests)
    left, levels = np.arange(len(keys)), []
    slot, base = np.full(len(keys), -1, np.int64), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = _place(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        sits = alone[at]
        slot[left[sits]] = base + rank[at[sits]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~sits]
    return levels, slot


def mph_find(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest (strangers get some slot or -1)."""
    keys = _words(digests)
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, alone in enumerate(levels):
        if not len(left):
            break
        at = _place(keys[left], level, len(alone))
        hit = alone[at]
        slot[left[hit]] = base + (np.cumsum(alone) - 1)[at[hit]]
        base += int(alone.sum())
        left = left[~hit]
    return slot


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d) for d in digests), np.uint8).reshape(-1, 32)


# ---- distributed index ----

def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, code points of the original text, digest of the normalised
    text, and the digest in hex."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_cp"),
        F.xxhash64(text).alias("h"),
        F.unhex(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)).alias("digest"),
    )


def _best(rows: DataFrame, n) -> DataFrame:
    """Winner and size per digest: most code points, then the smallest non-null id."""
    best = F.min(F.struct((-F.col("n_cp")).alias("m"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    return (rows.groupBy("digest").agg(best.alias("b"), n.alias("n"))
            .select("digest", (-F.col("b.m")).alias("n_cp"), F.col("b.d").alias("keep_id"), "n"))


def groups(rows: DataFrame) -> DataFrame:
    return _best(rows, F.count(F.lit(1)))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def _index_of(part: pd.DataFrame) -> pd.DataFrame:
    mat = _matrix(part["digest"])
    levels, slot = mph_build(mat)
    order = np.argsort(slot)
    take = part.iloc[order]
    return pd.DataFrame({
        "bucket": [int(part["bucket"].iloc[0])],
        "bits": [[np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in levels]],
        "digests": [mat[order].tobytes()],
        "n_cp": [take["n_cp"].tolist()],
        "keep_id": [[None if pd.isna(x) else int(x) for x in take["keep_id"]]],
        "n": [take["n"].tolist()],
    })


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Index of a history of groups (``GROUP`` columns, distinct digests): one row per bucket."""
    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(_index_of, INDEX)


def _levels(bits) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(b[:-8], np.uint8), count=int.from_bytes(b[-8:], "little")).astype(bool)
            for b in bits]


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    cols = ["digest", "n_cp", "keep_id", "n"]
    if index.empty:
        return new[cols]
    row = index.iloc[0]
    slots = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    out = pd.DataFrame({"digest": [x.tobytes() for x in slots], "n_cp": list(row["n_cp"]),
                        "keep_id": pd.array([None if pd.isna(x) else int(x) for x in row["keep_id"]], "Int64"),
                        "n": list(row["n"])})
    if new.empty:
        return out
    mat = _matrix(new["digest"])
    slot = mph_find(_levels(row["bits"]), mat)
    member = slot >= 0
    member[member] = (slots[slot[member]] == mat[member]).all(1)  # all 32 bytes decide
    for at, cp, keep, n in zip(slot[member], new["n_cp"][member], new["keep_id"][member], new["n"][member]):
        out.iat[at, 3] += n
        old, mine = out.iat[at, 2], (None if pd.isna(keep) else int(keep))
        rank = lambda c, k: (-c, k is None or pd.isna(k), 0 if k is None or pd.isna(k) else k)
        if rank(cp, mine) < rank(out.iat[at, 1], old):
            out.iat[at, 1], out.iat[at, 2] = cp, (pd.NA if mine is None else mine)
    strangers = new.loc[~member, cols].astype({"keep_id": "Int64"})
    return pd.concat([out, strangers], ignore_index=True)


def merge(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups of history and new batch together (``GROUP`` columns, distinct digests)."""
    return (_bucketed(new, buckets).groupBy("bucket")
            .cogroup(index.groupBy("bucket")).applyInPandas(_look_up, GROUP))


def bucket_count(n: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """Buckets so that one holds about ``per_bucket`` digests: its index row is about 1 MB."""
    return max(least, -(-n // per_bucket))


def resolve(docs: DataFrame, historical=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, h (hash of the text), and alike: it has
    the id and the text of the row that stays.

    ``historical``: condition on doc_id that says which rows are the indexed history; the others
    are the new batch.  The result does not depend on it.  Default: half of the ids by hash."""
    ship(docs.sparkSession)
    rows = stored(digests(docs), "digests")
    old = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2)) == 0 if historical is None else historical
    old = F.coalesce(old, F.lit(False))
    history, new = groups(rows.where(old)), groups(rows.where(~old))
    buckets = bucket_count(rows.count())
    index = stored(build_index(history, buckets), "digest-index")
    final = stored(merge(new, index, buckets), "digest-groups")
    out = rows.join(final.select("digest", "keep_id", F.col("n").alias("group_size"), F.col("n_cp").alias("keep_cp")), "digest")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    out = out.select("digest", "doc_id", "keep_id", "group_size", best.alias("best"), "h")
    # an id that repeats can give a group several best rows: the least hash of a text stays, of equal rows one
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    repeated = stored(repeated, "repeated-ids")
    if repeated.isEmpty():
        return _shown(out.select("*", F.col("best").alias("kept"), F.col("best").alias("alike")))
    several = final.join(repeated, F.col("keep_id").eqNullSafe(F.col("__id")), "left_semi").select("digest")
    tied = out.join(several, "digest", "left_semi")
    least = tied.where("best").groupBy("digest").agg(F.min("h").alias("least"))
    tied = tied.join(least, "digest").withColumn("alike", F.col("best") & (F.col("h") == F.col("least")))
    equal = tied.where("alike").groupBy("digest", "doc_id", "keep_id", "group_size", "h").agg(F.count(F.lit(1)).alias("n"))
    one = equal.select("digest", "doc_id", "keep_id", "group_size", F.lit(True).alias("best"), "h", F.lit(True).alias("kept"), F.lit(True).alias("alike"))
    more = equal.where("n > 1").withColumn("m", F.col("n") - 1).withColumn("start", F.lit(0).cast("long"))
    more = explode_counts(more, "start", "m", "copy", "digest")  # in chunks over tasks
    no, yes = F.lit(False), F.lit(True)
    parts = [out.join(several, "digest", "left_anti").select("*", F.col("best").alias("kept"), F.col("best").alias("alike")),
             tied.where("NOT alike").select(*out.columns, no.alias("kept"), "alike"), one,
             more.select("digest", "doc_id", "keep_id", "group_size", yes.alias("best"), "h", no.alias("kept"), yes.alias("alike"))]
    return _shown(reduce(DataFrame.unionByName, parts))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "h", "alike")


def exact_dedup(docs: DataFrame, historical=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept (one row a group), text_sha256."""
    return resolve(docs, historical).drop("h", "alike")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row a group."""
    return keep_once(docs, resolve(docs).where("alike").select("doc_id", "h"))


SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n_cp DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY h ORDER BY n_cp DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256 FROM w
"""
