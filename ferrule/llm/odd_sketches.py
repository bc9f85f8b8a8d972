"""Near-duplicate components by MinHash bands, with odd sketches between candidates and exact checks.

1. A text's distinct five-word shingles are its set; equal sets are one node from there on.  Of every
   set ``HASHES`` MinHash values are drawn; every ``ROWS`` of them make a band.
2. An odd sketch is a bitmap of ``BITS`` bits in which every MinHash value (with its number) flips one
   bit.  Equal values of two nodes flip the same bit, so the XOR of two sketches has at most two bits
   for every value that differs, and its population count estimates a high similarity sharply:
   1 - J is about -BITS / (4 HASHES) * ln(1 - 2 count / BITS).
3. Nodes that share a band are candidates.  What the sketches put clearly under the threshold goes;
   what is left is confirmed on the full sets: 100 * intersection >= ``PERCENT`` * union.

Nobody compares all pairs of a band: a band's first node by a hash is its star, and first every node
is confirmed with its nearest star.  Confirmed links give components, and a band whose nodes all
lie in one component is finished.  The nodes of the others meet those of other components again, by
the rarest of their shingles, which leaves out no linked pair (``_first_keys``): first with the most
central nodes, then, in the bands that are open after that, all that may be linked.  Links inside
a component are not listed; no component lacks one.

What may be lost: two sets at the very threshold share no band with probability
(1 - 0.85^4)^32 < 1e-10, and more of their MinHash values differ than the sketch lets through with
probability under ``LOSS``.  Nothing else is sampled or capped.

Bands of many nodes are joined by Spark, which splits them: the star and the counts of a band come
from a partial aggregate, and joins read stored tables.

Cases: null and empty texts, and texts without words, have no shingles and are linked with nothing;
texts of one to four words have one shingle, the whole sequence; repeated rows and ids are rows with
equal sets; a null doc_id takes the smallest id of its component (none: null) and is kept only there;
a very long text is one row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import ship, stored, text_or_empty
from ferrule.llm.jaccard_regions import components, digest, shingles
from ferrule.llm.words import mix

PERCENT = 85
HASHES, ROWS, BITS = 128, 4, 512
LOSS = 1e-9
ROWS_A_SLICE = 500
LET_THROUGH = 1 << 27  # bits that say which rows are read again: 16 MB at most

_STEP = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))
_SHIFT = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def most_bits(percent: int = PERCENT, hashes: int = HASHES, loss: float = LOSS) -> int:
    """The largest XOR count that two linked sets' sketches have but with probability under ``loss``:
    twice the number of differing MinHash values that they exceed so rarely."""
    miss, rest = 1 - percent / 100, 1.0
    for k in range(hashes + 1):
        rest -= comb(hashes, k) * miss ** k * (1 - miss) ** (hashes - k)
        if rest < loss:
            return 2 * k
    return 2 * hashes


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) MinHash values of sets that are not empty."""
    every = np.concatenate(sets).astype(np.uint64)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(every * _STEP[j] + _SHIFT[j], first)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """(sets, HASHES / ROWS) hashes of a band's number and values."""
    grouped = values.reshape(len(values), -1, ROWS)
    h = np.broadcast_to(mix(np.arange(1, grouped.shape[1] + 1, dtype=np.uint64)), grouped.shape[:2])
    for r in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + grouped[:, :, r])
    return h


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) words: the parity of the MinHash values that fall on each bit."""
    bit = (mix(values ^ _SHIFT) % np.uint64(BITS)).astype(np.int64)
    at = np.arange(len(values))[:, None] * BITS + bit
    odd = np.bincount(at.ravel(), minlength=len(values) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), BITS), axis=1, bitorder="little").view(np.uint64)


def estimate(count: np.ndarray) -> np.ndarray:
    """The similarity that an XOR population count stands for."""
    return 1 + BITS / (4 * HASHES) * np.log(np.maximum(1 - 2 * np.asarray(count) / BITS, 1e-9))


# ---- points and bands ----

def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, ROWS_A_SLICE):
            yield part.slice(at, ROWS_A_SLICE)


def _lists(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).view(np.int64)))


def points(rows: DataFrame, seed: int) -> DataFrame:
    """doc_id, h (hash of the text), size, node and second digest of the set, its bands and its sketch."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            sets = list(shingles([t.encode() for t in part.column(2).to_pylist()], seed))
            full = [s for s in sets if len(s)]
            at = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            values = min_hashes(full) if full else np.zeros((0, HASHES), np.uint64)
            band, sketch = np.zeros((len(sets), HASHES // ROWS), np.uint64), np.zeros((len(sets), BITS // 64), np.uint64)
            band[at], sketch[at] = bands(values), odd_sketch(values)
            name = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.array(list(map(len, sets)), np.int64)), pa.array(name[:, 0].copy()),
                 pa.array(name[:, 1].copy()), _lists(band.view(np.int64)), _lists(sketch.view(np.int64))],
                names=["doc_id", "h", "size", "node", "other", "bands", "sketch"])

    return rows.select("doc_id", "h", "text").mapInArrow(
        batches, "doc_id long, h long, size long, node long, other long, bands array<long>, sketch array<long>")


def _row(doc_id: Column, h: Column) -> Column:
    return F.xxhash64(doc_id, h)


def _nodes(found: DataFrame) -> DataFrame:
    """A row a distinct set: node, size, row (hash of one of its rows), bands, sketch."""
    real = found.where("size > 0")
    return real.groupBy("node").agg(F.first("size").alias("size"), F.min(_row(F.col("doc_id"), F.col("h"))).alias("row"),
                                    F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))


def _compatible(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _near(a: str, b: str) -> Column:
    """XOR population count of two sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs x, y that sketches do not rule out, with their XOR count."""
    x = sketches.select(F.col("node").alias("x"), F.col("sketch").alias("sx"))
    y = sketches.select(F.col("node").alias("y"), F.col("sketch").alias("sy"))
    return pairs.join(x, "x").join(y, "y").select("x", "y", _near("sx", "sy").alias("apart")).where(F.col("apart") <= most_bits())


# ---- full sets ----

def _bits(rows: DataFrame) -> np.ndarray:
    """A bit for every row hash; lets all of them through and, as long as they are few, little else."""
    words = rows.select(F.shiftright(F.expr(f"pmod(row, {LET_THROUGH})"), 6).cast("int").alias("w"),
                        F.expr("shiftleft(1L, cast(pmod(row, 64) AS int))").alias("b"))
    some = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most LET_THROUGH / 64 rows
    out = np.zeros(LET_THROUGH // 64, np.int64)
    out[some["w"].to_numpy(np.int64)] = some["b"].to_numpy(np.int64)
    return out


def _sets(rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """node, size, keys of the wanted rows' texts (hash of a row: row)."""
    sent = rows.sparkSession.sparkContext.broadcast(_bits(wanted))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            at = part.column(0).to_numpy() % LET_THROUGH
            word = sent.value[at >> 6].view(np.uint64)
            take = np.flatnonzero(word >> (at & 63).astype(np.uint64) & np.uint64(1))
            if not len(take):
                continue
            texts = [t.encode() for t in part.column(1).take(pa.array(take)).to_pylist()]
            sets = [s for s in shingles(texts, seed) if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     _lists(sets)], names=["node", "size", "keys"])

    chosen = rows.select(_row(F.col("doc_id"), F.col("h")).alias("row"), "text")
    return chosen.mapInArrow(batches, "node long, size long, keys array<long>").dropDuplicates(["node"])


def _linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        (ex, kx), (ey, ky) = ((part.column(c).offsets.to_numpy(), part.column(c).values.to_numpy()) for c in (2, 3))
        ok = np.zeros(part.num_rows, bool)
        for i in range(part.num_rows):
            x, y = kx[ex[i]:ex[i + 1]], ky[ey[i]:ey[i + 1]]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            ok[i] = 100 * shared >= PERCENT * (len(x) + len(y) - shared)
        take = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)], names=["x", "y"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs x, y whose full sets are linked."""
    x, y = (sets.select(F.col("node").alias(c), F.col("keys").alias("k" + c)) for c in "xy")
    return pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "kx", "ky").mapInArrow(_linked, "x long, y long")


# ---- bands ----

def _labels(links: DataFrame) -> DataFrame:
    return stored(components(links), "band-labels")


def _first_keys(held: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """key, node, root, size, met, at (its place among the node's shingles): of every node of a band of several components, the shingles by which
    it still meets what it may be linked with across components.

    ``met`` shingles of a node are held by another component too.  A linked set of n shingles shares
    all but 15 % of them.  With those that no other component holds first, then those that few nodes
    hold, two linked sets share one among the first n - ceil(0.85 n) + 1 of each; a set whose first
    ones nobody else holds is linked with nothing more."""
    labels = _labels(links)
    tagged = stored(held.join(labels, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "band-tags")
    several = tagged.groupBy("band").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("band")
    nodes = stored(tagged.join(stored(several, "open-bands"), "band").select("node", "root").distinct(), "open-nodes")
    keys = stored(nodes.join(sets, "node").select("node", "root", "size", F.explode("keys").alias("key")), "open-keys")
    meeting = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("l"), F.max("root").alias("h"))
    met = keys.join(stored(meeting.where("l <> h").select("key", "n"), "meeting-keys"), "key")
    own = Window.partitionBy("node")  # a document's shingles
    name = [F.bit_xor(F.xxhash64("key", F.lit(k))).over(own).alias(f"name{k}") for k in (1, 2)]
    met = met.select("*", F.row_number().over(own.orderBy("n", "key")).alias("place"), F.count(F.lit(1)).over(own).alias("met"), *name)
    first = met.where(F.col("place") <= F.col("met") - F.expr(f"({PERCENT} * size + 99) div 100") + 1)
    first = first.withColumn("at", F.col("size") - F.col("met") + F.col("place"))
    alike = first.groupBy("key", "root", "size", "met", "at", "name1", "name2").agg(F.min("node").alias("node"))
    return stored(alike.select("key", "node", "root", "size", "met", "at"), "first-keys")


def _possible(x: str, y: str) -> Column:
    """Whether two nodes (their columns end in x and y) of different components can be linked: they share
    no more than the fewer of their ``met`` shingles."""
    most = F.least("met" + x, "met" + y)
    return (F.col("root" + x) != F.col("root" + y)) & (100 * most >= PERCENT * (F.col("size" + x) + F.col("size" + y) - most))


def _early(x: str, y: str) -> Column:
    """Whether a common shingle is early enough in both: sets that share ``need`` shingles, as linked ones of
    these sizes do, share one among the first size - need + 1 of each."""
    both = F.col("size" + x) + F.col("size" + y)
    need = F.floor((PERCENT * both + 99 + PERCENT) / (100 + PERCENT)).cast("long")
    return (F.col("at" + x) <= F.col("size" + x) - need + 1) & (F.col("at" + y) <= F.col("size" + y) - need + 1)


def _ends(first: DataFrame, c: str) -> DataFrame:
    return first.select("key", *[F.col(n).alias(n + c) for n in ("node", "root", "size", "met", "at")])


def _central_pairs(first: DataFrame) -> DataFrame:
    """x, y: every node with the nodes of which others hold the largest share, one a shingle."""
    star = first.groupBy("key").agg(F.max(F.struct((F.col("met") / F.col("size")).alias("share"), "node", "root", "size", "met")).alias("s"))
    star = stored(star.select("key", *[F.col("s." + n).alias(n + "y") for n in ("node", "root", "size", "met")]), "central-stars")
    return _ends(first, "x").join(star, "key").where(_possible("x", "y")).select(F.col("nodex").alias("x"), F.col("nodey").alias("y")).distinct()


def _all_pairs(first: DataFrame) -> DataFrame:
    """x, y: all that may still be linked."""
    met = _ends(first, "x").join(_ends(first, "y"), "key").where(_possible("x", "y") & _early("x", "y") & (F.col("nodex") < F.col("nodey")))
    return met.select(F.col("nodex").alias("x"), F.col("nodey").alias("y")).distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, size, node; links x, y between nodes that give their components)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    seed = 0
    while True:
        found = stored(points(rows, seed), "odd-points")
        clash = found.where("size > 0").groupBy("node").agg(F.min("other").alias("l"), F.max("other").alias("h"))
        if clash.where("l <> h").isEmpty():
            break
        seed += 1  # two sets with the same 64-bit digest: other hashes
    nodes = stored(_nodes(found), "odd-nodes")
    sketches = nodes.select("node", "sketch")
    dealt = nodes.select("node", "size", F.explode("bands").alias("band"))
    first = F.min(F.struct(F.xxhash64("node", "band").alias("r"), F.col("node"), F.col("size")))
    stars = dealt.groupBy("band").agg(first.alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = stored(stars.select("band", F.col("s.node").alias("star"), F.col("s.size").alias("star_size")), "band-stars")
    held = stored(dealt.join(stars, "band"), "held-bands")  # the nodes that meet others
    pairs = held.where((F.col("node") != F.col("star")) & _compatible("size", "star_size")).select(
        F.col("node").alias("x"), F.col("star").alias("y")).distinct()
    pairs = stored(_with_sketches(pairs, sketches), "star-pairs")
    wanted = nodes.join(held.select("node").distinct(), "node", "left_semi").select("row")
    sets = stored(_sets(rows, wanted, seed), "odd-sets")
    nearest = pairs.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
    confirmed = stored(confirm(nearest, sets), "odd-links")
    held = held.select("band", "node")
    for more in (_central_pairs, _all_pairs):
        near = stored(_with_sketches(more(_first_keys(held, confirmed, sets)), sketches), "open-pairs")
        confirmed = confirmed.unionByName(stored(confirm(near, sets), "odd-links"))
    return found, confirmed


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its smallest doc_id), kept (it is that one)."""
    found, edges = links(docs)
    rows = found.select("doc_id", "size", "node")
    root = F.coalesce("root", "node")
    real = stored(rows.where("size > 0").join(components(edges), "node", "left").select("doc_id", "size", root.alias("root")), "odd-roots")
    least = stored(real.groupBy("root").agg(F.min("doc_id").alias("component_id")), "odd-ids")
    own = real.join(least, "root").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    none = rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = own.unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
