"""Balanced shards by sampled splitters, DataFrame functions only.

Records are ordered by (hash of the text, doc_id).  A sample in which a record appears with
probability proportional to its size gives quantile boundaries; the records are range-partitioned
by them, and exact byte and row offsets of the ranges turn each record's place inside its range
into its place in the whole order.  The whole order is cut into shards of near-equal bytes.

Equal texts are neighbours in the order.  A group of equal texts smaller than a range goes to one
shard whole; a heavier one fills several boundaries of the sample, is subdivided by doc_id along
them, and its rows are dealt one by one.  Ranges that the exact counts show overfull, in
bytes or in records, are cut again by finer boundaries until none is; a group cut there that is lighter
than a range still goes to one shard.  Records with many copies are unfolded in chunks spread over tasks.
So no task depends on the size of a group.  Texts are read once; only ids, hashes and sizes are shuffled.

Cases: a null text has size 1 and counts as empty; null ids come first within their group;
repeated rows are separate records (rows that agree in id and text are counted before the sort and
unfolded after it); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import stored, text_or_empty

RANGES = 1024         # ranges that the order is dealt into
PER_RANGE = 32        # sampled records a range (so at most about RANGES * PER_RANGE reach the driver)
OVERFULL = 4.0        # loads, of two a range on average (one in bytes, one in records), from which a range is cut again
LEAST_CUT = 1000      # records that a range may hold whatever its load
UNFOLD = 1 << 12      # copies of a record unfolded in one place
LEAST = -(1 << 63)


def records(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def splitters(rows: DataFrame, total: int, ranges: int = RANGES, per_range: int = PER_RANGE) -> list[tuple[int, int]]:
    """Ascending boundaries (hash, doc_id) of size-weighted quantiles.  A boundary inside a group
    that only one boundary falls into moves to the group's start, so that the group stays whole."""
    m = ranges * per_range
    u = F.pmod(F.xxhash64("h", "doc_id", F.lit("splitter")), F.lit(1 << 40)) / float(1 << 40)
    weight = F.col("w") * F.lit(float(m) / total)
    drawn = (rows.where(u < weight)
             .select("h", F.coalesce("doc_id", F.lit(LEAST)).alias("d"), F.greatest(weight, F.lit(1.0)).alias("x"))
             .collect())
    drawn = sorted((r.h, r.d, r.x) for r in drawn)
    whole, seen, cuts = sum(x for *_, x in drawn), 0.0, []
    for h, d, x in drawn:
        seen += x
        while len(cuts) < ranges - 1 and seen >= whole * (len(cuts) + 1) / ranges:
            cuts.append((h, d))
    heavy = {a[0] for a, b in zip(cuts, cuts[1:]) if a[0] == b[0]}
    return sorted({(h, d if h in heavy else LEAST) for h, d in cuts})


def _counted(rows: DataFrame, cuts: list[tuple[int, int]]) -> list:
    """Bytes, rows and records of each range (a row a range)."""
    sums = rows.withColumn("rng", _range_of(cuts)).groupBy("rng").agg(
        F.sum("w").alias("b"), F.sum("n").alias("c"), F.count(F.lit(1)).alias("k")).collect()
    return sorted(sums, key=lambda r: r.rng)


def _cut_again(rows: DataFrame, cuts: list[tuple[int, int]], sums: list, ranges: int) -> list[tuple[int, int]]:
    """``cuts`` and finer ones inside the ranges that are overfull."""
    total, records = sum(r.b for r in sums), sum(r.k for r in sums)
    full = {r.rng: r.b * ranges / total + r.k * ranges / records for r in sums}
    full = {r.rng: full[r.rng] for r in sums if r.k > LEAST_CUT and full[r.rng] > OVERFULL}
    if not full:
        return cuts
    load = F.col("w") * F.lit(ranges / total) + F.lit(ranges / records)
    u = F.pmod(F.xxhash64("h", "doc_id", F.lit(len(cuts))), F.lit(1 << 40)) / float(1 << 40)
    drawn: dict[int, list] = {}
    inside = rows.withColumn("rng", _range_of(cuts)).where(F.col("rng").isin(list(full)))
    for r in inside.where(u < load * PER_RANGE).select("rng", "h", F.coalesce("doc_id", F.lit(LEAST)).alias("d"),
                                                       F.greatest(load * PER_RANGE, F.lit(1.0)).alias("x")).collect():
        drawn.setdefault(r.rng, []).append((r.h, r.d, r.x))
    new = set(cuts)
    for rng, keys in drawn.items():
        keys.sort()
        pieces, whole, seen, k = int(full[rng]) + 1, sum(x for *_, x in keys), 0.0, 1
        for h, d, x in keys:
            seen += x
            while k < pieces and seen >= whole * k / pieces:
                new.add((h, d))
                k += 1
    return sorted(new)


def _range_of(cuts: list[tuple[int, int]]):
    """Native binary search: how many boundaries are at or below the record's key."""
    if not cuts:
        return F.lit(0)
    hs = "array(" + ",".join(_long(h) for h, _ in cuts) + ")"
    ds = "array(" + ",".join(_long(d) for _, d in cuts) + ")"
    steps = "array(" + ",".join(str(1 << k) for k in reversed(range(len(cuts).bit_length()))) + ")"
    key = "coalesce(doc_id, " + _long(LEAST) + ")"
    below = (f"(get({hs}, a + k - 1) < h OR (get({hs}, a + k - 1) = h AND get({ds}, a + k - 1) <= {key}))")
    return F.expr(f"aggregate({steps}, 0, (a, k) -> if(a + k <= {len(cuts)} AND {below}, a + k, a))")


def _long(x: int) -> str:
    return f"(-{1 << 62}L * 2L)" if x == LEAST else f"{x}L"


def shards(docs: DataFrame, n_shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard null."""
    spark = docs.sparkSession
    rows = stored(records(docs), "shard-records")
    # rows that agree in everything are one record of weight n * size until the end
    rows = rows.groupBy("h", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows.withColumn("w", F.col("n") * F.col("size")), "shard-weights")
    total = rows.agg(F.sum("w")).first()[0] or 0
    cuts = splitters(rows, total, ranges) if total else []
    heavy = sorted({h for h, d in cuts if d != LEAST})  # at most one hash a boundary
    sums = _counted(rows, cuts)
    while sums and (finer := _cut_again(rows, cuts, sums, ranges)) != cuts:
        cuts = finer
        sums = _counted(rows, cuts)
    cut = sorted({h for h, d in cuts if d != LEAST} - set(heavy))  # groups over several ranges that are not heavy
    dealt = rows.withColumn("rng", _range_of(cuts))
    starts, b, c = [], 0, 0
    for r in sums:
        starts.append((r.rng, b, c))
        b, c = b + r.b, c + r.c
    offsets = spark.createDataFrame(starts, "rng int, b0 long, c0 long")

    order = Window.partitionBy("rng").orderBy("h", "doc_id", "size")
    group = Window.partitionBy("rng", "h")
    placed = (dealt.join(F.broadcast(offsets), "rng")  # one row a range
              .withColumn("b1", F.sum("w").over(order) + F.col("b0"))
              .withColumn("c1", F.sum("n").over(order) + F.col("c0"))
              .withColumn("gw", F.sum("w").over(group))
              .withColumn("g0", F.min(F.col("b1") - F.col("w")).over(group)))
    placed = stored(placed, "shard-order")
    if cut:
        of_cut = placed.where(F.col("h").isin(cut)).groupBy("h").agg(
            F.sum("w").alias("gw_all"), F.min(F.col("b1") - F.col("w")).alias("g0_all"))
        placed = (placed.join(F.broadcast(of_cut), "h", "left")  # at most a row a boundary
                  .withColumn("gw", F.coalesce("gw_all", "gw")).withColumn("g0", F.coalesce("g0_all", "g0")))
    one_by_one = F.col("h").isin(heavy) | (F.col("n") * F.col("size") > F.lit(total // ranges)) if heavy else \
        F.col("w") > F.lit(total // ranges)
    # unfold; then the middle of a record (or of its whole group) says which shard it is in
    one = F.lit(1).cast("long")
    few = placed.where(F.col("n") <= UNFOLD).withColumn("i", F.explode(F.sequence(one, F.col("n"))))
    many = (placed.where(F.col("n") > UNFOLD)
            .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {UNFOLD}"))))
            .repartition("h", "doc_id", "chunk")
            .withColumn("i", F.explode(F.sequence(F.col("chunk") * UNFOLD + 1, F.least("n", (F.col("chunk") + 1) * UNFOLD))))
            .drop("chunk"))
    placed = (few.unionByName(many)
              .withColumn("rank", F.col("c1") - F.col("n") + F.col("i") - 1)
              .withColumn("twice", F.when(one_by_one, 2 * (F.col("b1") - F.col("w")) + (2 * F.col("i") - 1) * F.col("size"))
                          .otherwise(2 * F.col("g0") + F.col("gw")))
              .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(
                  F.col("twice").cast("decimal(38,0)") * F.lit(n_shards) / F.lit(max(1, 2 * total)).cast("decimal(38,0)")))
                  .cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", "rank"))
    placed = stored(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("rank").alias("r0"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("r0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """The documents themselves, one folder a shard (``shard=0`` ...), rows in slot order."""
    place = shards(docs, n_shards).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"),
                                          "shard", "slot")
    place = place.groupBy("__id", "__crc").agg(F.min(F.struct("shard", "slot")).alias("__at"))
    crc = F.crc32(text_or_empty().cast("binary"))
    (docs.join(place, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (crc == F.col("__crc")))
     .withColumn("shard", F.col("__at.shard")).withColumn("slot", F.col("__at.slot"))
     .drop("__id", "__crc", "__at").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
