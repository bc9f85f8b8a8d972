"""Exact n-gram Jaccard join in a metric space of shingle sets.

One minus the Jaccard similarity of two sets is a metric.  Documents are joined where it is at most
0.25 (100 * intersection >= 75 * union, in integers).

1. A text's distinct five-word shingles are its set; equal sets are one point from there on.
2. Shingles have one order (those frequent in the corpus last).  Two linked sets share a shingle
   among the first n - ceil(0.75 n) + 1 of each.  The points that hold a shingle there form a cell;
   the cell's first point by a hash is its pivot, and the points of all cells of a pivot are its
   region.  A point on the border of several regions is replicated into each, and every linked pair
   meets in some region.
3. Among its first half a set shares at least a bounded number of shingles with any linked
   set; points that share fewer with all others together, and points that no other one of their
   region is near to in size, leave it before whole sets are read.
4. A region is joined by pivots: exact distances to a few pivots give Voronoi cells; a point goes to
   its nearest pivot and, by the triangle inequality, to every other that is at most 2 * 0.25
   farther; the parts are joined in the same way until they are small or have no open pair.  Regions
   with many points first go through rounds of a distributed star join on one pivot: the points
   linked to the pivot are connected, and only those that an unlinked point can still reach
   (triangle inequality) stay; what is still large is dealt into blocks that are joined two by two.
5. Links give components; all points of a set share its component.

Only links that connect are emitted, never the pairs of a group.

Cases: null and empty texts, and texts without words, have no shingles and are linked with
nothing; texts of one to four words have one shingle, the whole sequence; repeated rows and ids are
rows with equal sets; a null doc_id takes the smallest id of its component; empty tables give no
rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import discard, give_back, keep_once, ship, stored, text_or_empty
from ferrule.llm.words import Words, buffers, mix

WORDS = 5
FREQUENT = 32            # a shingle that so many texts have among their first ones goes last
HINTS = 1 << 18          # at most so many shingles are moved (an order, never a limit on results)
LAST = np.int64(1 << 61)  # added to the key of a shingle that goes last
SMALL = 24               # points compared one by one
LARGE = 4096             # points of a region that one task joins
PER_BUCKET = 1_000_000   # shingles that a bucket of the key space stands for
SLICE = 4 << 20          # text bytes that a task handles at a time (a longer text is a slice)
ROWS = 1500              # and rows
LEAST_BUCKETS = 64


def shingles(texts: list[bytes], seed: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct 61-bit shingle hashes of each text."""
    step = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(WORDS)]
    salt = np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for _, run in buffers(texts):
        w = Words(run)
        h = w.hashes() + salt
        n = max(len(h) - WORDS + 1, 0)
        five = np.zeros(n, np.uint64)
        for j in range(WORDS):
            five += h[j:n + j] * step[j]
        five = (mix(five) >> np.uint64(3)).astype(np.int64)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= WORDS:
                yield np.unique(five[a:b - WORDS + 1])
            elif b > a:
                one = (h[a:b] * np.array(step[:b - a])).sum(dtype=np.uint64) + np.uint64(b - a)
                yield (mix(np.array([one])) >> np.uint64(3)).astype(np.int64)
            else:
                yield np.zeros(0, np.int64)


def first_ones(n: int) -> int:
    """How many first shingles of a set of n: every linked set shares one among its own first ones."""
    return n - (3 * n + 3) // 4 + 1


def shown(n: int) -> int:
    """How many first shingles are looked at for the number of shared ones."""
    return max(first_ones(n), -(-n // 2))


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many of its ``shown`` shingles a set of n shares at least with any linked set.

    Up to the smaller of two last keys, x and y, both sets are known: they differ there by at most
    (|x| + |y|) / 7, so the one whose last key it is shares all but that many.  The bound is least
    for the smallest and the largest set that may be linked."""
    out = []
    for size in n.tolist():
        low, high = -(-3 * size // 4), 4 * size // 3
        out.append(max(1, min(shown(size) - (size + high) // 7, shown(low) - (size + low) // 7)))
    return np.array(out, np.int64)


def digest(keys: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    k = keys.astype(np.uint64)
    a, b = mix(k + np.uint64(0x632BE59BD9B4E019)), mix(k ^ np.uint64(0xA0761D6478BD642F))
    size = np.uint64(len(k))
    return tuple(int(mix(np.array([x.sum(dtype=np.uint64) + size])).view(np.int64)[0]) for x in (a, b))


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in column.to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


# ---- sets, cells, regions ----

def _survey(rows: DataFrame, seed: int) -> DataFrame:
    """doc_id, size, node and second digest of the set, hash of the text."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            size, d = [], []
            for keys in shingles(_encoded(part.column(1)), seed):
                size.append(len(keys))
                d.append(digest(keys))
            d = np.array(d, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(size, np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()),
                 part.column(2)], names=["doc_id", "size", "node", "other", "h"])

    return rows.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        batches, "doc_id long, size long, node long, other long, h long")


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, by bytes of text and rows: what a task holds at a time."""
    give_back()
    for part in parts:
        size = np.cumsum(np.maximum(pc.binary_length(part.column("text")).to_numpy(), SLICE // ROWS), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(size // SLICE, prepend=-1)).tolist() if len(size) else []
        for a, b in zip(cuts, [*cuts[1:], part.num_rows]):
            yield part.slice(a, b - a)
    give_back()


def _packed(bucket: np.ndarray, buckets: int, keys: np.ndarray, values: np.ndarray, nodes: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a bucket (``bucket`` ascending, keys ascending within it): the keys as differences, byte
    plane by byte plane, so that the shuffle's compression drops the planes of zeros; the values; and
    the nodes that values number, those of the row alone."""
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    some = [p for p in range(buckets) if edge[p] < edge[p + 1]]

    def planes(k: np.ndarray) -> bytes:
        return np.ascontiguousarray(np.diff(k, prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes()

    parts = [values[edge[p]:edge[p + 1]] for p in some]
    own = [None] * len(some)
    if nodes is not None:
        for i, v in enumerate(parts):
            here = np.flatnonzero(np.bincount(v, minlength=len(nodes)))
            place = np.zeros(len(nodes), np.uint16)
            place[here] = np.arange(len(here))
            parts[i], own[i] = place[v], nodes[here].tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(some, np.int32)), pa.array([planes(keys[edge[p]:edge[p + 1]]) for p in some], pa.binary()),
         pa.array([v.tobytes() for v in parts], pa.binary()), pa.array(own, pa.binary())],
        names=["bucket", "keys", "values", "nodes"])


PACKED = "bucket int, keys binary, values binary, nodes binary"


def _unpacked(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and values (or the nodes they number) of whole buckets (the rows come sorted by bucket)."""
    for _, rows in _grouped(parts):
        keys, values = [], []
        for k, v, nodes in zip(*(rows.column(c).to_pylist() for c in ("keys", "values", "nodes"))):
            d = np.ascontiguousarray(np.frombuffer(k, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
            keys.append(np.cumsum(d))
            v = np.frombuffer(v, np.uint16)
            values.append(v if nodes is None else np.frombuffer(nodes, np.int64)[v])
        del rows
        yield np.concatenate(keys), np.concatenate(values)
        give_back()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the key space, so sorted keys are sorted by bucket."""
    return ((keys >> 31) * buckets >> 30).astype(np.int32)


def _in_buckets(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _frequent(rows: DataFrame, seed: int, buckets: int) -> np.ndarray:
    """Sorted shingles that go last: counted over the first ones of all texts, copies of a batch once."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            firsts = [s[:shown(len(s))] for s in shingles(_distinct(part.column(0)), seed) if len(s)]
            if firsts:
                keys, n = np.unique(np.concatenate(firsts), return_counts=True)
                yield _packed(_bucket(keys, buckets), buckets, keys, np.minimum(n, 65535).astype(np.uint16))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _unpacked(parts):
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            total = np.add.reduceat(n, first)
            many = total >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(keys[first][many]), pa.array(total[many])], names=["key", "n"])

    counted = _in_buckets(rows.select("text").mapInArrow(count, PACKED), buckets).mapInArrow(add, "key long, n long")
    top = counted.orderBy(F.desc("n"), "key").limit(HINTS).select("key").toPandas()
    return np.sort(top["key"].to_numpy(np.int64))


def _distinct(column: pa.Array) -> list[bytes]:
    return _encoded(column.unique())


def _ordered(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    if len(last) and len(keys):
        at = np.minimum(np.searchsorted(last, keys), len(last) - 1)
        moved = last[at] == keys
        if moved.any():
            return np.concatenate([keys[~moved], keys[moved] + LAST])
    return keys


def _sets(rows: DataFrame, seed: int, only: np.ndarray) -> DataFrame:
    """node, size, keys: the whole sets of the nodes that the bits ``only`` let through."""
    sent = rows.sparkSession.sparkContext.broadcast(only)  # BITS bits

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            node, size, out, held = [], [], [], 0
            for keys in shingles(_distinct(part.column(0)), seed):
                name = digest(keys)[0] if len(keys) else 0
                if not len(keys) or not _let_through(sent.value, np.array([name]))[0]:
                    continue
                node.append(name)
                size.append(len(keys))
                out.append(keys)
                held += len(keys)
                if held > 1_000_000:
                    yield _batch(node, size, out)
                    node, size, out, held = [], [], [], 0
            if out:
                yield _batch(node, size, out)

    return rows.select("text").mapInArrow(batches, "node long, size long, keys array<long>")


def _batch(node: list[int], size: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(node, np.int64)), pa.array(np.array(size, np.int64)), _lists(keys)],
                                      names=["node", "size", "keys"])


BITS = 1 << 24


def _bits_of(nodes: DataFrame) -> np.ndarray:
    """A bit for every node (by its hash): lets all of them through, and few others.  2 MB at most."""
    words = nodes.selectExpr(f"cast(shiftright(pmod(node, {BITS}), 6) AS int) AS w",
                             "shiftleft(1L, cast(pmod(node, 64) AS int)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out


def _let_through(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = nodes % BITS
    return (bits[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _cells(rows: DataFrame, seed: int, last: np.ndarray, buckets: int) -> DataFrame:
    """Three kinds of rows.  0: (pivot, node, shared): a point of a region, and how many of its shown
    shingles others have in this bucket.  1: (key, node, 0): a point that holds a shingle that goes
    last among its first ones.  2: (0, node, shared): its shown shingles that go last, which all
    count as shared."""
    sent = rows.sparkSession.sparkContext.broadcast(last)  # at most HINTS numbers

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            keys, nodes = [], []
            for s in shingles(_distinct(part.column(0)), seed):
                if len(s):
                    k = _ordered(s, sent.value)[:shown(len(s))] * 2
                    k[first_ones(len(s)):] += 1  # odd: shown, but not among the first ones
                    keys.append(k)
                    nodes.append(digest(s)[0])
            if keys:
                at = np.repeat(np.arange(len(keys), dtype=np.uint16), list(map(len, keys)))
                keys, nodes = np.concatenate(keys), np.array(nodes, np.int64)
                bucket = np.where(keys < 2 * int(LAST), _bucket(keys >> 1, buckets), _bucket(nodes >> 2 & (LAST - 1), buckets)[at])
                order = np.lexsort((keys, bucket))
                yield _packed(bucket[order], buckets, keys[order], at[order], nodes)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, node in _unpacked(parts):
            rare = keys < 2 * int(LAST)
            last_keys, last_node = keys[~rare], node[~rare]
            keys, node = keys[rare], node[rare]
            order = np.lexsort((mix(node.view(np.uint64)), keys >> 1))
            keys, node = keys[order], node[order]
            first = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
            cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            ends = np.append(first[1:], len(keys)) - 1
            many = (node[first] != node[ends])[cell]  # copies are neighbours in a cell
            new = np.ones(len(keys), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
            one = many & new
            yield _three(2, np.zeros(int(one.sum()), np.int64), node[one])
            # regions: the points that have the shingle among their first ones
            keys, node, cell = keys[one], node[one], cell[one]
            own = keys & 1 == 0
            node, cell = node[own], cell[own]
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            length = np.diff(np.append(start, len(cell)))
            pivot = np.repeat(node[start], length)
            two = np.repeat(length > 1, length)
            yield _three(0, pivot[two], node[two])
            own = last_keys & 1 == 0
            yield _three(1, last_keys[own], last_node[own])
            yield _three(2, np.zeros(len(last_node), np.int64), last_node)

    dealt = rows.select("text").mapInArrow(deal, PACKED)
    return _in_buckets(dealt, buckets).mapInArrow(meet, "kind int, a long, node long, shared long")


def _three(kind: int, a: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Distinct (a, node) with how often each comes."""
    order = np.lexsort((node, a))
    a, node = a[order], node[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(a)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(a[at]), pa.array(node[at]),
                                       pa.array(n.astype(np.int64))], names=["kind", "a", "node", "shared"])


def _members(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(pivot, node): the points of every region that share enough shingles for any link, where
    another one of the region has a size that allows one."""
    size = points.where("size > 0").groupBy("node").agg(F.first("size").alias("size"))
    need = size.mapInArrow(_needed, "node long, size long, need long")
    shared = cells.where("kind = 2").groupBy("node").agg(F.sum("shared").alias("shared"))
    able = stored(need.join(shared, "node").where("shared >= need").select("node", "size"), "able-points")
    # cells of shingles that go last may be large: counted and joined by Spark, which can split them
    held = cells.where("kind = 1").select(F.col("a").alias("key"), "node").join(able.select("node"), "node", "left_semi").distinct()
    large = (held.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("r"), F.col("node"))).alias("p"),
                                     F.min("node").alias("l"), F.max("node").alias("h"))
             .where("l <> h").select("key", F.col("p.node").alias("pivot")))
    # buckets have a pair several times; dealt by node once for both its distinct pairs and the join
    pairs = cells.where("kind = 0").select(F.col("a").alias("pivot"), "node").repartition("node").distinct()
    members = (pairs.join(able.select("node"), "node", "left_semi")
               .unionByName(held.join(large, "key").select("pivot", "node")).distinct())
    # sizes that differ by at most a third are in the same or in neighbouring classes
    sized = members.join(able, "node").withColumn("sizes", F.floor(F.log(F.col("size")) / float(np.log(1.34))).cast("int"))
    count = sized.groupBy("pivot", "sizes").agg(F.count(F.lit(1)).alias("n"))
    reach = F.explode(F.array(F.col("sizes") - 1, F.col("sizes"), F.col("sizes") + 1))
    near = count.select("pivot", reach.alias("sizes"), "n").groupBy("pivot", "sizes").agg(F.sum("n").alias("n"))
    return sized.join(near.where("n > 1"), ["pivot", "sizes"]).select("pivot", "node")


def _needed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least_shared(part.column(1).to_numpy()))],
                                         names=["node", "size", "need"])


def _grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal first column over batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        key = part.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _points(region: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct nodes, sizes and key arrays of a region."""
    node = region.column("node").to_numpy()
    _, one = np.unique(node, return_index=True)
    keys = region.column("keys").combine_chunks()
    offsets, values = keys.offsets.to_numpy(), keys.values.to_numpy()
    return node[one], region.column("size").to_numpy()[one], [values[offsets[i]:offsets[i + 1]] for i in one.tolist()]


# ---- joining a region ----

class Join:
    """Exact links of a region's points that connect them, by recursive Voronoi cells."""

    def __init__(self, size: np.ndarray, sets: list[np.ndarray]):
        self.size, self.sets = size, sets
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def _link(self, x: int, y: int) -> None:
        a, b = self._root(x), self._root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def _shared(self, p: int, points: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with those of the points."""
        sets = [self.sets[i] for i in points.tolist()]
        every = np.concatenate(sets)
        mine = self.sets[p]
        hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
        ends = np.cumsum(list(map(len, sets)))
        sums = np.concatenate([[0], np.cumsum(hit)])
        return sums[ends] - sums[ends - np.array(list(map(len, sets)))]

    def _try(self, p: int, points: np.ndarray) -> np.ndarray:
        """Distances from p, linking what is near."""
        shared, both = self._shared(p, points), self.size[p] + self.size[points]
        for y in points[7 * shared >= 3 * both].tolist():
            if y != p:
                self._link(p, y)
        return 1 - shared / (both - shared)

    def run(self, points: np.ndarray) -> list[tuple[int, int]]:
        work = [points]
        while work:
            pts = work.pop()
            if len(pts) < 2 or len({self._root(i) for i in pts.tolist()}) == 1:
                continue  # no open pair
            if len(pts) <= SMALL:
                self._one_by_one(pts)
                continue
            pivots = pts[np.linspace(0, len(pts) - 1, 8).astype(int)]
            dist = np.stack([self._try(p, pts) for p in pivots.tolist()])
            nearest = dist.argmin(0)
            parts = []
            for j in range(len(pivots)):
                inside = dist[j] <= dist.min(0) + 0.5 + 1e-9
                if (nearest == j).any():
                    parts.append(pts[inside])
            if sum(map(len, parts)) > 1.5 * len(pts) or max(map(len, parts)) > 0.9 * len(pts):
                self._by_first_ones(pts)  # about equally far from all: pivots do not part them
            else:
                work += parts
        return self.links

    def _by_first_ones(self, pts: np.ndarray) -> None:
        """Points against those that share one of their first shingles, rare ones of this part first."""
        length = np.array([len(self.sets[i]) for i in pts.tolist()])
        own = np.repeat(np.arange(len(pts)), length)
        _, name, count = np.unique(np.concatenate([self.sets[i] for i in pts.tolist()]), return_inverse=True, return_counts=True)
        order = np.lexsort((name, count[name], own))
        place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
        use = (place < np.repeat([first_ones(n) for n in length.tolist()], length)) & (count[name[order]] > 1)
        name, own = name[order][use], own[use]  # own was in order already
        by_name = np.argsort(name, kind="stable")
        holder, sorted_name = own[by_name], name[by_name]
        size = self.size[pts]
        edge = np.searchsorted(own, np.arange(len(pts) + 1))
        for p in range(len(pts)):
            mine = name[edge[p]:edge[p + 1]]
            if not len(mine):
                continue
            low, high = np.searchsorted(sorted_name, mine), np.searchsorted(sorted_name, mine, "right")
            near = np.unique(np.concatenate([holder[a:b] for a, b in zip(low.tolist(), high.tolist())]))
            near = near[near > p]
            near = near[4 * np.minimum(size[near], size[p]) >= 3 * np.maximum(size[near], size[p])]
            root = self._root(int(pts[p]))
            rest = [y for y in pts[near].tolist() if self._root(y) != root]
            if rest:
                self._try(int(pts[p]), np.array(rest))

    def _one_by_one(self, pts: np.ndarray) -> None:
        """Points in order of size, each against the later ones whose size allows a link and that
        it is not connected to yet."""
        pts = pts[np.argsort(self.size[pts], kind="stable")]
        size = self.size[pts]
        for k, p in enumerate(pts.tolist()):
            end = int(np.searchsorted(size, 4 * size[k] // 3, "right"))
            root = self._root(p)
            rest = [y for y in pts[k + 1:end].tolist() if self._root(y) != root]
            if rest:
                self._try(p, np.array(rest))


def _links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, region in _grouped(parts):
        node, size, keys = _points(region)
        found = Join(size, keys).run(np.arange(len(node))) if len(node) > 1 else []
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["x", "y"])


def _by_region(rows: DataFrame) -> DataFrame:
    return rows.select("pivot", "node", "size", "keys").repartition("pivot").sortWithinPartitions("pivot")


def _distance(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pivot, node, p, shared, both: sizes of the intersection and of both sets together."""
    for part in parts:
        size, psize = part.column("size").to_numpy(), part.column("psize").to_numpy()
        shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in
                  zip(map(np.asarray, part.column("keys").to_pylist()), map(np.asarray, part.column("pkeys").to_pylist()))]
        yield pa.RecordBatch.from_arrays(
            [part.column("pivot"), part.column("node"), part.column("p"), pa.array(np.array(shared, np.int64)),
             pa.array(size + psize)], names=["pivot", "node", "p", "shared", "both"])


def _star_rounds(members: DataFrame, sets: DataFrame, rounds: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """Regions of more than LARGE points: a round compares one pivot with all points of its region,
    spread over tasks whatever their region, and drops the pivot and the linked points that no
    unlinked one can reach.  What is still large then is dealt into blocks, and every two blocks make
    a region of their own.  Returns the members, at most about LARGE a region, and the links found."""
    found = []
    for _ in range(rounds):
        first = F.min(F.struct(F.xxhash64("node").alias("r"), F.col("node")))
        n = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), first.alias("h"))
        big = stored(n.where(F.col("n") > LARGE).select("pivot", F.col("h.node").alias("p")), "big-regions")
        if big.isEmpty():
            return members, found
        pivots = big.join(sets.select(F.col("node").alias("p"), F.col("size").alias("psize"), F.col("keys").alias("pkeys")), "p")
        rows = members.join(sets, "node").join(pivots, "pivot")
        dist = stored(rows.select("pivot", "node", "size", "keys", "p", "psize", "pkeys").mapInArrow(
            _distance, "pivot long, node long, p long, shared long, both long"), "star-distances")
        dist = dist.where("node <> p").withColumn("linked", 7 * F.col("shared") >= 3 * F.col("both")).withColumn(
            "d", 1 - F.col("shared") / (F.col("both") - F.col("shared")))
        found.append(dist.where("linked").select(F.col("p").alias("x"), F.col("node").alias("y")))
        edge = dist.where("NOT linked").groupBy("pivot").agg(F.min("d").alias("least"))  # a row a region
        left = dist.join(edge, "pivot").where("NOT linked OR d >= least - 0.25 - 1e-9").select("pivot", "node")
        members = stored(members.join(big.select("pivot"), "pivot", "left_anti").unionByName(left), "regions-left")
    n = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
    blocks = members.join(n.withColumn("k", F.ceil(2 * F.col("n") / LARGE).cast("int")), "pivot")
    mine = F.pmod(F.xxhash64("node", F.lit(11)), F.col("k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = blocks.select("pivot", "node", mine.alias("i"), other.alias("j")).select(
        F.xxhash64("pivot", F.least("i", "j"), F.greatest("i", "j")).alias("pivot"), "node")
    return members.join(n.select("pivot"), "pivot", "left_anti").unionByName(dealt), found


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, size, node, h; links between nodes: x, y).  Copies share a node."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seed = 0
    while True:
        points = stored(_survey(rows, seed), "shingle-survey")
        clash = points.where("size > 0").groupBy("node").agg(F.min("other").alias("l"), F.max("other").alias("h"))
        if clash.where("l <> h").isEmpty():
            break
        seed += 1  # two sets with the same 64-bit digest: other hashes
    total = points.agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // PER_BUCKET))
    last = _frequent(rows, seed, buckets)
    cells = stored(_cells(rows, seed, last, buckets), "cells")
    members = stored(_members(cells, points), "regions")
    discard(cells)
    sets = stored(_sets(rows, seed, _bits_of(members)).dropDuplicates(["node"]), "whole-sets")
    members, found = _star_rounds(members, sets)
    rest = _by_region(members.select("pivot", "node").join(sets, "node")).mapInArrow(_links, "x long, y long")
    for more in found:
        rest = rest.unionByName(more)
    return points, stored(rest, "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component): alternately each node's larger neighbours and
    its smaller ones are tied to its least neighbour until nothing changes."""
    pairs = stored(edges.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "pairs")
    while True:
        both = pairs.select("hi", "lo").unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("v"), F.least("hi", "m").alias("m"))
        large = (both.join(least, both["hi"] == least["v"]).where("lo > v").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        small_m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(small_m, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
                 .select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo")).where("hi <> lo").distinct())
        after = stored(small, "pairs")
        if after.count() == pairs.count() and after.exceptAll(pairs).isEmpty():
            return after.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
        pairs = after


def resolve(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, h (hash of the text)."""
    points, edges = links(docs)
    real = points.where("size > 0").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stored(real.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    own = real.join(least, "root").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "h")
    none = points.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), "h")
    return own.unionByName(none)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return resolve(docs).drop("h")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, of each component only the one with the smallest id; of
    rows with the same id and text one."""
    found = resolve(docs)
    return keep_once(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h"))
