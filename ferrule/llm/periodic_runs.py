"""Runs (maximal repetitions) of words, from Lyndon arrays built by grouping suffixes.

A run is a stretch of words with smallest period q and length >= 2 q that no neighbour extends.  In
one of the two orders of the alphabet (the ordinary one and its reverse) every run holds a Lyndon
root: a position whose longest Lyndon word has length q.  So:

1. ``lyndon`` gives the longest Lyndon word at every position as phase one of Baier's suffix sorter
   does: suffixes stand in groups by a common prefix, at first one word; groups are taken from
   the highest down; every suffix of a group points to the nearest earlier one of a lower
   group, whose prefix grows by the group's as often as it is pointed to, and which moves to a
   group of its own just above.  A suffix's prefix when its group is taken is its Lyndon word.
2. Every (position, Lyndon length) of both orders is extended to both sides by longest common
   extensions; what reaches twice its period is a run.  Extensions are exact: ranks of all stretches
   of 2^k words, compared from the longest down.

Which positions can belong to a run of ``shortest`` words is known beforehand: such a run repeats
at least ``shortest - shortest // 2`` words in a row, so all its words lie in sequences of that many
words that come twice in the document.  ``suspects`` keeps the stretches made of those (it may keep
more, never less), and the two steps run on them: a run of the document is one of a stretch.

Words are maximal runs of other characters than [\\x20\\x09-\\x0D], and case counts.  Documents are
independent rows; no shuffle.

Cases: null and empty texts have no words, no runs and an empty collapsed text; ids may be null or
repeat, a row each; a very long text is one row and takes memory in proportion to its words (times
the logarithm of its longest repeat); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import ship, text_or_empty
from ferrule.llm.words import mix

SHORTEST = 12
BATCH = 1 << 21  # bytes of text handled at a time
SLOTS = 22       # log2 of the counters that sift repeated sequences of words
RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon(seq: list[int]) -> list[int]:
    """The length of the longest Lyndon word at every position."""
    n = len(seq)
    values = sorted(set(seq))
    place = {v: g for g, v in enumerate(values)}
    group = [place[v] for v in seq]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    prefix = [1] * len(values)
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    above[-1:] = [-1]
    taken = bytearray(len(values))
    before, out = [-1] * n, [0] * n
    g = len(values) - 1
    while g >= 0:
        taken[g] = 1
        length = prefix[g]
        moves: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue  # has moved up since
            out[i] = length
            j = i - 1
            while j >= 0 and taken[group[j]]:
                j = before[j]
            before[i] = j
            if j != last:
                if last >= 0:
                    moves.setdefault((group[last], times), []).append(last)
                last, times = j, 1
            else:
                times += 1
        if last >= 0:
            moves.setdefault((group[last], times), []).append(last)
        for h, times in sorted(moves, key=lambda x: -x[1]):  # the more often, the higher
            new, up = len(prefix), above[h]
            prefix.append(prefix[h] + times * length)
            members.append(moves[h, times])
            taken.append(0)
            below.append(h)
            above.append(up)
            above[h] = new
            if up >= 0:
                below[up] = new
            for j in moves[h, times]:
                group[j] = new
        g = below[g]
    return out


def _ranks(seq: np.ndarray) -> list[np.ndarray]:
    """Level k: equal numbers for equal stretches of 2^k words; as far as any such stretch repeats."""
    _, rank, n = np.unique(seq, return_inverse=True, return_counts=True)
    out = [rank.astype(np.int32)]
    while n.max(initial=1) > 1 and 2 << len(out) - 1 <= len(seq):
        half = 1 << len(out) - 1
        last = out[-1].astype(np.int64)
        _, rank, n = np.unique(last[:-half] * len(seq) + last[half:], return_inverse=True, return_counts=True)
        out.append(rank.astype(np.int32))
    return out


def _extend(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool) -> np.ndarray:
    """How many words agree from a and b on to the right, or to the left of a and b (a < b)."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << k, ranks[k]
        while True:  # a stretch longer than the levels is compared more than once on the highest
            x, y = (a - got - size, b - got - size) if left else (a + got, b + got)
            able = np.flatnonzero((x >= 0) if left else (y < len(rank)))
            same = able[rank[x[able]] == rank[y[able]]]
            got[same] += size
            if k < len(ranks) - 1 or not len(same):
                break
    return got


def runs(seq: np.ndarray, edges: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``shortest`` words or more of the stretches
    ``edges[i]:edges[i + 1]`` of ``seq``, in order."""
    if len(edges) < 2:
        return np.zeros((0, 3), np.int64)
    # a word of its own after every stretch, so that nothing extends across
    stretch = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    at = np.arange(len(seq)) + stretch
    apart = np.full(len(seq) + len(edges) - 1, -1, np.int64)
    apart[at] = seq
    gaps = np.flatnonzero(apart < 0)
    apart[gaps] = int(seq.max(initial=0)) + 1 + np.arange(len(gaps))
    first, period = [], []
    for sign in (1, -1):
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            period.append(np.array(lyndon((sign * seq[a:b]).tolist()), np.int64))
        first.append(at)
    i, q = np.divmod(np.unique(np.concatenate(first) * len(apart) + np.concatenate(period)), len(apart))
    ranks = _ranks(apart)
    start = i - _extend(ranks, i, i + q, True)
    end = i + q + _extend(ranks, i, i + q, False)
    some = (end - start >= 2 * q) & (end - start >= shortest)
    found = np.unique(np.stack([start, end, q], 1)[some], axis=0)
    before = np.searchsorted(gaps, found[:, 0])  # separators in front of it
    return found - np.stack([before, before, np.zeros_like(before)], 1)


def suspects(seq: np.ndarray, edges: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches whose words all lie in sequences of ``shortest - shortest // 2``
    words that come twice in the same stretch of ``edges``."""
    size = shortest - shortest // 2
    start, end = edges[:-1], edges[1:]
    for _ in range(3):
        keep = end - start >= shortest
        start, end = start[keep], end[keep]
        if not len(start):
            break
        length = end - start
        owner = np.repeat(np.arange(len(start)), length)
        at = np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)
        whole = at + size <= end[owner]
        at, owner = at[whole], owner[whole]
        h = mix(owner.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + seq[at + j].astype(np.uint64)
        h = mix(h)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        many = np.bincount(slot)[slot] > 1
        at, h = at[many], h[many]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = at[twice]
        cover = np.zeros(len(seq) + 1, np.int64)
        cover[at] += 1
        cover[at + size] -= 1
        inside = np.cumsum(cover[:-1]) > 0
        turn = np.diff(inside.astype(np.int8), prepend=0, append=0)
        cut = np.zeros(len(seq) + 1, bool)
        cut[start] = cut[end] = True
        cut[:-1] &= inside
        cut[1:] &= inside
        cut[0] = cut[-1] = False
        new_start, new_end = np.flatnonzero((turn > 0) | cut), np.flatnonzero((turn < 0) | cut)
        if len(new_start) == len(start) and (new_start == start).all() and (new_end == end).all():
            break
        start, end = new_start, new_end
    keep = end - start >= shortest
    return start[keep], end[keep]


def document_runs(words: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """Rows (start, end, period) of the runs of each list of words."""
    number: dict[bytes, int] = {}
    seq = np.array([number.setdefault(w, len(number)) for doc in words for w in doc], np.int64)
    first = np.concatenate([[0], np.cumsum([len(doc) for doc in words], dtype=np.int64)])
    start, end = suspects(seq, first, shortest)
    length = end - start
    edges = np.concatenate([[0], np.cumsum(length)])
    shift = start - edges[:-1]
    part = seq[np.arange(edges[-1]) + np.repeat(shift, length)]
    found = runs(part, edges, shortest)
    found[:, :2] += shift[np.searchsorted(edges, found[:, 0], "right") - 1][:, None]
    owner = np.searchsorted(first, found[:, 0], "right") - 1
    found[:, :2] -= first[owner][:, None]
    at = np.searchsorted(owner, np.arange(len(words) + 1))
    return [found[a:b][np.lexsort((found[a:b, 2], found[a:b, 0]))] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _collapsed(words: list[bytes], found: np.ndarray) -> str:
    """The words but those that a run repeats, joined by one space."""
    if len(found):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, found[:, 0] + found[:, 2], 1)
        np.add.at(depth, found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period by start, then period) and
    collapsed: the text without the words that a run holds after its first period."""

    def handle(ids: list, raw: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in raw]
        found = document_runs(words, shortest)
        spans = [[{"start": s, "length": e - s, "period": q} for s, e, q in f.tolist()] for f in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
             pa.array([_collapsed(w, f) for w, f in zip(words, found)], pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, raw, held = [], [], 0
            for at in range(part.num_rows):
                t = part.column(1)[at].as_py().encode()
                ids.append(part.column(0)[at].as_py())
                raw.append(t)
                held += len(t)
                if held >= BATCH:
                    yield handle(ids, raw)
                    ids, raw, held = [], [], 0
            if ids:
                yield handle(ids, raw)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(batches, f"doc_id long, n_words long, {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: the text of every tenth id (by crc32 of the decimal id; a null id counts as empty
    text) repeats a stretch of its words periodically from some word on, joined by one space."""
    g = F.floor(F.col("h") / 10)
    every = F.floor((F.col("n") - F.col("a")) / (3 + g % 8)) + 1
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("every")).cast("int"))))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text"),
                       F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("h"))
    tenth = rows.where("h % 10 = 0").select("doc_id", "h", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    tenth = (tenth.withColumn("n", F.size("words")).withColumn("a", g % F.greatest("n", F.lit(1)))
             .withColumn("every", every).select("doc_id", F.array_join(moved, " ").alias("text")))
    return rows.where("h % 10 <> 0").select("doc_id", "text").unionByName(tenth)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and
    of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("s"), r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"),
        (-F.col("longest.m")).alias("length"), F.col("longest.q").alias("period"),
        F.floor(-1000 * F.col("longest.m") / F.col("longest.q")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
