"""Hierarchical Pitman-Yor language model over words.

Every context has a restaurant: customers are the training tokens seen after it, dishes are words,
and each table sends one customer to the parent restaurant, which all contexts share.  A context is
the previous word (its 64-bit hash), so there are as many as the texts have words.  The parent's own
base is non-atomic, as in species sampling: a new table there is a word never seen before, so the
mass of new tables is the probability of an unknown word.

Every (word, context) cell starts with one table.  A Gibbs sweep draws the number of tables of every
cell from its exact conditional law over all its customers (``tables.draw_tables``), given the tables of
its context, the customers of its word in the parent and the parent's total as they were before the
sweep: all cells are drawn at once (a synchronous sampler).  Cells of one customer always have one table
and only add to the sums.  The states after each of the last ``SAMPLES`` sweeps give the predictive
probability

    (c_gw - d t_gw + (theta + d T_g) P(w)) / (theta + c_g),   P(w) = (t_w - d1) / (theta1 + t)

averaged over the states; a text's score is the sum of log10 of it over its tokens.  The random number
of a cell and sweep is a hash of word, context and sweep: scores do not depend on how rows are dealt.

Data flow: tokens are dealt to buckets by their context, so that a bucket knows its contexts' totals
itself.  A context of ``HOT`` tokens and more is dealt by cell instead.  A bucket is one packed row: its
cells of several customers with their tables, and the sums of the others.  A sweep shuffles one number a
bucket and word (or hot context) to where they are added, and the totals back; then every bucket draws.
For the scores the texts' tokens are dealt once more by the same rule, and the sums over the tokens of
each text go back to its buffer.

Cases: null and empty texts are the end token alone; repeated rows are separate texts; a null
doc_id counts as the empty id; with no training rows every token is unknown with probability one;
an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import discard, ship, stored, text_or_empty
from ferrule.llm.tables import draw_tables
from ferrule.llm.words import Words, buffers, mix

DISCOUNT, STRENGTH = 0.8, 1.0      # of the context restaurants
ROOT_STRENGTH = 1.0                # of the parent; its discount is estimated from its customers
SWEEPS, SAMPLES = 4, 3            # Gibbs sweeps, states averaged
BUFFER = 8 << 20                   # text bytes dealt out at a time
TEXTS = 1 << 15                    # and texts at most
PER_BUCKET = 12 << 20              # text bytes a bucket of contexts stands for
LEAST_BUCKETS = 12
HOT = 1 << 20                      # tokens of a context that is dealt by cell
SHARES = 8                         # buckets whose words are added in one place
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = 0
_R = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)                # the lowest bit of a name: set for hot contexts, clear for words
_HIGH = np.uint64(0xFFFFFFFF00000000)

_DEALT = ("vocabulary", "words", "contexts", "runs", "trained", "counts", "docs")
_OWN = ("ids", "null_ids", "lengths")
DEALT = "bucket int, base long, n_docs int, " + ", ".join(f"{c} binary" for c in (*_DEALT, *_OWN))
SAMPLED = [f"t{s}" for s in range(SAMPLES)]
#: A bucket's names with their cells of one customer; its cells of several: key, name of the word,
#: context; its contexts: name if hot, cells of one customer; customers and tables of the cells.
_STATE = {"names": np.uint64, "alone": np.int64, "cell": np.uint64, "word": np.int32, "context": np.int32, "hot": np.int32,
          "alone_there": np.int64, "c": np.int64, "t": np.int64, **dict.fromkeys(SAMPLED, np.int64)}
ASCENDING = ("names", "cell")
STATE = "bucket int, " + ", ".join(f"{c} binary" for c in _STATE)
SENT = "share int, bucket int, names binary, sums binary"
TOTALS = "bucket int, share int, totals binary, stats array<long>"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, text, context) of every token, the end token last in its text."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    for at, run in buffers(texts):
        w = Words(run)
        n = np.diff(w.first)
        h = np.empty(len(w.start) + len(run), np.uint64)
        last = np.cumsum(n + 1) - 1
        is_word = np.ones(len(h), bool)
        is_word[last] = False
        h[is_word], h[last] = w.hashes(), END
        found.append((h, np.repeat(np.arange(at, at + len(run), dtype=np.int32), n + 1)))
    h, text = (np.concatenate(x) for x in zip(*found))
    context = np.empty(len(h), np.uint64)
    context[1:] = h[:-1]
    context[np.flatnonzero(np.diff(text, prepend=-1))] = BEGIN
    return h, text, context


def _key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(word * _R + mix(context))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _runs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in buffers of texts (column 1); so many short texts fill a buffer as well."""
    size = np.cumsum(np.maximum(pc.binary_length(part.column(1)).to_numpy(), BUFFER // TEXTS), dtype=np.int64)
    cuts = [0, *np.searchsorted(size, np.arange(BUFFER, size[-1] if len(size) else 0, BUFFER)).tolist(), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield part.slice(a, b - a)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _named(context: np.ndarray) -> np.ndarray:
    return mix(context + _R) | _ONE


def _is_in(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted ``some``."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def _hot(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted contexts of about ``HOT`` tokens and more: at most one for every HOT / 2 tokens.  What a
    buffer has too few of to add up to HOT / 2 over all buffers is not counted."""
    least = max(1, HOT * BUFFER // (2 * max(size, BUFFER)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for run in _runs(part):
                _, _, context = tokens([t.encode("utf-8") for t in run.column(1).to_pylist()])
                g, n = np.unique(context, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(g[n >= least]), pa.array(n[n >= least])], names=["g", "n"])

    counted = rows.select("doc_id", "text").mapInArrow(batches, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= HOT // 2).select("g").toPandas()
    return np.sort(found["g"].to_numpy(np.int64).view(np.uint64))


def _packed(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in columns],
                                      names=[c for c, _ in columns])


def _dense(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array byte plane by byte plane, compressed; ascending ones as differences."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else x
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _array(b: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of every value of the first column (they come sorted by it)."""
    key, held = None, []
    for part in parts:
        for i in range(part.num_rows):
            r = part.slice(i, 1).to_pylist()[0]
            k = r[part.schema.names[0]]
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(r)
    if held:
        yield key, held


def _deal(rows: DataFrame, buckets: int, hot: np.ndarray, whole: bool) -> DataFrame:
    """Cells by bucket: one row a bucket and buffer of texts, with words, contexts and training tokens;
    if ``whole``, also how often each cell comes and the text of every occurrence.  To be shuffled by
    bucket."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for part in parts:
            for run in _runs(part):
                yield _packed(DEALT, _dealt(run, base, buckets, hot, whole))
                base += run.num_rows

    return rows.mapInArrow(batches, DEALT)


def _dealt(part: pa.RecordBatch, base: int, buckets: int, hot: np.ndarray, whole: bool) -> list[dict]:
    h, doc, context = tokens([t.encode("utf-8") for t in part.column(1).to_pylist()])
    lengths = np.bincount(doc, minlength=part.num_rows).astype(np.int64)
    train = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
    cell = _key(h, context)
    slot = mix(context + _R)
    spread = _is_in(hot, context)
    slot[spread] = cell[spread]
    order = np.argsort((slot & _HIGH) | (cell >> np.uint64(32)))  # buckets are ranges of slots
    cell, doc = cell[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(first, len(cell))
    trained = np.add.reduceat(train[doc], first).astype(np.uint32)
    at = order[first]
    h, context, counts, docs = h[at], context[at], np.diff(ends).astype(np.uint32), doc.astype(np.uint16)
    edge = np.searchsorted(_bucket(slot[at], buckets), np.arange(buckets + 1))
    own = base // 7 % buckets  # the bucket that carries what is known of the texts themselves
    out = []
    for p, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        if a == b and not (whole and p == own):
            continue
        run = np.flatnonzero(np.concatenate([[True], context[a + 1:b] != context[a:b - 1]])) if b > a else np.zeros(0, np.int64)
        vocabulary, word = np.unique(h[a:b], return_inverse=True)
        row = {"bucket": p, "base": base, "n_docs": len(lengths), "vocabulary": _dense(vocabulary, True),
               "words": _dense(word.astype(np.uint32)), "contexts": context[a:b][run].tobytes(),
               "runs": _dense(np.diff(np.append(run, b - a)).astype(np.uint32)), "trained": _dense(trained[a:b])}
        if whole:
            row |= {"counts": _dense(counts[a:b]), "docs": _dense(docs[ends[a]:ends[b]])}
        if whole and p == own:
            ids = part.column(0)
            row |= {"ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), "lengths": lengths.tobytes(),
                    "null_ids": np.asarray(ids.is_null()).astype(np.uint8).tobytes()}
        out.append(row)
    return out


class Cells:
    """The cells of a bucket: key, word, context and customers, sorted by key; ``of`` numbers the cell
    of every entry of the dealt rows."""

    def __init__(self, rows: list[dict]):
        w, g, n = (np.concatenate(x) for x in zip(*(
            (_array(r["vocabulary"], np.uint64, True)[_array(r["words"], np.uint32)],
             np.repeat(np.frombuffer(r["contexts"], np.uint64), _array(r["runs"], np.uint32)),
             _array(r["trained"], np.uint32)) for r in rows)))
        key = _key(w, g)
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key[order]) != 0
        first = np.flatnonzero(new)
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.c = np.bincount(self.of, n, len(first)).astype(np.int64)
        self.key, self.word, self.context = key[order[first]], w[order[first]] & ~_ONE, g[order[first]]

    def names(self, hot: np.ndarray) -> np.ndarray:
        """Names of the words and hot contexts, sorted."""
        return np.unique(np.concatenate([self.word, _named(np.unique(self.context[_is_in(hot, self.context)]))]))


def perplexity_scores(docs: DataFrame, train: str = "true", held: str = "false") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``train`` and ``held`` are conditions in SQL on doc_id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("train", F.coalesce(F.expr(train), F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, -(-size // PER_BUCKET)))
    hot = _hot(rows, size)
    dealt = _deal(rows, buckets, hot, False).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    state = stored(dealt.mapInArrow(_opened(hot), STATE), "restaurants")
    for sweep in range(SWEEPS):
        before, totals = state, stored(_totals(state, buckets, ["t"]), "totals")
        state = stored(_swept(before, totals, buckets, sweep), "restaurants")
        discard(before, totals)
    return _score(_deal(rows, buckets, hot, True), state, buckets, hot, held)


def _opened(hot: np.ndarray):
    """The state of every bucket from its dealt rows: one table a cell."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(parts):
            x = Cells(rows)
            is_hot = _is_in(hot, x.context)
            names = x.names(hot)
            one, many = x.c == 1, x.c > 1
            alone = np.concatenate([x.word[one], _named(x.context[one & is_hot])])
            contexts, context = np.unique(x.context[many], return_inverse=True)
            there = x.context[one & _is_in(contexts, x.context)]
            tables = np.ones(many.sum(), np.int64)
            s = {"names": names, "alone": np.bincount(np.searchsorted(names, alone), minlength=len(names)),
                 "cell": x.key[many], "word": np.searchsorted(names, x.word[many]), "context": context,
                 "hot": np.where(_is_in(hot, contexts), np.searchsorted(names, _named(contexts)), -1),
                 "alone_there": np.bincount(np.searchsorted(contexts, there), minlength=len(contexts)),
                 "c": x.c[many], "t": tables, **dict.fromkeys(SAMPLED, tables)}
            yield _kept(bucket, s)

    return batches


def _kept(bucket: int, state: dict[str, np.ndarray]) -> pa.RecordBatch:
    return _packed(STATE, [{"bucket": bucket, **{k: _dense(v.astype(_STATE[k]), k in ASCENDING) for k, v in state.items()}}])


def _read(row: dict) -> dict[str, np.ndarray]:
    return {k: _array(row[k], kind, k in ASCENDING) for k, kind in _STATE.items() if row.get(k) is not None}


def _totals(state: DataFrame, buckets: int, of: list[str]) -> DataFrame:
    """For every bucket the totals over all buckets of the columns ``of``, by its names in their order:
    a row a bucket and share of the names.  One row a share has, column by column, what the parent
    needs of the share's words: their sum, and how many have one, two, and any."""
    shares = -(-buckets // SHARES)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(parts):
            s = _read(rows[0])
            n, hot = len(s["names"]), s["hot"][s["context"]]
            sums = np.stack([s["alone"] + np.bincount(s["word"], s[c], n) + np.bincount(hot[hot >= 0], s[c][hot >= 0], n)
                             for c in of]).astype(np.int64)
            edge = np.searchsorted(_bucket(s["names"], shares), np.arange(shares + 1)).tolist()
            yield _packed(SENT, [{"share": q, "bucket": bucket, "names": _dense(s["names"][a:b], True),
                                  "sums": _dense(sums[:, a:b].ravel())}
                                 for q, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if a < b])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, rows in _groups(parts):
            names = [_array(r["names"], np.uint64, True) for r in rows]
            length = list(map(len, names))
            names, at = np.unique(np.concatenate(names), return_inverse=True)
            sums = np.concatenate([_array(r["sums"], np.int64).reshape(len(of), -1) for r in rows], axis=1)
            total = np.stack([np.bincount(at, x, len(names)) for x in sums]).astype(np.int64)
            words = total[:, names & _ONE == 0]
            stats = np.stack([words.sum(1), (words == 1).sum(1), (words == 2).sum(1), (words > 0).sum(1)], axis=1)
            ends = np.cumsum(length)
            for i, (r, a, b) in enumerate(zip(rows, (ends - length).tolist(), ends.tolist())):
                yield _packed(TOTALS, [{"bucket": r["bucket"], "share": share, "totals": _dense(total[:, at[a:b]].ravel()),
                                        "stats": stats.ravel().tolist() if i == 0 else None}])

    need = ["bucket", "names", "alone", "word", "context", "hot", *of]
    sent = state.select(need).mapInArrow(send, SENT).repartition(shares, "share").sortWithinPartitions("share", "bucket")
    return sent.mapInArrow(add, TOTALS)


def _parent(totals: DataFrame, columns: int) -> list[tuple[int, int, float]]:
    """Column by column: the parent's customers, its words, its discount."""
    rows = totals.where("stats IS NOT NULL").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    n = {r.pos: r.n for r in rows}  # four numbers a column
    return [(n.get(4 * k, 0), n.get(4 * k + 3, 0), _discount(n.get(4 * k + 1, 0), n.get(4 * k + 2, 0))) for k in range(columns)]


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


def _by_bucket(buckets: int, first: DataFrame, *more: DataFrame) -> DataFrame:
    for rows in more:
        first = first.unionByName(rows, allowMissingColumns=True)
    return first.repartition(buckets, "bucket").sortWithinPartitions("bucket", "share")


def _met(rows: list[dict], columns: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A bucket's state, and the totals of its names, column by column (rows sorted by share)."""
    state = _read(next(r for r in rows if r[SAMPLED[0]] is not None))
    return state, np.concatenate([_array(r["totals"], np.int64).reshape(columns, -1)
                                  for r in rows if r["totals"] is not None], axis=1)


def _uniform(cell: np.ndarray, sweep: int) -> np.ndarray:
    seed = np.uint64((sweep + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
    return (mix(cell ^ seed) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _swept(state: DataFrame, totals: DataFrame, buckets: int, sweep: int) -> DataFrame:
    """One Gibbs sweep over all cells of more than one customer."""
    (root, _, d1), = _parent(totals, 1)
    kept = {"t", f"t{sweep - SWEEPS + SAMPLES}"}

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(parts):
            s, total = _met(rows, 1)
            there = s["alone_there"] + np.bincount(s["context"], s["t"], len(s["hot"]))
            there = np.where(s["hot"] >= 0, total[0][s["hot"]], there)
            t = draw_tables(s["c"], there[s["context"]] - s["t"], total[0][s["word"]] - s["t"], root - s["t"],
                            _uniform(s["cell"], sweep), DISCOUNT, STRENGTH, d1, ROOT_STRENGTH).astype(np.int64)
            yield _kept(bucket, {k: t if k in kept else v for k, v in s.items()})

    return _by_bucket(buckets, state, totals.drop("stats")).mapInArrow(draw, STATE)


def _score(dealt: DataFrame, state: DataFrame, buckets: int, hot: np.ndarray, held: str) -> DataFrame:
    of = ["c", *SAMPLED]
    totals, samples = stored(_totals(state, buckets, of), "totals"), stored(state.select("bucket", *SAMPLED), "samples")
    discard(state)
    (n_tokens, n_types, _), *parent = _parent(totals, len(of))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(parts):
            if all(r[SAMPLED[0]] is None for r in rows):  # nothing but what is known of the texts themselves
                yield _packed(SUMS, [{**{k: r[k] for k in ("base", "n_docs", *_OWN)}, **dict.fromkeys(
                    ("docs", "known", "base_score", "score"), b"")} for r in rows])
                continue
            s, total = _met(rows, len(of))
            rows = [r for r in rows if r["words"] is not None]
            x = Cells(rows)
            names, several = x.names(hot), x.c > 1  # as they were when the restaurants opened
            word = total[:, np.searchsorted(names, x.word)]
            contexts, context = np.unique(x.context, return_inverse=True)
            is_hot = _is_in(hot, contexts)
            spread = total[:, np.searchsorted(names, _named(contexts[is_hot]))]

            def there(k: int, own: np.ndarray) -> np.ndarray:
                out = np.bincount(context, own, len(contexts))
                out[is_hot] = spread[k]
                return out[context]

            prob, customers = np.zeros(len(x.c)), there(0, x.c)
            for k, (root, _, d1) in enumerate(parent, 1):
                t = x.c.copy()
                t[several] = s[of[k]]
                up = np.where(word[k] > 0, word[k] - d1, ROOT_STRENGTH + d1 * n_types) / (ROOT_STRENGTH + root)
                prob += (x.c - DISCOUNT * t + (STRENGTH + DISCOUNT * there(k, t)) * up) / (STRENGTH + customers)
            values = (word[0] > 0, np.log10((word[0] + 0.1) / (n_tokens + 0.1 * (n_types + 1))), np.log10(prob / SAMPLES))
            done = 0
            for r in rows:
                counts = _array(r["counts"], np.uint32)
                cell = np.repeat(x.of[done:done + len(counts)], counts)
                done += len(counts)
                doc = _array(r["docs"], np.uint16)
                sums = {"docs": b"", "known": b"", "base_score": b"", "score": b""}
                if len(doc):
                    some = np.flatnonzero(np.bincount(doc, minlength=r["n_docs"]))
                    sums = {"docs": some.astype(np.uint16).tobytes(), **{
                        name: np.bincount(doc, v[cell], r["n_docs"])[some].astype(kind).tobytes()
                        for name, v, kind in zip(("known", "base_score", "score"), values, (np.uint32, np.float64, np.float64))}}
                yield _packed(SUMS, [{**{k: r[k] for k in ("base", "n_docs", *_OWN)}, **sums}])

    parts = _by_bucket(buckets, dealt, samples, totals.drop("stats")).mapInArrow(score, SUMS)
    parts = parts.repartition("base").sortWithinPartitions("base")  # a row a bucket and buffer of texts
    out = parts.mapInArrow(_added, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", F.expr(held).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


SUMS = ("base long, n_docs int, docs binary, known binary, base_score binary, score binary, "
        "ids binary, null_ids binary, lengths binary")


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all buckets for the texts of each buffer (the rows come sorted by buffer)."""
    base, sums, own = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(own["ids"], np.int64), mask=np.frombuffer(own["null_ids"], np.uint8) > 0),
             pa.array(np.frombuffer(own["lengths"], np.int64)), pa.array(sums[0].astype(np.int64)),
             pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for part in parts:
        for i in range(part.num_rows):
            r = part.slice(i, 1).to_pylist()[0]
            if r["base"] != base:
                if base is not None:
                    yield row()
                base, sums = r["base"], [np.zeros(r["n_docs"]) for _ in range(3)]
            if r["lengths"] is not None:
                own = r
            at = np.frombuffer(r["docs"], np.uint16)
            for total, name, kind in zip(sums, ("known", "base_score", "score"), (np.uint32, np.float64, np.float64)):
                total[at] += np.frombuffer(r[name], kind)
    if base is not None:
        yield row()


def language_model(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """``perplexity_scores`` with the documents whose fold is ``held`` kept out of training."""
    in_fold = f"pmod(crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)), {folds}) = {held}"
    return perplexity_scores(docs, f"NOT ({in_fold})", in_fold)
