"""Interaction audit of five text filters by the potential of their removal games.

A document fails some of the filters A to E; the set of those is its mask.  For a coalition S of
filters, v(S) is the number of documents that at least one filter of S removes.  The potential of
Hart and Mas-Colell is P(empty) = 0 and

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|

computed over the 32 coalitions in the order of their bit masks.  A filter's Shapley value is
P(all) - P(all without it).  What a filter does at its place in an order needs no replay: with B
the filters before it, it removes v(B with it) - v(B) documents.

The filters (words: maximal runs of other characters than [\\x20\\x09-\\x0D], case counts):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] > 10 * code points;
D any of #$%&*|; E the text of a smaller doc_id.  A to D depend on the text alone, so for E rows
are first counted by (text, id, part, label) and then by (text, part, label): a text that a third
of all rows share is a handful of rows by the time its smallest id is found.

Cases: a null text is empty; a null lang is the part ''; a null doc_id has no label, fails E never
and makes none fail; rows that repeat an id are rows each, none of which is smaller than the other;
labels that repeat an id count as 1 where any is 1; a part is a lang value that occurs, so an empty
table gives no rows; ties do not arise.  All counts are exact.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored, text_or_empty

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BLANKS = r"[\x20\x09-\x0D]+"


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the whole text, own: the filters A to D it fails (bits 1, 2, 4, 8)."""
    text = F.col("text")
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       text_or_empty().alias("text"))
    counted = rows.select("doc_id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                          F.char_length(text).cast("long").alias("points"), capitals.cast("long").alias("capitals"),
                          text.rlike("[#$%&*|]").alias("symbol"), words.alias("words"))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    fails = [n < 100, 100 * distinct < 80 * n, 100 * F.col("capitals") > 10 * F.col("points"), F.col("symbol")]
    own = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return counted.select("doc_id", "part", "digest", own.alias("own"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by the filters they fail and by their label."""
    rows = stored(own_failures(docs), "own-failures")
    label = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    labelled = (rows.where("doc_id IS NOT NULL").join(label, "doc_id", "left")
                .unionByName(rows.where("doc_id IS NULL").select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))))
    kind = ["digest", "part", "own", "good", "toxic"]
    by_id = labelled.select(*kind[:3], F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
                            "doc_id").groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"))
    first = by_text.groupBy("digest").agg(F.min("least.doc_id").alias("first"))  # a text has few kinds of rows
    repeats = F.col("known") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = by_text.join(first, "digest").select("part", "own", "good", "toxic", "n", repeats.alias("repeats"))
    two = F.explode(F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("repeats")).alias("n")),
                            F.struct(F.col("own").bitwiseOR(16).alias("mask"), F.col("repeats").alias("n"))))
    return (split.select("part", "good", "toxic", two.alias("x")).groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic")
            .agg(F.sum("x.n").alias("n")).where("n > 0"))


def games(counts: DataFrame) -> DataFrame:
    """part, n, and v, v_good, v_toxic: arrays by coalition mask of the documents (all, good, toxic) it removes."""
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    value = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(ALL)))).groupBy("part", "s").agg(
        F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("v"),
        F.sum(F.when(hit, F.col("n") * F.col("good")).otherwise(0)).alias("v_good"),
        F.sum(F.when(hit, F.col("n") * F.col("toxic")).otherwise(0)).alias("v_toxic"))
    by_mask = F.array_sort(F.collect_list(F.struct("s", "v", "v_good", "v_toxic")))  # 32 entries
    return value.groupBy("part").agg(F.max("n").alias("n"), by_mask.alias("c")).select(
        "part", "n", F.col("c.v").alias("v"), F.col("c.v_good").alias("v_good"), F.col("c.v_toxic").alias("v_toxic"))


def potential(v: str) -> str:
    """SQL for 120 times the potential of every coalition; a whole number, since |S| <= 5."""
    without = " + ".join(f"if(s & {1 << i} > 0, p[s - {1 << i}], 0L)" for i in range(len(FILTERS)))
    return f"aggregate(sequence(1, {ALL}), array(0L), (p, s) -> concat(p, array((120L * {v}[s] + {without}) div bit_count(s))))"


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module's text for the columns."""
    game = games(failure_counts(docs, labels)).withColumn("p", F.expr(potential("v")))
    bit = "shiftleft(1, instr('ABCDE', substr(filter_order, {0}, 1)) - 1)"
    before = f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (b, i) -> b | {bit.format('i')})"
    steps = (game.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
             .withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
             .selectExpr("*", f"{bit.format('step')} AS f", f"{before} AS b").withColumn("a", F.col("f").bitwiseOR(F.col("b"))))
    return steps.selectExpr(
        "part", "filter_order", "step", "n - v[a] AS kept", "v[a] - v[b] AS removed", "v[f] - (v[a] - v[b]) AS redundant",
        f"v[{ALL}] - v[{ALL} - f] AS unique_fails", "v_good[a] - v_good[b] AS good_lost",
        "v_toxic[a] - v_toxic[b] AS toxic_lost", f"p[{ALL}] - p[{ALL} - f] AS shapley")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(words) < 100 AS fa, 100 * len(list_distinct(words)) < 80 * len(words) AS fb,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS fc,
         regexp_matches(t, '[#$%&*|]') AS fd, coalesce(d.doc_id > first.first, false) AS fe
  FROM d JOIN first USING (t) LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, good, toxic, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END,
         CASE WHEN fc THEN 'C' ELSE '' END, CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS b
  FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone,
         length(translate(fails, b, '')) < length(fails) AS gone FROM m, s),
g AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (hit AND NOT gone AND good = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (hit AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
