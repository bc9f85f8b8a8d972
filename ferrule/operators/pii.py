"""Personal-data classification of text columns by pattern match counts over whole values.

One aggregate pass per table counts, for every (string column, pattern), the rows whose value
contains a match anywhere in the text.  ``classify_columns`` checks what it finds (card numbers by
Luhn's sum, account numbers modulo 97), turns counts into rates and decides a class for each column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

# The patterns (Java and RE2 compatible; digit runs delimited explicitly).
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(^|[^0-9])\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}([^0-9]|$)",
    "card_number": r"(^|[^0-9])([0-9]{4}[- ]?){3}[0-9]{4}([^0-9]|$)",
    "ssn": r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)",
    "ipv4": r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)",
    "url": r"https?://[^\s]+",
    "secret": r"(?i)(api[_-]?key|secret|password|passwd|token)\s*[:=]",
}


# A literal every match of the pattern contains: rows without it skip the regex (exact).
REQUIRED_LITERAL = {"email": "@", "ssn": "-", "ipv4": ".", "url": "://"}


def pii_scan(df: DataFrame, table: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(table_name, column_name, pii_kind, matching_rows, total_rows) for every string column."""
    pats = patterns or PII_PATTERNS
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    keys = []
    for ci, c in enumerate(cols):
        for pi, (kind, pat) in enumerate(pats.items()):
            hit = F.col(c).rlike(pat)
            if patterns is None and kind in REQUIRED_LITERAL:
                hit = F.col(c).contains(REQUIRED_LITERAL[kind]) & hit
            aggs.append(F.count_if(hit).alias(f"m{ci}_{pi}"))
            keys.append((ci, c, pi, kind))
    one = spread(df).agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                 F.lit(kind).alias("pii_kind"), F.col(f"m{ci}_{pi}").alias("matching_rows"),
                 F.col("__rows").alias("total_rows")) for ci, c, pi, kind in keys])))


# What an account number looks like, and its letters' numbers (A = 10 .. Z = 35).
CARD = r"(?:[0-9]{4}[- ]?){3}[0-9]{4}"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A column is of a class if so large a share of its values holds it, and mixed if any at least this one does.
DECIDED, MIXED = 0.8, 0.01


def luhn_valid(digits: Column) -> Column:
    """Whether a text of digits has a Luhn sum that ten divides (every second digit from the right doubled)."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0)


def mod97_valid(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as numbers,
    leaves 1 when divided by 97."""
    moved = F.concat(F.substring(account, 5, 34), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.instr(F.lit(LETTERS), c) + 9)
    rest = F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0),
                       lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return rest == 1


def _checked(c: Column) -> dict[str, Column]:
    """Kind -> whether a value holds one that passes its check."""
    alone = lambda pattern: F.regexp_extract_all(c, F.lit(rf"(?:^|[^0-9A-Za-z])({pattern})(?![0-9A-Za-z])"), F.lit(1))
    card = F.exists(F.transform(alone(CARD), lambda x: F.translate(x, "- ", "")), luhn_valid)
    return {"card_number": F.when(c.rlike("[0-9]{4}"), card).otherwise(False), "iban": F.when(c.rlike(IBAN), F.exists(alone(IBAN), mod97_valid)).otherwise(False)}


def classify_columns(df: DataFrame, table: str) -> DataFrame:
    """A row per (string column, kind): table_name, column_name, pii_kind, values (not NULL), matching (the
    pattern occurs), valid (one that passes its check occurs; kinds without a check: matching), rate
    (valid of values, NULL without values) and decision: ``is`` (rate of 0.8 or more), ``holds`` (0.01
    or more) or ``no``.  One aggregate pass over whole values."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    patterns = {**PII_PATTERNS, "iban": rf"(^|[^0-9A-Za-z]){IBAN}([^0-9A-Za-z]|$)"}
    aggs, keys = [], []
    for i, name in enumerate(cols):
        c = F.col(f"`{name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        checked = _checked(c)
        for k, (kind, pattern) in enumerate(patterns.items()):
            hit = c.rlike(pattern)
            if kind in REQUIRED_LITERAL:
                hit = c.contains(REQUIRED_LITERAL[kind]) & hit
            aggs += [F.count_if(hit).alias(f"m{i}_{k}"), F.count_if(checked.get(kind, hit)).alias(f"v{i}_{k}")]
            keys.append((i, name, k, kind))
    if not cols:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, pii_kind string, values long, "
                                                   "matching long, valid long, rate double, decision string")
    rows = spread(df).agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(table).alias("table_name"), F.lit(name).alias("column_name"), F.lit(kind).alias("pii_kind"), F.col(f"n{i}").alias("values"),
        F.col(f"m{i}_{k}").alias("matching"), F.col(f"v{i}_{k}").alias("valid")) for i, name, k, kind in keys])))
    rate = F.try_divide("valid", "values")
    return rows.withColumn("rate", rate).withColumn(
        "decision", F.when(F.col("rate") >= DECIDED, "is").when(F.col("rate") >= MIXED, "holds").otherwise("no"))
