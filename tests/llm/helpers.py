"""Small document tables for the operators' tests."""

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 3000


def documents(spark, rows, clash=True):
    """Rows (doc_id, text, lang) as a documents table, with extra columns whose names the operators use
    themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, la, "s", len(t) if t is not None else None) for d, t, la in rows]
    if clash:
        names = ["size", "h", "node", "shard", "score", "n", "key", "count", "digest", "bucket", "value", "__x"]
        schema += "".join(f", {n} string" for n in names)
        full = [(*r, *["x"] * len(names)) for r in full]
    return spark.createDataFrame(full, schema)


EDGE = [(1, "one two three four five six seven", "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "de"),
        (5, LONG, "en"), (6, "one two three four five six seven", "en"), (6, "one two three four five six seven", "en"),
        (None, "one two", None), (7, "€ ü 漢字 \U0001F600", None), (8, "one  two three\tfour five six seven", "fr")]
