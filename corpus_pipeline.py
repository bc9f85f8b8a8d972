"""Corpus cleaning pipeline over the documents table.

Five stages, in order: language identification (rejected documents go), exact dedup, n-gram Jaccard
join (one document of each group stays), benchmark decontamination (documents with a leak go), and
byte-level BPE encoding (the last; it returns token counts and digests).  Each stage reads what its
predecessor wrote as Parquet, works on all of it, and all but the last return the columns of
documents.  ``ORACLE_SQL`` is None: the stages learn models, so they are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import exact_dedup, jaccard_regions, latent_decontamination, ppm_language, prefix_bpe
from ferrule.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are text of a learnt language."""
    return ppm_language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component."""
    return jaccard_regions.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark item is found."""
    return latent_decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept documents, encoded and decoded again."""
    import public_tokenizers as P
    return prefix_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe_codec", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``; what a stage keeps is stored in the
    shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
