"""The registered queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import (exact_dedup, filter_audit, html_blocks, jaccard_regions, latent_decontamination, odd_sketches,
                         periodic_runs, pitman_yor, ppm_language, prefix_bpe, pu_toxicity, sharding, token_counts)
from ferrule.llm.common import table


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text."""
    return pu_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every whole text."""
    return pitman_yor.language_model(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot of eight shards of near-equal bytes."""
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text by the JSON tokenizer file."""
    import public_tokenizers as P
    return token_counts.token_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN, 512)


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return latent_decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    return ppm_language.language_id(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its equal texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the rank file, and decoded again."""
    import public_tokenizers as P
    return prefix_bpe.round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the near-duplicate component of its text."""
    return jaccard_regions.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at every step of all 120 orders, per language."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of words of every whole text, some of which are made periodic first."""
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component at 0.85."""
    return odd_sketches.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_blocks": op1_html_blocks,
    "op2_pu_toxicity": op2_pu_toxicity,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_ppm_language": op7_ppm_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_jaccard_regions": op10_jaccard_regions,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_odd_sketches": op13_odd_sketches,
}

ORACLE = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
}
