"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import decontam, jaccard, langid, licenses, lines, minhash, mixing, negatives, oracles, periodic, quality, substring, toxicity, urls
from riskgraph.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the place of the best window."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from all documents because a 50-word window repeats a smaller document's."""
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by cross-parsing."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by weak supervision."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict for all documents."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or language-model verdict for all pages."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to an equal or similar line elsewhere."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document for the target weights of the sources."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("th")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of all documents."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard of 3-word shingles at 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, of which some get a periodic tail by their id."""
    return periodic.run_digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.plant_period))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard of 4-word shingles at 0.8 or more."""
    return minhash.near_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors (vec_id divisible by 100); labels of ids divisible by 7 move on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_benchmark_decontamination, op2_substring_dedup, op3_language_id, op4_toxicity, op5_quality_rules, op6_url_filter, op7_line_dedup, op8_mix_sources, op9_license_scan, op10_jaccard_join, op11_periodic_runs, op12_minhash_dedup, op13_hard_negatives)}

ORACLES: dict[str, str] = oracles.ORACLES
