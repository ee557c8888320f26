"""Queries that apply the operators with production parameters to the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, html_extraction, mixing, ngram_join, pii, quality, sharding, suffix_dedup, warc
from .common import fresh_path, read_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150% of all words, sources weighted 3, 1, 2 in turn, none above twice its size."""
    return mixing.mixed_sizes(read_table(spark, sf_dir, "documents"))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from the labels of ids that are not held out."""
    out = quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of row counts at most one apart."""
    out = sharding.shards_of(read_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, and the archives read back."""
    path = warc.write_archives(read_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 among the vectors of a label."""
    return embedding_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), least=0.98)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items of which it holds passages."""
    out = decontamination.marked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at Jaccard 0.9 on three-word shingles."""
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 200 bytes that occur elsewhere."""
    found = suffix_dedup.repeated_removed(read_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extracted(read_table(spark, sf_dir, "pages"))


def op10_sanitise_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of four kinds of personal data and of the terms that disclose them."""
    found = pii.personal_spans(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(pii.all_spans()).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pu_quality": op2_pu_quality,
    "op3_hypergeometric_shards": op3_hypergeometric_shards,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_html_wrappers": op9_html_wrappers,
    "op10_sanitise_pii": op10_sanitise_pii,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op4_warc_round_trip": warc.SQL,
    "op5_cross_polytope": embedding_dedup.SQL,
    "op7_ngram_jaccard_join": ngram_join.SQL,
    "op8_suffix_array_dedup": suffix_dedup.SQL,
}
