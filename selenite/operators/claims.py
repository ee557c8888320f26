"""Claims: one value of one sample from one source, extracted from the tables of reviewers, documents and publications.

Each extractor gives CLAIM's columns. Rows that give no claim are named with their reason where the extractor has a
reject output; merging keeps one claim for each value, locator and reference of a parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.functions.text import clean, not_false, number

CLAIM = T.StructType([T.StructField("parent", T.StringType()), T.StructField("value", T.DoubleType()), *(T.StructField(c, T.StringType()) for c in ("source_kind", "scope", "association", "source_id", "source_url", "reference", "note"))])
BULK = "bulk_or_whole_sample"


def sample_ids(c: Column) -> Column:
    """The distinct ids of five digits, with a letter or without, in order."""
    return F.array_distinct(F.regexp_extract_all(clean(F.coalesce(c, F.lit(""))), F.lit("(?<![0-9])([0-9]{5}[A-Za-z]?)(?![0-9])"), F.lit(1)))


def one_id(c: Column) -> Column:
    """The id of a cell that names exactly one."""
    return F.when(F.size(sample_ids(c)) == 1, sample_ids(c)[0])


def _or(c: str, default: Column | str) -> Column:
    """The cleaned cell, or the default where it is blank."""
    other = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(clean(F.coalesce(F.col(c), F.lit(""))), F.lit("")), other)


def _claims(rows: DataFrame, parent: Column, value: Column, kind: Column | str, scope: Column | str, source_id: Column, url: str, reference: str, note: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    columns = (parent, value, lit(kind), lit(scope), F.lit("parent"), source_id, _or(url, ""), _or(reference, ""), note)
    return rows.select(*(c.alias(f.name) for c, f in zip(columns, CLAIM, strict=True))).where("parent IS NOT NULL AND value IS NOT NULL")


def automatic_claims(rows: DataFrame) -> DataFrame:
    """Measurements of documents (measurement_id, sample_id, value, scope, needs_review, page, evidence, source_url, reference).

    Those not under review, of the bulk, with one id and a number.
    """
    fine = rows.where(~not_false(F.col("needs_review")) & (F.lower(clean(F.col("scope"))) == BULK))
    note = F.concat(F.lit("page "), _or("page", ""), F.lit("; "), _or("evidence", ""))
    return _claims(fine, one_id(F.col("sample_id")), number(F.col("value")), "document_automatic", BULK, F.concat(F.lit("measurement:"), _or("measurement_id", "")), "source_url", "reference", note)


def adjudicated_claims(rows: DataFrame, accepted: str) -> DataFrame:
    """Rows whose decision is the accepted one (measurement_id, sample_id, value, scope, decision, reason, source_url, reference)."""
    fine = rows.where(clean(F.col("decision")) == accepted)
    return _claims(fine, one_id(F.col("sample_id")), number(F.col("value")), "document_adjudicated", _or("scope", "parent_or_fraction"), F.concat(F.lit("measurement:"), _or("measurement_id", "")), "source_url", "reference", _or("reason", ""))


def resolved_claims(rows: DataFrame, prefix: str = "resolved_") -> DataFrame:
    """A claim for each number that a resolved case accepts (queue_id, sample_id, status, values, scope, note, source_url, locator)."""
    fine = rows.where(clean(F.col("status")).startswith(prefix))
    found = F.regexp_extract_all(clean(F.coalesce(F.col("values"), F.lit(""))), F.lit(r"(?<![A-Za-z])[-+]?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    each = fine.select("*", F.posexplode(found).alias("__at", "__value"))
    return _claims(each, one_id(F.col("sample_id")), F.col("__value").cast("double"), "publication_resolved", _or("scope", "resolved_sample_or_fraction"), F.concat(F.lit("case:"), _or("queue_id", ""), F.lit(":"), (F.col("__at") + 1).cast("string")), "source_url", "locator", _or("note", ""))


def manual_claims(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of included rows (row, sample_id, value, include, source_kind, scope, source_id, source_url, reference, note), and the
    included ones that name no single sample or no number; blank kinds, scopes and ids have their defaults."""
    wanted = rows.where(not_false(F.col("include")))
    parent, value = one_id(F.col("sample_id")), number(F.col("value"))
    made = _claims(wanted, parent, value, _or("source_kind", "manual_reviewed"), _or("scope", BULK), _or("source_id", F.concat(F.lit("manual:"), F.col("row").cast("string"))), "source_url", "reference", _or("note", ""))
    return made, wanted.where(parent.isNull() | value.isNull())


def two_target_claims(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, claim columns): a claim for each target column that holds a number (sample_id, dataset, scope, source_url, reference, note)."""
    each = rows.withColumn("__each", F.explode(F.array(*(F.struct(F.lit(t).alias("target"), number(F.col(t).cast("string")).alias("v")) for t in targets))))
    parent = one_id(F.col("sample_id"))
    return each.where(parent.isNotNull() & F.col("__each.v").isNotNull()).select(
        F.col("__each.target").alias("target"), parent.alias("parent"), F.col("__each.v").alias("value"), F.concat(F.lit("extract:"), _or("dataset", "")).alias("source_kind"), _or("scope", "sample").alias("scope"),
        F.lit("parent").alias("association"), F.concat(_or("dataset", ""), F.lit(":"), parent).alias("source_id"), _or("source_url", "").alias("source_url"), _or("reference", "").alias("reference"), _or("note", "").alias("note"),
    )


def reviewed_claims(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of confirmed rows (row, sample_id, value, needs_review, scope, source_url, locator, evidence), and (outcome, n) of all."""
    parent, value = one_id(F.col("sample_id")), number(F.col("value"))
    confirmed = F.lower(clean(F.coalesce(F.col("needs_review"), F.lit("")))) == "no"
    outcome = F.when(~confirmed, "excluded_not_confirmed").when(parent.isNull() | value.isNull(), "excluded_invalid").otherwise("accepted")
    marked = rows.withColumn("__outcome", outcome)
    made = _claims(marked.where("__outcome = 'accepted'"), parent, value, "existing_reviewed", _or("scope", "sample"), F.concat(F.lit("reviewed:"), F.col("row").cast("string")), "source_url", "locator", _or("evidence", ""))
    return made, marked.groupBy(F.col("__outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def merged_claims(parts: Sequence[DataFrame], least: float, most: float) -> tuple[DataFrame, DataFrame]:
    """One claim for each parent, rounded value, locator (address, else id) and reference, of the last part that has it; and
    the claims whose values are out of the interval."""
    whole = None
    for k, part in enumerate(parts):
        one = part.withColumn("__part", F.lit(k))
        whole = one if whole is None else whole.unionByName(one)
    inside = F.col("value").between(least, most)
    locator = F.coalesce(F.nullif(F.lower(clean(F.col("source_url"))), F.lit("")), F.lower(clean(F.col("source_id"))))
    names = [f.name for f in CLAIM]
    keys = (F.col("parent").alias("__parent"), F.round("value", 8).alias("__v"), locator.alias("__locator"), F.lower(clean(F.col("reference"))).alias("__reference"))
    kept = whole.where(inside).groupBy(*keys).agg(F.max(F.struct("__part", *names)).alias("__last"))
    return kept.select(*(F.col(f"__last.{c}").alias(c) for c in names)), whole.where(~inside).drop("__part")


def claim_report(claims: DataFrame) -> DataFrame:
    """Per parent: count, mean, least, greatest and deviation of the claims, their values joined, and all of them as JSON, by
    value, kind and id."""
    row = F.struct("value", "source_kind", "source_id")
    out = claims.groupBy("parent").agg(F.count(F.lit(1)).alias("n_claims"), F.avg("value").alias("claim_mean"), F.min("value").alias("claim_min"), F.max("value").alias("claim_max"), F.stddev_samp("value").alias("claim_sd"), F.array_sort(F.collect_list(row)).alias("__rows"))
    values = F.array_join(F.transform("__rows", lambda x: x["value"].cast("string")), ";")
    return out.select("parent", "n_claims", "claim_mean", "claim_min", "claim_max", "claim_sd", values.alias("claim_values"), F.to_json("__rows").alias("claims_json"))
