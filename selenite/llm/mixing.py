"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws an exponential key divided by its quality weight; within a source the documents with the smallest
keys come first, and their running word count is cut at the source's budget. Budgets above the source's size are met by
complete epochs first and by this selection for the rest. No window holds a source: keys fall into ordered buckets,
bucket sums find the bucket in which the budget ends, and only that bucket's rows are sorted. What a document is given
then follows from its own key and its source's cut, so that texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Ordered buckets of the keys of a source.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts whose bytes per word are usual for prose (3 to 12), else a half."""
    each = F.octet_length(text) / F.when(size > 0, size)
    return F.when(each.between(3, 12), 1.0).otherwise(0.5)


def _sized(docs: DataFrame, seed: int, quality: Column | None) -> DataFrame:
    """docs with __size, __tie and __key, each a function of the row alone."""
    tie = F.md5(F.concat(F.lit(f"mix-{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.coalesce("text", F.lit(""))).cast("binary"))
    unit = (F.conv(F.substring("__tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = quality_weight(F.col("text"), F.col("__size")) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1e-9)
    key = -F.ln(unit) / weight
    return docs.withColumn("__size", word_count(F.col("text"))).withColumn("__tie", tie).withColumn("__key", key)


def _bucket() -> Column:
    return F.least(F.floor(BUCKETS * (1 - F.exp(-F.col("__key")))), F.lit(BUCKETS - 1))


def targets(sizes: DataFrame, share: float, weights: Sequence[int], cap: float) -> DataFrame:
    """sizes(source, source_size) with each source's target: a share of all words by weight, at most cap times its size.

    One row per source goes through a single window; what is above a cap is shared again by weight: with the sources in
    order of cap over weight, the first k are capped, and k is the least for which the level that the others reach does not
    pass the next ratio; later levels only fall.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("all", F.lit(share) * F.sum("source_size").over(every))
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return rows.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most")))).select("source", "source_size", "target")


def _cuts(sized: DataFrame, share: float, weights: Sequence[int], cap: float) -> DataFrame:
    """One row per source: its size, target, complete epochs, and the key at which the selection for the rest ends."""
    by_bucket = materialize(sized.withColumn("b", _bucket()).groupBy("source", "b").agg(F.sum("__size").alias("s")), "buckets")
    plan = targets(by_bucket.groupBy("source").agg(F.sum("s").alias("source_size")), share, weights, cap)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    p = plan.select(F.col("source").alias("p_source"), "rest")
    running = by_bucket.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("b")))
    ends = running.join(p, F.col("source").eqNullSafe(F.col("p_source"))).where("upto > rest").groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("s")).alias("before"))).alias("e"), F.first("rest").alias("rest"))
    ends = materialize(ends.select(F.col("source").alias("e_source"), F.col("e.b").alias("e_b"), "e.before", "rest"), "ends")
    inside = sized.withColumn("b", _bucket()).join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("b") == F.col("e_b")))
    upto = F.sum("__size").over(Window.partitionBy("source").orderBy("__key", "__tie").rowsBetween(Window.unboundedPreceding, 0))
    taken = inside.withColumn("upto", upto).where(F.col("before") + F.col("upto") - F.col("__size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max(F.struct("__key", "__tie")).alias("last")).select(F.col("source").alias("l_source"), "last")
    cut = plan.join(ends.select("e_source", "e_b"), F.col("source").eqNullSafe(F.col("e_source")), "left").join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    names = {"source": "__c_source", "source_size": "__source_size", "target": "__target", "epochs": "__epochs", "last": "__last"}
    return materialize(cut.select(*(F.col(k).alias(v) for k, v in names.items()), F.coalesce("e_b", F.lit(BUCKETS)).alias("__e_b")), "cuts")


def _given(sized: DataFrame, cuts: DataFrame, cap: float) -> DataFrame:
    """sized with __copies, the number of times that the mix takes the row; an empty one never more often than others may be."""
    b = _bucket()
    own = F.struct("__key", "__tie")
    chosen = (b < F.col("__e_b")) | ((b == F.col("__e_b")) & F.coalesce(own <= F.col("__last"), F.lit(False)))
    copies = F.least(F.col("__epochs") + chosen.cast("long"), F.lit(math.ceil(cap)).cast("long"))
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("__c_source"))).withColumn("__copies", copies)


def mixed_sizes(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0, seed: int = 7, quality: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs(doc_id, text, source).

    A size is the number of words; a null text has none. Sources in order of code point, null last, have the weights in
    turn. The row at a budget's end is taken if that comes nearer, so a source's sum is off by half a document at most.
    Keys depend on seed, doc_id, text and its weight alone: reruns agree, and rows repeated whole are taken together.
    quality names a column of weights (null or not above 0: last); without it, texts weigh by quality_weight. Without
    words every target is 0. Other columns are not read.
    """
    weight = None if quality is None else F.col(quality)
    sized = docs.select("doc_id", "text", "source", *([quality] if quality else []))
    sized = materialize(_sized(sized, seed, weight).select("doc_id", "source", "__size", "__tie", "__key"), "sized")
    out = _given(sized, _cuts(sized, share, weights, cap), cap)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def mixture(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0, seed: int = 7, quality: str | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, at most cap times rounded up.

    quality names a column of weights, such as a classifier's scores; what is null or not above 0 comes last. Columns
    of any name are passed on but those that start with two underscores, which must not be there. Empty docs give none.
    """
    columns = docs.columns
    sized = _sized(docs, seed, None if quality is None else F.col(quality))
    cuts = _cuts(materialize(sized.select("source", "__size", "__tie", "__key"), "sized"), share, weights, cap)
    out = _given(sized, cuts, cap)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(*columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(strlen(text), 0) AS bytes,
    md5('mix-7-' || coalesce(doc_id::VARCHAR, 'null') || '-' || coalesce(text, '')) AS tie FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / CASE WHEN size > 0 AND bytes / size BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END AS k FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sums),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM weighed),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS level FROM ratios
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size, least(most, coalesce((SELECT max(level) FROM levels WHERE level <= ratio) * w, most)) AS target FROM levels),
spent AS (
  SELECT doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY k, tie ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM (SELECT *, least(2, epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM spent)
"""
