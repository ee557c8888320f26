"""Joins that say how many rows matched, prefer the first or the last, or take what precedes or lies near.

None of them fans out unless it says so, and none uses a cross join: build sides are aggregated to a row per key first,
range joins are equi-joins on cells of the tolerance's width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, take: Sequence[str], into: str = "match_class") -> DataFrame:
    """left with columns of right: 0 rows of the key are missing, 1 is matched, more are ambiguous and give nothing."""
    build = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), *(F.min(c).alias(f"__{c}") for c in take))
    out = left.join(build, F.col(left_key) == F.col("__key"), "left")
    one = F.col("__n") == 1
    kind = F.when(F.col("__n").isNull(), "missing").when(one, "matched").otherwise("ambiguous")
    return out.select(*left.columns, *(F.when(one, F.col(f"__{c}")).alias(c) for c in take), kind.alias(into))


def unique_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join on a key that must be unique on the right: a second row of a key stops the job."""
    others = [c for c in right.columns if c != key]
    build = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*others)).alias("__row"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).cast("int")).otherwise(F.lit(1))
    build = build.withColumn("__one", checked).where("__one = 1").select(key, "__row.*")
    return left.join(build, key, how)


def _one_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def first_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row of each key at the least position."""
    return _one_of(df, keys, [F.col(position).asc()])


def last_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row of each key at the greatest position."""
    return _one_of(df, keys, [F.col(position).desc()])


def priority_union(parts: Sequence[DataFrame], keys: Sequence[str], rule: str = "rule") -> DataFrame:
    """The union of the parts, numbered from 1, with each key once: that of the earliest part."""
    tagged = [p.withColumn(rule, F.lit(k)) for k, p in enumerate(parts, 1)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    others = [c for c in whole.columns if c not in keys]
    return whole.groupBy(*keys).agg(F.min(F.struct(rule, *(c for c in others if c != rule))).alias("__least")).select(*keys, "__least.*")


def associated(left: DataFrame, right: DataFrame, key: str, references: str, own: str, record: Sequence[str], identifier: str, other: str, rule: str = "rule") -> DataFrame:
    """(key, record, rule): the records of right that a row of left refers to by identifier (`reference`), then those whose
    `other` equals its `own` but for case and outer blanks (`same`); each once, by the earlier rule. A row of left without any
    has one row of the rule `none`; blank ids match nothing."""
    folded = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    records = right.select(*record, F.nullif(F.trim(identifier), F.lit("")).alias("__id"), folded(other).alias("__other"))
    named = left.select(key, F.explode(F.array_distinct(F.transform(references, lambda x: F.trim(x)))).alias("__id"))
    first = named.join(records, "__id").select(key, *record)
    second = left.select(key, folded(own).alias("__other")).join(records, "__other").select(key, *record)
    found = priority_union([first, second], [key, *record], rule)
    out = left.select(key).distinct().join(found, key, "left")
    return out.select(key, *record, F.when(F.col(rule) == 1, "reference").when(F.col(rule) == 2, "same").otherwise("none").alias(rule))


def overwritten(rows: DataFrame, over: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of two tables of unique keys; where both have a key, the row of `over`."""
    return priority_union([over, rows], keys, "__rule").drop("__rule")


def parent_pairs(left: DataFrame, right: DataFrame, key: str, fits: Column) -> DataFrame:
    """All pairs of rows of left with rows of right that fit and have the same parent; rows without a parent have none.

    The rows of right are filtered before the join; the pairs of a parent are the result, so their number is not bounded.
    """
    return left.where(F.trim(F.col(key).cast("string")) != "").join(right.where(fits), key)


def asof_preceding(probe: DataFrame, build: DataFrame, keys: Sequence[str], at: str, take: Sequence[str], width: float | None = None) -> DataFrame:
    """probe with columns of the last build row of its keys at or before it; null if there is none.

    One pass over the union of both, ordered within the keys: no row meets another. With `width` (of times: in days), a
    pass is over a cell of that width alone, so no task holds all rows of a key: what a cell begins with is the last
    build row of the cells before it, of which there is a row a cell. A probe row without a position gets null, a build
    row without one is at or before nothing.
    """
    names = [c for c in probe.columns if c not in keys and c != at]
    left = probe.select(*keys, at, F.lit(1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).alias("__got"))
    got = F.struct(*take)
    right = build.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("__side"), F.lit(None).alias("__row"), got.alias("__got"))
    both, within = left.unionByName(right), list(keys)
    if width is not None:
        both, within = both.withColumn("__cell", _cell(both, at, width)), [*keys, "__cell"]
    w = Window.partitionBy(*within).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__got", ignorenulls=True).over(w)).where("__side = 1")
    if width is not None:
        cells = both.groupBy(*within).agg(F.max_by("__got", F.when(F.col("__side") == 0, F.col(at))).alias("__end"))
        earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        begins = cells.select(*(F.col(k).alias(f"__k_{k}") for k in within), F.last("__end", ignorenulls=True).over(earlier).alias("__begin"))
        found = found.join(begins, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in within]).withColumn("__last", F.coalesce("__last", "__begin"))
    return found.select(*keys, at, "__row.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def _cell(df: DataFrame, at: str, width: float) -> Column:
    """The cell of a position: its multiple of the width, for times that of their day."""
    timed = df.schema[at].dataType.typeName().startswith(("timestamp", "date"))
    return F.floor((F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")) if timed else F.col(at)) / width)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, tolerance: float) -> DataFrame:
    """Pairs of equal keys whose positions differ by tolerance at most, by cells of that width; columns must not clash."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = left.withColumn("__cell", F.explode(F.array(*(cell(left_at) + d for d in (-1, 0, 1)))))
    right = right.withColumn("__cell", cell(right_at))
    return near.join(right, [*keys, "__cell"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= tolerance).drop("__cell")


def covered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_semi")


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def resolve_path(left: DataFrame, right: DataFrame, path: str, take: Sequence[str]) -> DataFrame:
    """left with columns of right by the whole path, or else by the file name where only one row of right has it."""
    whole = right.groupBy(F.col(path).alias("__p")).agg(*(F.first(c).alias(f"__p_{c}") for c in take), F.lit(True).alias("__has"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    base = right.groupBy(name(F.col(path)).alias("__b")).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(f"__b_{c}") for c in take)).where("__n = 1")
    out = left.join(whole, F.col(path) == F.col("__p"), "left").join(base, name(F.col(path)) == F.col("__b"), "left")
    return out.select(*left.columns, *(F.when(F.col("__has"), F.col(f"__p_{c}")).otherwise(F.col(f"__b_{c}")).alias(c) for c in take))


def unchanged(now: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of now whose key and digest are done already."""
    return now.join(done.select(key, digest).distinct(), [key, digest], "left_semi")


def pending(now: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of now that are to be done: new ones, and those whose digest has changed."""
    return now.join(done.select(key, digest).distinct(), [key, digest], "left_anti")
