"""Lookups and assertions: rows that must exist, be alone or agree; a row that doesn't stops the job with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenite.functions.text import clean


def _stop(message: Column) -> Column:
    return F.raise_error(message).cast("boolean")


def lookup_all(df: DataFrame, key: str, value: object) -> DataFrame:
    """Every row of the key's value."""
    return df.where(F.col(key) == F.lit(value))


def lookup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes first, by a partial minimum and no sort."""
    others = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *others)).alias("__first")).select(*keys, "__first.*")


def exactly_one(df: DataFrame, keys: Sequence[str], label: str, shown: int = 20) -> DataFrame:
    """The rows of df, each key of which must have one alone; otherwise the job stops with the first labels to choose from."""
    others = [c for c in df.columns if c not in keys]
    least = F.array_sort(F.collect_set(F.col(label).cast("string")))
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*others)).alias("__row"), F.slice(least, 1, shown).alias("__labels"))
    message = F.concat(F.lit("several match: "), F.array_join("__labels", ", "))
    return one.where(F.when(F.col("__n") == 1, True).otherwise(_stop(message))).select(*keys, "__row.*")


def all_present(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """df for the wanted keys; a wanted key without any row stops the job."""
    counts = df.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.lit(True).alias("__there"))
    checked = wanted.select(key).distinct().join(counts, key, "left")
    message = F.concat(F.lit("no rows of "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    checked = checked.where(F.when(F.col("__there"), True).otherwise(_stop(message))).select(key)
    return df.join(checked, key, "left_semi")


def consistent(df: DataFrame, flag: Column, value: Column, name: Column) -> DataFrame:
    """df, every row of which must have the flag exactly where it has a value."""
    message = F.concat(F.lit("flag and value differ: "), F.coalesce(name.cast("string"), F.lit("NULL")))
    return df.where(F.when(flag.eqNullSafe(value.isNotNull()), True).otherwise(_stop(message)))


def known_answer(df: DataFrame, where: Column, column: str, answer: float, tolerance: float = 1e-9) -> DataFrame:
    """df, in which the rows of the condition must have the known answer."""
    near = F.coalesce(F.abs(F.col(column) - answer) <= tolerance, F.lit(False))
    message = F.concat(F.lit(f"{column} is not {answer}: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
    return df.where(F.when(~F.coalesce(where, F.lit(False)) | near, True).otherwise(_stop(message)))


def chosen_subset(df: DataFrame, key: str, chosen: str, other: DataFrame, references: str, other_key: str, separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """The rows whose key is in the comma list, whatever its case, and of the other table those rows that these refer to."""
    ids = [x.strip().lower() for x in chosen.split(",") if x.strip()]
    kept = df.where(F.lower(F.col(key).cast("string")).isin(*ids)) if ids else df
    used = kept.select(F.explode(F.split(F.col(references), f"[{separator}]")).alias("__used")).where("__used <> ''").distinct()
    return kept, other.join(used, F.col(other_key).cast("string") == F.col("__used"), "left_semi")


def excluded_sources(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """The rows in none of whose columns the pattern is found; nulls hold nothing."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.where(~found)


def matches_parent(name: Column, parent: Column, child: Column | None = None) -> Column:
    """Whether a free-text name begins with the parent's number, no digit following; with a child, exactly this child after , or ."""
    text = clean(F.coalesce(name, F.lit("")))
    after = F.substring(text, F.length(parent) + 1, F.length(text))
    begins = text.startswith(parent) & ~after.rlike("^[0-9]")
    if child is None:
        return begins
    rest = F.regexp_extract(after, r"^\s*[,.]\s*(.*)$", 1)
    return begins & (rest != "") & rest.startswith(child) & ~F.substring(rest, F.length(child) + 1, F.length(rest)).rlike("^[0-9A-Za-z]")


def mapped_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """pairs(left_key, right_key, ...) with the columns of both tables; a key that its table lacks stops the job."""
    a = left.withColumn("__left", F.lit(True))
    b = right.withColumn("__right", F.lit(True))
    out = pairs.join(a, left_key, "left").join(b, right_key, "left")
    lost = F.when(F.col("__left").isNull(), F.col(left_key).cast("string")).when(F.col("__right").isNull(), F.col(right_key).cast("string"))
    return out.where(F.when(lost.isNull(), True).otherwise(_stop(F.concat(F.lit("pair without its row: "), lost)))).drop("__left", "__right")


def joined_by_flag(left: DataFrame, right: DataFrame, key: str, fallback: str, right_key: str, unmatched: bool) -> DataFrame:
    """A left join if the unmatched are wanted, else an inner one; by the key, or where it is blank by the fallback."""
    own = F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.nullif(F.trim(F.col(fallback)), F.lit("")))
    return left.withColumn("__own", own).join(right, F.col("__own") == F.col(right_key), "left" if unmatched else "inner").drop("__own")


def value_order(c: Column) -> Column:
    """A sort key of qualified numbers such as <0.5: by their numbers, those without any last by their text."""
    value = F.regexp_replace(clean(F.coalesce(c, F.lit(""))), "^[<>~≈]+\\s*", "").try_cast("double")
    return F.struct(value.isNull().alias("none"), value.alias("value"), F.coalesce(c, F.lit("")).alias("text"))


def page_of_pending(df: DataFrame, order: Sequence[str], review: Column, most: int, start_at: int = 0) -> DataFrame:
    """At most `most` rows from the start on, rows under review after all others: the feature is the limit."""
    return df.orderBy(F.coalesce(review, F.lit(False)), *order).offset(start_at).limit(most)


def cache_state(now: DataFrame, cached: DataFrame, key: str, digest: str, allow_changes: bool = False) -> DataFrame:
    """now with its state against a cache of fetched sources: new, cached, or changed, which stops the job unless allowed."""
    held = cached.select(key, F.col(digest).alias("__held"))
    out = now.join(held, key, "left")
    state = F.when(F.col("__held").isNull(), "new").when(F.col("__held") == F.col(digest), "cached").otherwise("changed")
    out = out.withColumn("state", state).drop("__held")
    if allow_changes:
        return out
    return out.where(F.when(F.col("state") != "changed", True).otherwise(_stop(F.concat(F.lit("source has changed: "), F.col(key).cast("string")))))
