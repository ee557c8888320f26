"""Aggregations: weighted means of groups, claims, metrics, completeness, quantiles, flags, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenite.functions.numeric import FLAGS


#: Cells into which the range of a group's values is cut to find quantiles.
CELLS = 1024


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """keys and the linear quantiles of the finite values of each group, by the names given; groups without values have none.

    No task holds a group: cells of the group's range are counted, and only the values in the cells where the wanted
    ranks fall are sorted, equal ones as one with their number.
    """
    rows = df.where(F.abs(value) < float("inf")).select(*keys, F.col(value).cast("double").alias("__v"))
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    span = span.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__lo", "__hi", "__n")
    same = lambda: [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    share = (F.col("__v") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    celled = rows.join(span, same()).withColumn("__cell", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)))
    values = celled.groupBy(*keys, "__cell", "__v", "__n").agg(F.count(F.lit(1)).alias("__c"))
    counts = celled.groupBy(*keys, "__cell", "__n").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__cell")) - F.col("__c")
    rank = lambda p: F.lit(p) * (F.col("__n") - 1)
    ranks = F.array_distinct(F.array(*(f(rank(p)) for p in probabilities.values() for f in (F.floor, F.ceil))))
    cells = counts.withColumn("__before", before).withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c"))))
    cells = cells.where(F.size("__ranks") > 0).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__cell").alias("__k_cell"), "__before", "__ranks")
    inside = values.join(cells, [*same(), F.col("__cell") == F.col("__k_cell")])
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__cell").orderBy("__v")) + F.col("__before")
    found = inside.withColumn("__upto", upto).select(*keys, "__n", "__v", F.explode(F.filter("__ranks", lambda r: (r >= F.col("__upto") - F.col("__c")) & (r < F.col("__upto")))).alias("__rank"))
    at = lambda f, p: F.max(F.when(F.col("__rank") == f(rank(p)), F.col("__v")))
    ends = found.groupBy(*keys, "__n").agg(*(at(f, p).alias(f"{c}_{n}") for n, p in probabilities.items() for c, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda n, p: F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * (rank(p) - F.floor(rank(p)))
    return ends.select(*keys, *(between(n, p).alias(n) for n, p in probabilities.items()))


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join of one row per key on keys that may be null."""
    renamed = right.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left").drop(*(f"__k_{k}" for k in keys))


def joined_set(c: Column, separator: str = ";") -> Column:
    """The distinct values of a group in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def member_and_group_means(df: DataFrame, band: str, group: str, value: str) -> DataFrame:
    """Mean and deviation of each band, every member weighing the same (`member`) and every group the same (`group`)."""
    one = df.groupBy(band).agg(F.lit("member").alias("weighting"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    means = df.groupBy(band, group).agg(F.avg(value).alias("m"))
    two = means.groupBy(band).agg(F.lit("group").alias("weighting"), F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    return one.unionByName(two)


def per_pair_distribution(df: DataFrame, pair: str, group: str, value: str) -> DataFrame:
    """Distribution of the pairs' means over their bands, every pair weighing the same (`pair`) and every group the same (`group`)."""
    means = df.groupBy(group, pair).agg(F.avg(value).alias("m"))
    stats = (F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min("m").alias("least"), F.max("m").alias("most"))
    one = means.agg(F.lit("pair").alias("weighting"), *stats)
    return one.unionByName(means.groupBy(group).agg(F.avg("m").alias("m")).agg(F.lit("group").alias("weighting"), *stats))


def ratio_of_means(df: DataFrame, keys: Sequence[str], n: str, d: str) -> DataFrame:
    """The ratio of the means beside the mean of the ratios."""
    return df.groupBy(*keys).agg((F.avg(n) / F.avg(d)).alias("ratio_of_means"), F.avg(F.col(n) / F.when(F.abs(d) >= 1e-12, F.col(d))).alias("mean_of_ratios"))


def claim_summary(df: DataFrame, keys: Sequence[str], value: str, claim: Sequence[str]) -> DataFrame:
    """Statistics of the distinct claims of each key, and of their distinct values, which differ where claims agree."""
    claims = df.select(*keys, value, *claim).distinct()
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_claims"), F.avg(value).alias("claim_mean"), F.min(value).alias("claim_min"), F.max(value).alias("claim_max"), F.stddev_samp(value).alias("claim_sd"),
        F.array_sort(F.collect_set(value)).alias("values"),
    ).select(*keys, "n_claims", "claim_mean", "claim_min", "claim_max", "claim_sd", F.size("values").alias("n_values"), (F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / F.size("values")).alias("value_mean"))


def accept_within(df: DataFrame, value: str, least: float, most: float) -> tuple[DataFrame, DataFrame]:
    """The rows within the interval, and the rejected ones with their reasons."""
    v = F.col(value)
    reason = F.when(v.isNull(), "missing").when(v == 0, "zero placeholder").when(v < least, "below").when(v > most, "above")
    marked = df.withColumn("reject_reason", F.when(v.isNotNull() & v.between(least, most), F.lit(None)).otherwise(reason))
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def tiered_choice(df: DataFrame, keys: Sequence[str], tier: str, value: str) -> DataFrame:
    """Mean and number of the values of the best (least) tier that each key has."""
    by_tier = df.where(F.col(value).isNotNull()).groupBy(*keys, tier).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return by_tier.groupBy(*keys).agg(F.min(F.struct(tier, "mean", "n")).alias("best")).select(*keys, "best.*")


def regression_metrics(df: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """n, MAE, RMSE, median absolute error, bias and R2 over the finite pairs; R2 is null for fewer than two."""
    fine = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    rows = df.where(fine(truth) & fine(predicted)).withColumn("__e", F.col(predicted) - F.col(truth))
    spread = F.var_pop(truth) * F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("__e")).alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__e").alias("bias"),
        F.when((F.count(F.lit(1)) > 1) & (spread > 0), 1 - F.sum(F.col("__e") * F.col("__e")) / spread).alias("r2"),
    )
    middle = exact_quantiles(rows.select(*keys, F.abs("__e").alias("__a")), keys, "__a", {"median_abs": 0.5})
    return _with(out, middle, keys).select(*keys, "n", "mae", "rmse", "median_abs", "bias", "r2")


def group_mean_metrics(df: DataFrame, keys: Sequence[str], group: str, truth: str, predicted: str) -> DataFrame:
    """Metrics on the means of groups; pairs that are not finite are dropped before grouping."""
    fine = df.where((F.abs(truth) < float("inf")) & (F.abs(predicted) < float("inf")))
    return regression_metrics(fine.groupBy(*keys, group).agg(F.avg(truth).alias(truth), F.avg(predicted).alias(predicted)), keys, truth, predicted)


def complete_pivot(df: DataFrame, key: str, band: str, value: str, bands: Sequence[int], prefix: str = "b") -> DataFrame:
    """A column per band, for the keys that have every band; the list of bands is given, so no extra pass looks for it.

    A second row of a key and band stops the job.
    """
    one = df.where(F.col(band).isin(*bands)).groupBy(key, band).agg(F.first(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    message = F.concat(F.lit("duplicate band "), F.col(band).cast("string"), F.lit(" of "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    one = one.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(message).cast("boolean")))
    full = one.groupBy(key).pivot(band, list(bands)).agg(F.first("__v").alias("v"), F.count(F.lit(1)).alias("n"))
    whole = F.lit(True)
    for b in bands:
        whole &= F.coalesce(F.col(f"{b}_n") == 1, F.lit(False))
    return full.where(whole).select(key, *(F.col(f"{b}_v").alias(f"{prefix}{b}") for b in bands))


def unpivot_bands(df: DataFrame, key: str, bands: Sequence[int], prefix: str = "b", name: str = "band", value: str = "value") -> DataFrame:
    return df.unpivot([key], [f"{prefix}{b}" for b in bands], name, value)


def column_domain(df: DataFrame, band: str, value: str) -> DataFrame:
    """Range, 1% and 99% quantiles (exact, linear), mean and deviation of the finite values of each band."""
    fine = df.where(F.abs(value) < float("inf"))
    out = fine.groupBy(band).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return _with(out, exact_quantiles(fine, [band], value, {"q01": 0.01, "q99": 0.99}), [band]).select(band, "least", "most", "q01", "q99", "mean", "sd")


def flag_counts(df: DataFrame, mask: str) -> DataFrame:
    """One row: rows, and rows with each flag."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(mask).bitwiseAND(F.lit(bit)) != 0).alias(f"n_{name}") for name, bit in FLAGS.items()))


def conflicting(df: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Keys with more than one value of a part that should be the same in all their rows."""
    counts = df.groupBy(key).agg(*(F.countDistinct(p).alias(f"n_{p}") for p in parts))
    over = F.lit(False)
    for p in parts:
        over |= F.col(f"n_{p}") > 1
    return counts.where(over)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def buckets_of(df: DataFrame, key: str, bucket: Column, value: str, names: Sequence[str]) -> DataFrame:
    """For each key the values of each bucket, in order, and the status: the first bucket that has any."""
    lists = df.withColumn("__bucket", bucket).groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.col("__bucket") == b, F.col(value).cast("string")))), ";").alias(b) for b in names))
    status = F.coalesce(*(F.when(F.col(b) != "", F.lit(b)) for b in names))
    return lists.withColumn("status", status)
