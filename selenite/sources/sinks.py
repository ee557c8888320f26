"""Sinks: tables with guards, manifests, tidy data of plots, reports, task lists. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import csv_table, exists


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists", sentinels: dict[str, float | str] | None = None) -> None:
    """The columns in order, others ignored, nulls as their sentinels. Appending needs the same header."""
    sentinels = sentinels or {}
    if mode == "append" and exists(df.sparkSession, path) and csv_table(df.sparkSession, path).columns != list(columns):
        raise ValueError(f"{path} has other columns")
    out = df.select(*(F.coalesce(F.col(c), F.lit(sentinels[c])).alias(c) if c in sentinels else F.col(c) for c in columns))
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def refuse_existing(spark: SparkSession, paths: Sequence[str], overwrite: bool) -> None:
    if not overwrite and (there := [p for p in paths if exists(spark, p)]):
        raise FileExistsError(f"outputs exist: {', '.join(there)}")


def manifest(spark: SparkSession, tables: dict[str, DataFrame], parameters: dict[str, str], warnings: DataFrame | None = None, most: int = 100, files: DataFrame | None = None) -> DataFrame:
    """One row: counts of the tables, parameters, the first warnings, and the digests of the files(path, sha256) read and
    written; write.json makes it a file."""
    counts = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    row = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))
    row = row.withColumn("parameters", F.create_map(*(F.lit(str(x)) for p in sorted(parameters.items()) for x in p)))
    if warnings is not None:
        first = warnings.orderBy("warning").limit(most).agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
        row = row.withColumn("warnings", first.scalar())
    if files is not None:
        held = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("sha256"))
        row = row.withColumn("sha256", held.scalar())
    return row


def write_layers(df: DataFrame, path: str, line: str, layers: dict[str, str], block: int = 256, mode: str = "errorifexists") -> None:
    """A raster as Parquet by blocks of lines, each layer in the type that it is given (float, short, ...); other columns but
    the line and `sample` are left out."""
    typed = df.select(line, "sample", *(F.col(c).cast(kind).alias(c) for c, kind in layers.items()), F.floor(F.col(line) / block).cast("int").alias("block"))
    typed.repartition("block").sortWithinPartitions("block", line, "sample").write.mode(mode).partitionBy("block").parquet(path)


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def ribbon(df: DataFrame, series: str, x: str, mean: str, sd: str) -> DataFrame:
    """Data of a plot of means with their deviations: series, x, y, low, high."""
    return df.select(F.col(series).cast("string").alias("series"), F.col(x).alias("x"), F.col(mean).alias("y"), (F.col(mean) - F.coalesce(sd, F.lit(0.0))).alias("low"), (F.col(mean) + F.coalesce(sd, F.lit(0.0))).alias("high"))


def report(df: DataFrame, keys: Sequence[str], order: str, line: str) -> DataFrame:
    """The lines of each key in order as one text."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"))


def task_lines(df: DataFrame, url: str, id_column: str) -> DataFrame:
    """One tab-separated line per address with its ids; addresses with tabs or line feeds stop the job."""
    checked = F.when(F.col(url).rlike(r"[\t\n\r]"), F.raise_error(F.lit("an address has a tab or line feed")).cast("string")).otherwise(F.col(url))
    return df.groupBy(checked.alias("u")).agg(F.array_join(F.array_sort(F.collect_set(F.col(id_column).cast("string"))), ",").alias("ids")).select(F.concat_ws("\t", "u", "ids").alias("value"))
