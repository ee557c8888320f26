"""Incremental runs: rows whose key and digest are in the log already are left out; the log grows by what was done.

Results and log are written per run, the results first. A run that comes again, after a failure at any point or by
mistake, is held against the log of the runs before it only, works on the same rows and writes the same files in their place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from selenite.operators.joins import pending
from selenite.sources.readers import exists


def _latest(log: DataFrame, key: str) -> DataFrame:
    """(key, digest) of the last run that each key was in: a digest that came before it is stale."""
    return log.groupBy(key).agg(F.max(F.struct("at", "digest")).alias("last")).select(key, "last.digest")


def process_new(now: DataFrame, log: str, work: Callable[[DataFrame], DataFrame], out: str, key: str, text: str, run: str | None = None) -> str:
    """Work on the rows of now that are new or changed; write the results to out and their digests to log, both under the run's name.

    Without a name the run is a new one, and nothing that is there is touched; results of a run that isn't in the log are
    those of one that failed. Gives the run's name.
    """
    spark = now.sparkSession
    stamped = now.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).dropDuplicates([key, "digest"])
    done = spark.read.schema(f"`{key}` {now.schema[key].dataType.simpleString()}, digest string, at long, run string").parquet(log) if exists(spark, log) else None
    run = f"run-{uuid.uuid4().hex}" if run is None else str(run)
    at = 0
    if done is not None:
        last, own = done.agg(F.max("at"), F.max(F.when(F.col("run") == run, F.col("at")))).first()
        at = own if own is not None else (-1 if last is None else last) + 1
        stamped = pending(stamped, _latest(done.where((F.col("at") < at) & (F.col("run") != run)), key), key, "digest")
    work(stamped).write.mode("overwrite").parquet(f"{out}/run={run}")
    stamped.select(key, "digest", F.lit(at).cast("long").alias("at")).write.mode("overwrite").parquet(f"{log}/run={run}")
    return run


def follow(stream: DataFrame, log: str, work: Callable[[DataFrame], DataFrame], out: str, key: str, text: str, checkpoint: str) -> StreamingQuery:
    """process_new for every micro-batch that is there; a batch's run is named by the stream's own id and the batch's number."""

    def one(batch: DataFrame, number: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        process_new(batch, log, work, out, key, text, f"{stream_id}-{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of each kind in windows of time; what is later than the watermark is left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
