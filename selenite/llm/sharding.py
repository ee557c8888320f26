"""Sharding by a hypergeometric communication matrix, with DataFrame functions only.

Rows fall into logical partitions by a hash. For each partition an exact count is drawn for every shard, so that the
shards have sizes at most one apart and every assignment is equally likely: the matrix of a uniform shuffle. Each
partition permutes its rows and deals the first so many to the first shard, and so on; after the exchange each shard
permutes what it got, piece by piece.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows meant for a logical partition, and the most partitions: with the shards they bound the matrix.
PARTITION_ROWS, MOST_PARTITIONS = 20_000, 8_192


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good. Inverts the distribution from its mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (draws - up) / (bad - draws + up + 1)
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - draws + down) / (draws - down + 1)
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; shard sizes are at most one apart, the larger ones first."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, left, places = [], n, sum(room)
        for s in range(shards):
            places -= room[s]
            row.append(hypergeometric(rng, room[s], places, left) if s < shards - 1 else left)
            left -= row[-1]
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _literal(spark, rows: list, schema: str) -> DataFrame:
    """A small bounded table as a literal of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def shards_of(docs: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs(doc_id, text): the law is `rows`.

    size is the text's bytes plus 1, a null text having none and the CRC of an empty one. Slots are gapless from 0 in
    each shard. Where a row goes follows from seed, doc_id and CRC; equal texts spread like any rows, and rows repeated
    whole take neighbouring places. Only counts per partition reach the driver: MOST_PARTITIONS numbers at most. Other
    columns are not read. No rows give an empty result.
    """
    spark = docs.sparkSession
    total = docs.select(F.lit(1)).count()
    partitions = max(min(MOST_PARTITIONS, -(-total // PARTITION_ROWS)), 4 * shards)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    salted = lambda k: F.xxhash64(F.lit(seed * 31 + k), "doc_id", "text_crc32")
    rows = materialize(rows.select("*", F.pmod(salted(0), F.lit(partitions)).cast("int").alias("p")), "rows")
    found = {r.p: r.n for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([found.get(p, 0) for p in range(partitions)], shards, seed)
    ends, begins = [], [0] * shards
    for p, row in enumerate(matrix):
        upto = [sum(row[: s + 1]) for s in range(shards)]
        ends.append({"m": p, "upto": upto})
    dealt = _literal(spark, ends, "m int, upto array<bigint>") if total else _literal(spark, [], "m int, upto array<bigint>")
    place = F.row_number().over(Window.partitionBy("p").orderBy(salted(1), "doc_id", "text_crc32")).cast("long")
    local = rows.select("*", place.alias("place")).join(F.broadcast(dealt), F.col("p") == F.col("m"))
    sharded = local.select("doc_id", "size", "text_crc32", F.size(F.filter("upto", lambda x: x < F.col("place"))).alias("shard"))
    # The second permutation: by a key whose high part is a piece of the shard; pieces follow each other.
    pieces = max(4, partitions // shards)
    sharded = materialize(sharded.withColumn("second", salted(2)).withColumn("piece", F.pmod(F.xxhash64("second", F.lit(seed)), F.lit(pieces)).cast("int")), "sharded")
    sizes = {(r.shard, r.piece): r.n for r in sharded.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = []
    for s in range(shards):
        for k in range(pieces):
            starts.append({"s": s, "k": k, "start": begins[s]})
            begins[s] += sizes.get((s, k), 0)
    starts = _literal(spark, starts, "s int, k int, start bigint")
    slot = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("second", "doc_id", "text_crc32")) - 1
    out = sharded.select("*", slot.alias("at")).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("piece") == F.col("k")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))
