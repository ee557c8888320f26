"""What the operators on training text share: durable intermediate tables, components, and byte kernels."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the contracts, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set to a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="selenite-")
        sc.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that every later step has read in full."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now: else they stay until the driver's collector next runs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node reachable.

    Alternates large-star and small-star until nothing changes. A hub's edges are only ever aggregated with a
    partial minimum or joined to a one-row-per-node table that is written first, so that a skewed join can be split.
    Empty edges give an empty result; loops are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(now, tag)
    stamp = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).alias("s")
    before = now.agg(stamp).first()
    while before[0][0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, tag)
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), tag)
        discard(least, large, last)
        after = now.agg(stamp).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


# ---------------------------------------------------------------- byte kernels

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, 1 << 16), _P if which == "p" else _PINV, np.uint64)
        base[0] = 1
        _powers[which] = np.multiply.accumulate(base)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash gives the hash of any span of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("p", len(data)), out=out[1:])
    return out


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, all first bytes before all second ones: sorted numbers then compress well."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(packed: bytes, width: int) -> np.ndarray:
    """The integers of planes()."""
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the same bytes stand."""
    return (sums[end] - sums[start]) * _power("inv", len(sums))[start]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows holding about limit bytes; null texts count as empty."""
    texts = batch.column(column)
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    else:
        width = np.int32
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    offs = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and the text that each is in."""
    white = WHITE[data]
    first, last = ~white, ~white
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = ~white[edges]
    last[edges - 1] = ~white[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) pairs, distinct and sorted: hashes of n words of the A-Z lower-cased text; of fewer words, of all."""
    data = LOWER[data]
    starts, ends, text = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = mix(span_hash(prefix_hash(data), starts, ends) + (ends - starts).astype(np.uint64))
    total = np.zeros(len(words), np.uint64)
    have = np.zeros(len(words), np.int64)
    for k in range(min(n, len(words))):
        same = np.zeros(len(words), bool)
        same[: len(words) - k] = text[k:] == text[: len(words) - k]
        at = np.flatnonzero(same)
        total[at] += words[at + k] * np.uint64(2 * k * k + 6 * k + 3) * _P + np.uint64(k)
        total[at] ^= total[at] >> np.uint64(29)
        have[at] += 1
    begins = np.r_[True, text[1:] != text[:-1]]
    keep = (have == n) | begins
    text, total = text[keep], mix(total[keep] + have[keep].astype(np.uint64))
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (total[1:] != total[:-1])]
    return text[new], total[new]
