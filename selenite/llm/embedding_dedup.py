"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by rounds of random signs and fast Hadamard transforms; the axis nearest to the result, with its
sign, is a hash. HASHES of them make the bucket of a table, and a vector stands in its own bucket and in those with one
hash replaced by the second nearest axis. Vectors that meet in a bucket are candidates and are verified by cosine in
double precision. A pair counts only in the smallest bucket that both share. Small buckets are joined; large ones are
compared block by block, and give counts and a spanning forest instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix

#: Tables, hashes of a bucket, members up to which a bucket is joined, members of a block.
TABLES, HASHES, SMALL, BLOCK = 8, 3, 16, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, in place; the length is a power of 2."""
    n, width = x.shape
    h = 1
    while h < width:
        v = x.reshape(n, width // (2 * h), 2, h)
        a, b = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
        v[:, :, 0], v[:, :, 1] = a, b
        h *= 2
    return x


def bucket_keys(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = 5) -> np.ndarray:
    """The buckets of each vector, (1 + hashes) of each table, before labels are mixed in."""
    n, dim = vectors.shape
    width = 1 << max(1, int(dim - 1).bit_length())
    rng = np.random.default_rng([seed, width])
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = []
    for table in range(tables):
        near, second = [], []
        for _ in range(hashes):
            x = padded.copy()
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(x)
            first = size.argmax(1)
            size[np.arange(n), first] = -1
            other = size.argmax(1)
            signed = lambda at, x=x: (2 * at + (x[np.arange(n), at] < 0)).astype(np.uint64)
            near.append(signed(first))
            second.append(signed(other))
        for probe in range(-1, hashes):
            key = np.full(n, table + 1, np.uint64)
            for k in range(hashes):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (second[k] if k == probe else near[k]))
            out.append(key)
    return np.stack(out, 1)


def _keyed(batches: Iterator[pa.RecordBatch], tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begins = np.r_[0, np.cumsum(lengths)]
        label = batch.column("label").to_numpy(zero_copy_only=False).view(np.uint64)
        for width in np.unique(lengths):
            for at in np.array_split(np.flatnonzero(lengths == width), -(-int((lengths == width).sum()) // 2000)):
                x = flat[begins[at][:, None] + np.arange(width)]
                keys = mix(bucket_keys(x, tables, hashes) + mix(label[at] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(width))[:, None]).view(np.int64)
                keys.sort(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(take), batch.column("copies").take(take), vectors.take(take), lists], ["node", "copies", "vector", "keys"])


def _block(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Link counts and a spanning forest of the links between two chunks of a bucket (or within one)."""
    bucket, i, j = frame["bucket"].iloc[0], frame["i"].iloc[0], frame["j"].iloc[0]
    frame = frame.drop_duplicates("node")
    x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    link = (x @ x.T) / np.outer(norm, norm) >= least
    held = [k[: np.searchsorted(k, bucket)] for k in frame["keys"]]
    row = np.repeat(np.arange(len(held)), [len(k) for k in held])
    _, col, seen = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    often = seen > 1
    if often.any():
        dense = np.zeros((len(held), int(often.sum())), np.float32)
        pick = often[col]
        dense[row[pick], (np.cumsum(often) - 1)[col[pick]]] = 1
        link &= (dense @ dense.T) == 0  # those that share a smaller bucket count there
    np.fill_diagonal(link, False)
    if i != j:
        chunk = frame["chunk"].to_numpy()
        link &= chunk[:, None] != chunk[None, :]
    ids, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    counts = link @ copies
    root, out = np.arange(len(ids)), []
    for a, b in np.argwhere(np.triu(link)):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    tree, linked = np.array(out, np.int64).reshape(-1, 2), np.flatnonzero(counts)
    ends = np.r_[ids[tree[:, 1]], np.full(len(linked), None, object)]
    return pd.DataFrame({"a": np.r_[ids[tree[:, 0]], ids[linked]], "b": ends, "n": np.r_[np.zeros(len(tree), np.int64), counts[linked].astype(np.int64)]})


def _cosine(x: Column, y: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, hashes: int = HASHES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine is at least `least`.
    Null, empty and zero vectors and those with null or non-finite components link with nothing. Equal vectors of a label
    are one class from the start, whatever their number, and so are those that differ by a power of 2: they link with
    each other and count severally. Labels of any type are known by 64 bits of hash, classes by 128. Components of any
    finite size are right, as a vector is first divided by a power of 2. A row that links with nothing is its own
    component; component_id is the smallest non-null vec_id. Other columns are not read.
    """
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    most = F.array_max(F.transform("vector", F.abs))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", F.isnull) & (most > 0) & (most < float("inf"))
    rows = rows.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label")).alias("label"), "vector", F.pow(F.lit(2.0), F.floor(F.log2(most))).alias("unit"))
    scaled = F.when(F.col("label").isNotNull(), F.transform("vector", lambda v: v / F.col("unit") + 0.0))
    rows = rows.select("vec_id", "label", scaled.alias("vector"))
    both_hashes = F.concat(F.hex(F.xxhash64("label", "vector")), F.lit("-"), F.hex(F.xxhash64("vector", "label", F.lit(1))))
    rows = rows.select("vec_id", "label", "vector", F.when(F.col("label").isNotNull(), both_hashes).alias("node"))
    classes = rows.where("node is not null").groupBy("label", "vector").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    classes = materialize(classes, "classes")
    keyed = materialize(classes.select("node", "label", "vector", "copies").mapInArrow(partial(_keyed, tables=tables, hashes=hashes), "node string, copies long, vector array<double>, keys array<long>"), "keyed")
    entries = keyed.select("node", F.explode(F.array_distinct("keys")).alias("bucket"))
    counts = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    shared = materialize(entries.join(counts, "bucket"), "shared")

    one = shared.where(F.col("m") <= SMALL)
    pairs = one.alias("p").join(one.alias("q"), "bucket").where("p.node < q.node").select("bucket", F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    side = lambda s: keyed.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("copies", "vector", "keys")))
    tried = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("bucket") == F.array_min(F.array_intersect("keys_a", "keys_b")))
    found = tried.where(_cosine(F.col("vector_a"), F.col("vector_b")) >= least).select("a", "b", "copies_a", "copies_b")
    both = found.select(F.inline(F.array(F.struct("a", F.col("b"), F.lit(0).cast("long").alias("n")), F.struct("a", F.lit(None).cast("string").alias("b"), F.col("copies_b").alias("n")), F.struct(F.col("b").alias("a"), F.lit(None).cast("string").alias("b"), F.col("copies_a").alias("n")))))

    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    at = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j")))
    large = shared.where(F.col("m") > SMALL).select("bucket", "node", chunk.alias("chunk"), F.explode(at).alias("at")).select("bucket", "node", "chunk", "at.i", "at.j")
    blocks = large.join(keyed, "node").groupBy("bucket", "i", "j").applyInPandas(lambda frame: _block(frame, least), "a string, b string, n long")
    links = materialize(both.unionByName(blocks), "links")

    roots = connected_components(links.where("b is not null").select("a", "b"))
    n_links = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    named = classes.select("node", "vec_id", "copies").join(roots, "node", "left").join(n_links, "node", "left")
    named = materialize(named.select("node", "vec_id", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    lows = materialize(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "lows")
    named = materialize(named.join(lows, "root").select("node", "n_links", "component_id"), "names")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS size FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN l ON l.a = r.node WHERE r.root < l.b),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
c AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON node = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""
