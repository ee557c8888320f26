"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set holds the hashes of its distinct n-word shingles. The global order puts rare n-grams first: by the
frequency class of the n-gram, then by its hash. All sets are cut into fragments of the hash range, and each fragment
finds the classes of its n-grams apart from the others. An n-gram of one set alone adds nothing to any overlap; a set
with so many of these that it cannot reach the threshold goes no further. Sets that share an n-gram of their prefixes
are candidates (no link is lost: the first common n-gram of two linked sets stands in both prefixes). Their overlaps
are counted in each band of the global order apart and summed per pair.

No n-gram lists its members' pairs: each member is first checked against one leader; only n-grams whose members then
still lie in different components are compared in full, short lists as pairs and long ones as blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, free_shuffles, from_planes, materialize, mix, planes, shingle_sets, text_slices

#: Members of an n-gram compared as pairs, and sets and n-grams of a block beyond that.
SMALL, BLOCK, BLOCK_GRAMS = 24, 512, 1 << 18
#: Text bytes of a fragment, the least and the most fragments (an id keeps 40 bits of hash below its fragment).
FRAGMENT_BYTES, FRAGMENTS = 24 << 20, (256, 1 << 17)
#: N-grams of a slice (what a task holds at a time) and its most sets; an n-gram in so many sets of one slice is hot.
SLICE_GRAMS, SLICE_SETS, HOT = 1_000_000, 60_000, 64
#: The frequency class of hot n-grams, and the first class of each band of the global order in which overlaps are counted.
HOT_CLASS = 62
BANDS = (0, 2, 4, HOT_CLASS)
_ALL_HOT = 0xFFFF


def _set_ids(doc: np.ndarray, sets: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit fingerprint of each document's set; zeros for empty sets."""
    sizes = np.bincount(doc, minlength=n_docs).astype(np.int64)
    out = np.zeros((n_docs, 2), np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        if len(doc):
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[doc[at], k] = np.add.reduceat(mix(sets ^ np.uint64(salt)), at)
        out[:, k] = np.where(sizes > 0, mix(out[:, k] + sizes.astype(np.uint64)), 0)
    return sizes, out


def _binary16(ids: np.ndarray) -> pa.Array:
    """Rows of two numbers as 16-byte values."""
    offsets = np.arange(0, 16 * (len(ids) + 1), 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids).tobytes())])


def _profiles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch, "text"):
            sizes, nodes = _set_ids(*shingle_sets(data, offs, n), hi - lo)
            kept = [batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), _binary16(nodes)], [*(c for c in batch.schema.names if c != "text"), "n_shingles", "node"])


# ------------------------------------------------------------ the global order

_SPREAD = "fragment int, slice binary, grams binary, places binary, nodes binary, sizes binary"


def _spread(batches: Iterator[pa.RecordBatch], n: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """The sets of each slice, cut into fragments: its n-grams there with the places of their sets in the slice.

    One row of a slice holds its sets' ids and sizes and the n-grams that are hot in it; of these, fragments only get
    the n-gram. Sets that are equal within a slice are one.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    limit = int(np.clip(64 * fragments, SLICE_GRAMS, 8 * SLICE_GRAMS))

    def flush() -> Iterator[pa.RecordBatch]:
        nodes, sizes = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        base = np.cumsum([0, *(len(x[3]) for x in held)])
        doc, sets = np.concatenate([x[0] + b for x, b in zip(held, base, strict=False)]), np.concatenate([x[1] for x in held])
        held.clear()
        order = np.lexsort((nodes[:, 1], nodes[:, 0]))
        new = np.r_[True, (nodes[order][1:] != nodes[order][:-1]).any(1)] & (sizes[order] > 0)
        place = np.full(len(nodes), -1, np.int64)
        place[order[new]] = np.arange(new.sum())
        nodes, sizes = nodes[order[new]], sizes[order[new]]
        use = place[doc] >= 0
        place, sets = place[doc[use]], sets[use]
        if not len(sets):
            return
        fragment = ((sets >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        gram = (fragment << np.uint64(40)) | (sets & np.uint64((1 << 40) - 1))
        order = np.argsort(gram, kind="stable")
        gram, place = gram[order], place[order]
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        count = np.diff(np.r_[first, len(gram)])
        hot = np.repeat(count >= HOT, count)
        slice_id = mix(np.array([nodes[:, 0].sum() + np.uint64(len(nodes)), nodes[:, 1].sum() ^ np.uint64(len(gram))])).tobytes()
        about = (int(mix(np.frombuffer(slice_id, np.uint64)[:1])[0] % np.uint64(fragments)), slice_id, planes(gram[hot], 8), planes(place[hot].view(np.uint64), 2), nodes.tobytes(), sizes.astype("<i4").tobytes())
        only = ~hot
        only[first] = True
        place = np.where(hot, _ALL_HOT, place)[only].view(np.uint64)
        gram = gram[only]
        at = (gram >> np.uint64(40)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rows = [about, *((int(at[a]), slice_id, planes(gram[a:b], 5), planes(place[a:b], 2), None, None) for a, b in zip(cut, np.r_[cut[1:], len(at)], strict=True))]
        kinds = (pa.int32(), *[pa.binary()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["fragment", "slice", "grams", "places", "nodes", "sizes"])

    grams = sets_held = 0
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch, "text"):
            if held and sets_held + hi - lo > SLICE_SETS:
                yield from flush()
                grams = sets_held = 0
            for part in range(lo, hi, SLICE_SETS):  # empty texts may be many in one run of bytes
                end = min(hi, part + SLICE_SETS) - lo
                doc, sets = shingle_sets(data[offs[part - lo] : offs[end]], offs[part - lo : end + 1] - offs[part - lo], n)
                sizes, nodes = _set_ids(doc, sets, end - part + lo)
                held.append((doc, sets, nodes, sizes))
                grams, sets_held = grams + len(sets), sets_held + len(sizes)
                if grams >= limit or sets_held >= SLICE_SETS:
                    yield from flush()
                    grams = sets_held = 0
    if held:
        yield from flush()


def _classed(table: pa.Table) -> pa.Table:
    """The n-grams of one fragment that more than one set has, with their frequency classes, back to their slices."""
    rows = table.select(["fragment", "slice", "grams", "places", "nodes", "sizes"]).to_pylist()
    out = [(r["slice"], planes(from_planes(r["grams"], 8) | np.uint64(HOT_CLASS << 57), 8), r["places"], r["nodes"], r["sizes"]) for r in rows if r["nodes"] is not None]
    rows = [r for r in rows if r["nodes"] is None]
    if rows:
        gram = np.concatenate([from_planes(r["grams"], 5) for r in rows])
        place = np.concatenate([from_planes(r["places"], 2) for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r["places"]) // 2 for r in rows])
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
        count = np.diff(np.r_[first, len(gram)])
        hot = np.maximum.reduceat(place[order] == _ALL_HOT, first)
        kind = np.where(hot, HOT_CLASS, np.minimum(np.log2(count).astype(np.int64), HOT_CLASS - 1)).astype(np.uint64)
        of = np.empty(len(gram), np.uint64)
        of[order] = np.repeat(kind, count)
        back = np.flatnonzero((of > 0) & (place != _ALL_HOT))
        ids = (of[back] << np.uint64(57)) | (np.uint64(rows[0]["fragment"]) << np.uint64(40)) | gram[back]
        ends = np.flatnonzero(np.r_[row[back][1:] != row[back][:-1], True][: len(back)]) + 1
        for a, b in zip(np.r_[0, ends[:-1]], ends, strict=False):
            out.append((rows[row[back[a]]]["slice"], planes(ids[a:b], 8), planes(place[back[a:b]], 2), None, None))
    return pa.table([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["slice", "grams", "places", "nodes", "sizes"])


def _possible(table: pa.Table, num: int, den: int) -> pa.Table:
    """(node, n, grams) of the sets of one slice that may link: n-grams that others have too, in the global order."""
    rows = table.to_pylist()
    about = next(r for r in rows if r["nodes"] is not None)
    nodes, sizes = np.frombuffer(about["nodes"], np.uint64).reshape(-1, 2), np.frombuffer(about["sizes"], "<i4").astype(np.int64)
    grams = np.concatenate([from_planes(r["grams"], 8) for r in rows])
    place = np.concatenate([from_planes(r["places"], 2) for r in rows]).astype(np.int64)
    order = np.lexsort((grams, place))
    grams, place = grams[order], place[order]
    new = np.r_[True, (place[1:] != place[:-1]) | (grams[1:] != grams[:-1])][: len(grams)]  # a slice met twice
    grams, place = grams[new], place[new]
    shared = np.bincount(place, minlength=len(sizes))
    able = (sizes > 0) & (shared >= -(-num * sizes // den))
    keep = able[place]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(shared[able])].astype(np.int32)), pa.array(grams[keep].view(np.int64)))
    return pa.table([_binary16(nodes[able]), pa.array(sizes[able]), lists], ["node", "n", "grams"])


# ------------------------------------------------------------ candidates and overlaps


def _banded(sets: DataFrame) -> DataFrame:
    """(node, band, n, grams): the sets cut at the bands of the global order."""
    between = lambda low, end: F.filter("grams", lambda g: (F.shiftrightunsigned(g, 57) >= low) & (F.shiftrightunsigned(g, 57) < end))
    cuts = F.array(*(F.struct(F.lit(i).alias("band"), between(low, end).alias("grams")) for i, (low, end) in enumerate(zip(BANDS, [*BANDS[1:], 64], strict=True))))
    return sets.select("node", "n", F.explode(cuts).alias("cut")).select("node", F.col("cut.band").alias("band"), "n", F.col("cut.grams").alias("grams")).where(F.size("grams") > 0)


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted in each band and summed, reach the threshold."""
    one = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    two = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    one = _banded(one).select(F.col("node").alias("a"), "band", F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    two = _banded(two).select(F.col("node").alias("b"), "band", F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    counted = pairs.join(one, "a").join(two, ["b", "band"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).cast("long").alias("common"))
    summed = counted.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("common").alias("common"))
    return summed.where(den * F.col("common") >= num * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _block(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """A spanning forest of the links within a block pair: partial overlaps per band, summed."""
    frame = frame.drop_duplicates("node")
    ids, size = frame["node"].to_list(), frame["n"].to_numpy()
    grams = np.concatenate(frame["grams"].to_list())
    row = np.repeat(np.arange(len(ids)), frame["grams"].map(len))
    band = np.searchsorted(np.array(BANDS), grams >> 57, "right")
    common = np.zeros((len(ids), len(ids)), np.float32)
    for part in range(1, len(BANDS) + 1):
        r = row[band == part]
        _, g, seen = np.unique(grams[band == part], return_inverse=True, return_counts=True)
        often = seen > 1
        at = np.cumsum(often) - 1
        r, g = r[often[g]], at[g[often[g]]]
        for low in range(0, int(often.sum()), 8192):
            pick = (g >= low) & (g < low + 8192)
            dense = np.zeros((len(ids), min(8192, int(often.sum()) - low)), np.float32)
            dense[r[pick], g[pick] - low] = 1
            common += dense @ dense.T
    inter = common.astype(np.int64)
    link = np.triu(den * inter >= num * (size[:, None] + size[None, :] - inter), 1)
    root = np.arange(len(ids))
    out = []
    for a, b in np.argwhere(link):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[min(a, b)], ids[max(a, b)]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="object")


def _node_links(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what is linked, between the different sets of texts(text), by node id."""
    spark = texts.sparkSession
    bytes_in = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fragments = int(np.clip(-(-bytes_in // FRAGMENT_BYTES), *FRAGMENTS))
    spread = texts.mapInArrow(partial(_spread, n=n, fragments=fragments), _SPREAD)
    classed = spread.groupBy("fragment").applyInArrow(_classed, "slice binary, grams binary, places binary, nodes binary, sizes binary")
    possible = classed.groupBy("slice").applyInArrow(lambda table: _possible(table, num, den), "node binary, n long, grams array<long>")
    sets = materialize(possible.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "sets")
    free_shuffles(spark)

    # Prefixes: the longer of two linked sets has them in common for num / den of its n-grams, the shorter for more.
    alone = F.col("n") - F.size("grams")
    reach = (F.col("n") - F.ceil(num * F.col("n") / F.lit(den)) + 1 - alone).cast("int")
    near = (F.col("n") - F.ceil(2 * num * F.col("n") / F.lit(num + den)) + 1 - alone).cast("int")
    listed = sets.select("node", "n", near.alias("near"), F.posexplode(F.slice("grams", F.lit(1), F.greatest(reach, F.lit(0)))).alias("at", "key")).select("key", "node", "n", (F.col("at") < F.col("near")).alias("short"))
    lists = listed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(F.col("short"), F.col("node"))).alias("leader")).where("m > 1 and leader is not null").select("key", "leader")
    members = materialize(listed.join(lists, "key"), "members")

    # Each set against the leader with which it shares the most keys.
    best = members.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))
    first = materialize(best.select(F.col("node").alias("a"), F.col("leader").alias("b")), "first")
    links = materialize(_linked(first, sets, num, den), "links")
    now = materialize(connected_components(links), "components")
    free_shuffles(spark)

    # Keys whose members are not yet all connected, compared in full; one key of those with the same members.
    at = members.join(now, "node", "left").select("key", "node", "n", "short", F.coalesce("root", "node").alias("root"))
    sums = [F.sum(F.xxhash64("node", "short", F.lit(salt)) % (1 << 40)).alias(f"s{salt}") for salt in (1, 2, 3)]
    mixed = at.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.min("root").alias("lo"), F.max("root").alias("hi"), *sums).where("lo <> hi")
    mixed = materialize(mixed.groupBy("m", "weight", "s1", "s2", "s3").agg(F.min("key").alias("key")), "mixed")
    open_at = materialize(at.join(mixed.select("key", "m", "weight"), "key"), "open")
    small = open_at.where(F.col("m") <= SMALL)
    within = (num * F.greatest("p.n", "q.n") <= den * F.least("p.n", "q.n")) & (F.col("p.short") | F.col("q.short"))
    pairs = small.alias("p").join(small.alias("q"), "key").where("p.node < q.node and p.root <> q.root").where(within).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    more = _linked(materialize(pairs, "pairs"), sets, num, den)
    chunks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("weight") / BLOCK_GRAMS)).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs_of = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j")))
    large = open_at.where(F.col("m") > SMALL).select("key", "node", F.explode(pairs_of).alias("at")).select("key", "at.i", "at.j", "node")
    blocks = large.join(sets, "node").groupBy("key", "i", "j").applyInPandas(lambda frame: _block(frame, num, den), "a binary, b binary")
    links = materialize(links.unionByName(more).unionByName(blocks), "links")
    discard(sets, members, first, now, mixed, open_at)
    return links


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The columns of docs but text, n_shingles, root (a node of the component, null without words) and component_id."""
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    profile = materialize(docs.mapInArrow(partial(_profiles, n=n), f"{passed}, n_shingles long, node binary"), "profile")
    roots = connected_components(_node_links(docs.select("text"), n, num, den))
    free_shuffles(docs.sparkSession)

    sets_of = profile.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = sets_of.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = materialize(named.join(least, "root").select("node", "root", "component_id"), "names")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return profile.join(named, "node", "left").select(*(c for c in docs.columns if c != "text"), "n_shingles", "root", own.alias("component_id"))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    Sets link when den * intersection >= num * union. Equal sets are one node from the start, known by 128 bits of
    hash. A null text is empty; empty sets link with nothing. component_id is the smallest non-null doc_id reachable
    by links, and null if there is none; of an empty set, its own doc_id. Other columns of docs are not read.
    """
    return _components(docs.select("doc_id", "text"), n, num, den).drop("root")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (nulls last).

    Rows without words all stay, one of each id and text. Other columns are kept as they are, of repeated rows those of
    any one; none may be named __key or __check.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text")).withColumn("__check", F.xxhash64("text", "doc_id", F.lit(1)))
    found = materialize(_components(keyed.select("doc_id", "text", "__key", "__check"), n, num, den), "found")
    alone = F.col("root").isNull()
    group = (F.col("root"), F.when(alone, F.col("__key")).alias("k"), F.when(alone, F.col("__check")).alias("c"))
    least = found.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key", "__check")).alias("first"))
    keys = materialize(least.select("first.__key", "first.__check"), "keep")
    free_shuffles(docs.sparkSession)
    return keyed.join(keys, ["__key", "__check"], "left_semi").dropDuplicates(["__key", "__check"]).drop("__key", "__check")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
  WHERE 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * common >= 90 * (n + m - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id FROM s JOIN least ON node = doc_id
"""
