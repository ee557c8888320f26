"""Removal of repeated substrings by bucket-pointer refinement over synchronised suffixes.

A suffix array of every byte isn't needed to find strings of LENGTH bytes that occur twice: each such string is a window,
and its smallest q-gram (the leftmost one) is at the same place in every occurrence. The suffixes at these places are
sorted into initial buckets by their q-gram. A bucket is sorted again by an identifier of the whole context that its
windows reach over, which settles all windows of the suffixes that agree. Of what is left, each bucket is refined on its
bytes: every place gets the rank of its 8 bytes as its bucket pointer, places are sorted by their own pointer and that
of the later offset where the known bytes end, and the ranks of that sort are the pointers of the next pass, until they
stand for LENGTH bytes; equal pointers then are equal bytes. Suffixes that are settled, or alone in their bucket, never
come up again. A q-gram with very many different contexts is no bucket: its windows are counted one by one, by 128 bits
of hash, with partial counts before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, prefix_hash, span_hash, text_slices

#: Bytes of a q-gram, entries after which a task writes out, text bytes of a bucket, contexts beyond which a q-gram is hot.
GRAM, HELD, BUCKET_BYTES, HOT = 64, 600_000, 16 << 20, 2000
_FIELDS = ("g", "c", "key", "at", "n", "d", "dup")
_KINDS = dict(zip(_FIELDS, (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32, np.int8), strict=True))
_PACKED = "bucket int, kind int, " + ", ".join(f"{f} binary" for f in _FIELDS)
_FOUND = "kind int, key long, at int, n int, d int, g long"
FORWARD, SHARED, MARK, SETTLED = range(4)


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with a common smallest q-gram: text, first window, windows, offset of the gram, bucket, context."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    gram = min(GRAM, length)
    width = length - gram + 1
    sums = prefix_hash(data)
    place = np.arange(len(data) - gram + 1)
    grams = mix(span_hash(sums, place, place + gram))
    low, index = (grams >> np.uint64(32)).astype(np.uint32), place.astype(np.int32)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        right, left = low[step:], low[: len(low) - step]
        take = right < left
        low, index = np.where(take, right, left), np.where(take, index[step:], index[: len(index) - step])
        reach += step
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(index)]
    valid = np.flatnonzero(np.arange(len(index)) + length <= offs[1:][text])
    if not len(valid):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = index[valid]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[valid][1:] != text[valid][:-1])])
    begin, count = valid[first], np.diff(np.r_[first, len(valid)])
    d = at[first] - begin
    context = mix(span_hash(sums, begin, begin + count - 1 + length) + (d * 1009 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text[begin], begin - offs[text[begin]], count, d, grams[at[first]], context


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(x) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(kind: int, bucket: np.ndarray, cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    if not len(cut):
        return
    ends = np.r_[cut[1:], len(bucket)]
    columns = [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32))]
    for f in _FIELDS:
        values = cols[f][order].astype(_KINDS[f]) if f in cols else None
        columns.append(pa.array([None if values is None else values[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()))
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", *_FIELDS])


def _starts(x: np.ndarray) -> np.ndarray:
    return np.r_[True, x[1:] != x[:-1]][: len(x)]


def _entries(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Suffixes for the buckets. Those that agree with another here are settled here, and one of them goes on; where a
    bucket has several contexts here they are known to share it, and go on by context, so that no bucket gets many."""
    held: list[tuple] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        g, c, key, at, n, d = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((c, g))
        e = {"g": g[order], "c": c[order], "key": key[order], "at": at[order], "n": n[order], "d": d[order]}
        first = _starts(e["g"]) | _starts(e["c"])
        size = np.diff(np.r_[np.flatnonzero(first), len(first)])
        dup = np.repeat(size > 1, size)
        settled = {f: v[dup] for f, v in e.items() if f in ("key", "at", "n")}
        yield from _pack(SETTLED, _bucket(settled["key"].view(np.uint64), buckets), settled)
        one = {f: v[first] for f, v in e.items()} | {"dup": size > 1}
        head = _starts(one["g"])
        several = np.repeat(np.diff(np.r_[np.flatnonzero(head), len(head)]) > 1, np.diff(np.r_[np.flatnonzero(head), len(head)]))
        alone = {f: v[~several] for f, v in one.items()}
        yield from _pack(FORWARD, _bucket(alone["g"], buckets), alone)
        many = {f: v[several] for f, v in one.items()}
        yield from _pack(SHARED, _bucket(many["c"], buckets), many)
        marks = {"g": one["g"][several & head]}
        yield from _pack(MARK, _bucket(marks["g"], buckets), marks)

    for batch in batches:
        keys = batch.column("key").to_numpy()
        for lo, hi, data, offs in text_slices(batch, "text"):
            text, at, n, d, g, c = anchors(data, offs, length)
            if len(text):
                held.append((g, c, keys[lo:hi][text], at, n, d))
                count += len(text)
            if count > HELD:
                yield from flush()
                count = 0
    if count:
        yield from flush()


def _refine(table: pa.Table) -> pa.Table:
    """Settled windows (kind 0), and one suffix of each context that is left in a bucket with others (kind 1)."""
    got: dict[int, dict[str, list]] = {k: {f: [] for f in _FIELDS} for k in range(4)}
    columns = [table.column(f).to_pylist() for f in _FIELDS]
    for i, kind in enumerate(table.column("kind").to_pylist()):
        for f, column in zip(_FIELDS, columns, strict=True):
            if column[i] is not None:
                got[kind][f].append(np.frombuffer(column[i], _KINDS[f]))
    cat = lambda kind, f: np.concatenate(got[kind][f]) if got[kind][f] else np.zeros(0, _KINDS[f])
    e = {f: np.concatenate([cat(FORWARD, f), cat(SHARED, f)]) for f in _FIELDS}
    shared = np.r_[np.zeros(len(cat(FORWARD, "g")), bool), np.ones(len(cat(SHARED, "g")), bool)]
    order = np.lexsort((e["c"], e["g"]))
    e, shared = {f: v[order] for f, v in e.items()}, shared[order]
    first = _starts(e["g"]) | _starts(e["c"])
    size = np.diff(np.r_[np.flatnonzero(first), len(first)])
    settled = np.repeat(size > 1, size) & (e["dup"] == 0)
    head = _starts(e["g"])
    group = np.cumsum(head) - 1
    contexts = np.bincount(group, first, int(group[-1]) + 1 if len(group) else 0)
    open_ = first & (shared | (contexts[group] > 1) | np.isin(e["g"], cat(MARK, "g")))
    # a shared suffix may stand second in its context
    if len(first):
        class_of = np.cumsum(first) - 1
        any_shared = np.bincount(class_of, shared, int(class_of[-1]) + 1) > 0
        open_ |= first & any_shared[class_of]
    out = [(k, *(e[f][pick] for f in ("key", "at", "n", "d")), e["g"][pick].view(np.int64)) for k, pick in ((0, settled), (1, open_))]
    done = [cat(SETTLED, f) for f in ("key", "at", "n")]
    out.append((0, *done, np.zeros(len(done[0]), np.int32), np.zeros(len(done[0]), np.int64)))
    kinds = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out])
    return pa.table([kinds, *(np.concatenate([x[k] for x in out]) for k in range(1, 6))], ["kind", "key", "at", "n", "d", "g"])


def _bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode()


def _contexts(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each suffix that is left, for its bucket; those of hot q-grams have none."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "key", "at", "bytes"])
    for batch in batches:
        keys, lists = batch.column("key").to_pylist(), batch.column("open")
        rows, held = [], 0
        for i, key in enumerate(keys):
            text = batch.column("text")[i].as_py()
            data = text if isinstance(text, bytes) else (text or "").encode()
            for s in lists[i].as_py():
                rows.append((None if s["hot"] else s["g"] % buckets, key, s["at"], data[s["at"] : s["at"] + s["n"] - 1 + length]))
                held += len(rows[-1][3])
            if held > 4 << 20:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)


def _hot_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(window, key, at): every window of these contexts, by 128 bits of hash."""
    kinds = (pa.binary(), pa.int64(), pa.int32())
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            rows = []
            for key, at, data in zip(*(part.column(c).to_pylist() for c in ("key", "at", "bytes")), strict=True):
                rows += [(xxhash.xxh3_128_digest(data[i : i + length]), key, at + i) for i in range(len(data) - length + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["window", "key", "at"])


def pointers(raw: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of the places of raw for `length` bytes: equal ones are equal bytes, however often they occur.

    Each pass sorts by the pointer of a place and the one of a later offset, both of the pass before.
    """
    known = min(8, length)
    n = len(raw) - known + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide = np.ascontiguousarray(np.r_[raw, np.zeros(8, np.uint8)])
    first = np.ndarray((n,), "<u8", wide, strides=(1,)).copy()
    first = first if known == 8 else first & np.uint64((1 << 8 * known) - 1)
    ids = np.unique(first, return_inverse=True)[1].astype(np.int64)
    while known < length:
        step = min(known, length - known)
        if len(ids) <= step:
            return np.zeros(0, np.int64)
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1].astype(np.int64)
        known += step
    return ids


def _windows(table: pa.Table, length: int) -> pa.Table:
    """Runs of the windows in these contexts that occur more than once."""
    data = table.column("bytes").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    offs = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    n = np.diff(offs) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    ids = pointers(raw, length)[offs[row] + inside]
    often = np.bincount(ids, minlength=1)[ids] > 1
    pick = np.flatnonzero(often)
    begin = np.flatnonzero(np.r_[True, (np.diff(pick) != 1) | (row[pick][1:] != row[pick][:-1])][: len(pick)])
    length_of = np.diff(np.r_[begin, len(pick)])
    at = pick[begin]
    key, base = table.column("key").to_numpy(), table.column("at").to_numpy()
    return pa.table([key[row[at]], (base[row[at]] + inside[at]).astype(np.int32), length_of.astype(np.int32)], ["key", "at", "n"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for batch in batches:
        out = []
        texts, spans = batch.column("text"), batch.column("spans")
        for i in range(batch.num_rows):
            data = (texts[i].as_py() or "").encode()
            starts = ends = np.zeros(0, np.int64)
            if spans[i].is_valid:
                at, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans[i].values.flatten())
                order = np.argsort(at, kind="stable")
                a, b = at[order], np.maximum.accumulate((at + n)[order] - 1 + length)
                new = np.r_[True, a[1:] > b[:-1]]
                starts, ends = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]
            kept = hashlib.sha256()
            for a, b in zip(np.r_[0, ends], np.r_[starts, len(data)], strict=True):
                kept.update(data[a:b])
            out.append((len(data), int((ends - starts).sum()), len(starts), kept.hexdigest(), starts.tolist(), ends.tolist()))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def repeated_spans(docs: DataFrame, length: int = 200, hot_contexts: int = HOT) -> DataFrame:
    """(key, at, n): runs of n windows of `length` bytes, from byte `at` of the rows with this key, that occur elsewhere.

    A null or empty text has none; rows repeated whole repeat each other. Other columns are not read.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, -(-total // BUCKET_BYTES))
    packed = rows.mapInArrow(partial(_entries, length=length, buckets=buckets), _PACKED)
    found = materialize(packed.groupBy("bucket").applyInArrow(_refine, _FOUND), "refined")
    left = found.where("kind = 1")
    hot = left.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot_contexts).select("g", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot")
    left = left.join(hot, "g", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    open_ = materialize(left.groupBy("key").agg(F.collect_list(F.struct("at", "n", "d", "g", "hot")).alias("open")), "open")
    contexts = rows.join(open_, "key").mapInArrow(partial(_contexts, length=length, buckets=4 * buckets), "bucket int, key long, at int, bytes binary")
    there = not hot.isEmpty()
    if there:  # two steps read them
        contexts = materialize(contexts, "contexts")
    more = contexts.where("bucket is not null").groupBy("bucket").applyInArrow(lambda table: _windows(table, length), "key long, at int, n int")
    settled = found.where("kind = 0").select("key", "at", "n").unionByName(more)
    if not there:
        return settled
    some = contexts.where("bucket is null").mapInArrow(partial(_hot_windows, length=length), "window binary, key long, at int")
    often = some.groupBy("window").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("window")
    often = some.join(materialize(often, "often"), "window").select("key", "at", F.lit(1).alias("n"))
    return settled.unionByName(often)


def repeated_removed(docs: DataFrame, length: int = 200, hot_contexts: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of every row of docs(doc_id, text).

    Every byte is removed that is covered by a string of `length` UTF-8 bytes which also starts anywhere else, in this or
    another row; strings are judged on the input and never cross rows. starts and ends are the removed runs. A null text
    is empty. Rows repeated whole repeat each other. Other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = materialize(repeated_spans(docs, length, hot_contexts).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text").join(spans, "key", "left")
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return rows.select("doc_id", "text", "spans").mapInArrow(partial(_cut, length=length), schema)


SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT row, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t WHERE octet_length(b) >= 200),
h AS (SELECT row, i, md5_number(b[i:i + 199]) AS h FROM p),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT row, i FROM h SEMI JOIN d USING (h)),
f AS (SELECT row, i, i > lag(i) OVER (PARTITION BY row ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY row ORDER BY i) IS NULL AS new FROM c),
g AS (SELECT row, i, sum(new::INT) OVER (PARTITION BY row ORDER BY i) AS span FROM f),
s AS (SELECT row, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY row, span),
k AS (SELECT row, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS before FROM s),
r AS (SELECT row, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM s GROUP BY row),
kept AS (SELECT k.row, string_agg(CASE WHEN lo - 1 > before THEN hex(b[before + 1:lo - 1]) ELSE '' END, '' ORDER BY lo) AS x FROM k JOIN t USING (row) GROUP BY k.row)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(x || CASE WHEN octet_length(b) > last THEN hex(b[last + 1:octet_length(b)]) ELSE '' END)) END AS kept_sha256
FROM t LEFT JOIN r USING (row) LEFT JOIN kept USING (row)
"""
