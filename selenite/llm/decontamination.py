"""Benchmark decontamination by the q-gram lemma.

A passage of m characters within k edits of a benchmark item has at least m - q + 1 - k q of the item's q-grams in
common with it, on diagonals that differ by k at most. Shared q-grams are counted in diagonal bands that overlap by
half, bands that meet the bound are regions, and each region is verified by an alignment in a band. An item is looked for
whole, and where it is not there whole, by every window of PART bytes that it has. Both texts are compared as UTF-8 bytes with A-Z in lower case and each run of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WHITE, materialize, text_slices

#: Bytes of a q-gram, edits allowed as a share of the item or part, least bytes of an item that may have edits, bytes of
#: a part, parts aligned at once, bytes of items for one pass.
GRAM, BUDGET, LEAST, PART, AT_ONCE, PASS_BYTES = 8, 0.08, 24, 80, 512, 4 << 20


def normalized(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with runs of white space as one space and without it at their ends, each followed by a zero byte."""
    white = WHITE[data]
    first = np.zeros(len(data), bool)
    first[offs[:-1][np.diff(offs) > 0]] = True
    before = np.r_[True, white[:-1]] if len(data) else white
    keep = ~white | ~(before | first)
    spaced = np.where(white, 32, LOWER[data]).astype(np.uint8)
    ends = np.cumsum(np.r_[0, keep])[offs]
    out = np.insert(spaced[keep], ends[1:], 0)
    return out, ends + np.arange(len(offs))


def grams_at(data: np.ndarray, gram: int) -> np.ndarray:
    """The q-gram of up to eight bytes at each place, as a number: no hashing, no collisions."""
    n = len(data) - gram + 1
    wide = np.ascontiguousarray(np.r_[data, np.zeros(8, np.uint8)])
    keys = np.ndarray((n,), "<u8", wide, strides=(1,)).copy()
    return keys if gram == 8 else keys & np.uint64((1 << 8 * gram) - 1)


def _in_word(data: np.ndarray, at: int) -> bool:
    """Whether the byte there belongs to a word."""
    return 0 <= at < len(data) and (data[at] >= 128 or chr(data[at]).isalnum())


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Items:
    """Index of the q-grams (of eight bytes at most) of some benchmark items."""

    def __init__(self, rows: list[tuple[int, str | None]], gram: int = GRAM, budget: float = BUDGET, least: int = LEAST, part: int = PART):
        self.gram, self.least, self.part, self.ids, self.texts, self.edits, self.bounds = gram, least, part, [], [], [], []
        self.tiny: dict[bytes, list[int]] = {}  # items without a q-gram
        self.part_edits = min(int(budget * part), (part - gram) // gram)
        keys, item, place = [], [], []
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            data = normalized(raw, np.array([0, len(raw)]))[0][:-1]
            data = data[:-1] if len(data) and data[-1] == 32 else data
            if len(data) < gram:
                if len(data):
                    self.tiny.setdefault(data.tobytes(), []).append(item_id)
                continue
            edits = min(int(budget * len(data)), (len(data) - gram) // gram) if len(data) >= least else 0
            at = np.arange(len(data) - gram + 1)
            keys.append(grams_at(data, gram))
            item.append(np.full(len(at), len(self.ids)))
            place.append(at)
            self.ids.append(item_id)
            self.texts.append(data)
            self.edits.append(edits)
            self.bounds.append(len(at) - edits * gram)
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.zeros(0, np.int64)
        self.keys = np.concatenate(keys)[order] if keys else np.zeros(0, np.uint64)
        self.item = np.concatenate(item)[order] if keys else order
        self.place = np.concatenate(place)[order] if keys else order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_slot(self.keys)] = True
        self.edits, self.bounds = np.array(self.edits, np.int64), np.array(self.bounds, np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in data, place in the item, item) of every shared q-gram."""
        none = np.zeros(0, np.int64)
        if len(data) < self.gram or not len(self.keys):
            return none, none, none
        keys = grams_at(data, self.gram)
        at = np.flatnonzero(self.maybe[_slot(keys)])
        keys = keys[at]
        lo = np.searchsorted(self.keys, keys, "left")
        known = self.keys[np.minimum(lo, len(self.keys) - 1)] == keys
        at, keys, lo = at[known], keys[known], lo[known]
        hi = np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.place[entry], self.item[entry]

    def regions(self, at: np.ndarray, place: np.ndarray, item: np.ndarray, edits: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal of the band) wherever a band has as many shared q-grams as the lemma asks."""
        if not len(item):
            return item, item
        # Cells as wide as the edits and one more; a band is two neighbouring cells, so bands overlap by half.
        cells = (item << 40) + (at - place) // (edits[item] + 1) + (1 << 39)
        cells.sort()
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        cell, counts = cells[first], np.diff(np.r_[first, len(cells)])
        before = np.flatnonzero(cell[1:] == cell[:-1] + 1)
        own = counts.copy()
        counts[before] += own[before + 1]
        good = counts >= bounds[cell >> 40]
        i, cell = cell[good] >> 40, cell[good]
        return i, ((cell & ((1 << 40) - 1)) - (1 << 39)) * (edits[i] + 1)

    def partial(self, data: np.ndarray, offs: np.ndarray, at: np.ndarray, place: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) in data of the passages that are made of windows of the item within the edits of a part."""
        k, bound = self.part_edits, self.part - self.gram + 1 - self.part_edits * self.gram
        size = np.array([len(x) for x in self.texts], np.int64)
        some = size[item] > self.part if len(item) else np.zeros(0, bool)
        at, place, item = at[some], place[some], item[some]
        bands = self.regions(at, place, item, np.full(len(size), k), np.full(len(size), bound))
        if not len(bands[0]):
            return
        sort_key = (item << 40) + (at - place) + (1 << 39)
        order = np.argsort(sort_key, kind="stable")
        sort_key, at, place = sort_key[order], at[order], place[order]
        known: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, diagonal in zip(*(x.tolist() for x in bands), strict=True):
            lo, hi = np.searchsorted(sort_key, (i << 40) + (1 << 39) + diagonal + np.array([0, 2 * (k + 1)]))
            rows = np.searchsorted(offs, at[lo:hi], "right") - 1
            for row in np.unique(rows).tolist():
                there = np.sort(place[lo:hi][rows == row])
                begin = np.arange(size[i] - self.part + 1)
                begin = begin[np.searchsorted(there, begin + self.part - self.gram, "right") - np.searchsorted(there, begin) >= bound]
                for a, b in known.get((row, i), []):  # the same passage in the next band
                    begin = begin[(begin + diagonal < a - 2 * k) | (begin + diagonal + self.part > b + 2 * k)]
                found = []
                for c in range(0, len(begin), AT_ONCE):
                    starts, ends = self.windows(data[offs[row] : offs[row + 1] - 1], i, diagonal - int(offs[row]), begin[c : c + AT_ONCE])
                    found += zip((starts + offs[row]).tolist(), (ends + offs[row]).tolist(), strict=True)
                passages = known.setdefault((row, i), [])
                passages[:] = _merged(sorted([*passages, *found]))
        yield from ((i, a, b) for (_, i), passages in known.items() for a, b in passages)

    def windows(self, data: np.ndarray, item: int, diagonal: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in data of those of the item's windows that align within the edits, in the band from this diagonal."""
        want, k = self.texts[item], self.part_edits
        across, far = np.arange(4 * k + 3), k + 1
        columns = (diagonal - k + begin)[:, None] + across  # data position before row 0
        row, start = np.where((columns >= 0) & (columns <= len(data)), 0, far), columns
        for r in range(self.part):
            at = columns + r
            inside = (at >= 0) & (at < len(data))
            same = inside & (data[np.clip(at, 0, len(data) - 1)] == want[begin + r][:, None])
            best = np.where(inside, row + ~same, far)
            skip = np.pad(row[:, 1:], ((0, 0), (0, 1)), constant_values=far) + 1
            take = skip < best
            best, origin = np.where(take, skip, best), np.where(take, np.pad(start[:, 1:], ((0, 0), (0, 1))), start)
            slope = best - across
            lead = np.minimum.accumulate(slope, axis=1)
            source = np.maximum.accumulate(np.where(slope == lead, across, 0), axis=1)
            row, start = np.minimum(lead + across, far), np.take_along_axis(origin, source, 1)
            live = row.min(axis=1) <= k
            if not live.all():
                columns, row, start, begin = columns[live], row[live], start[live], begin[live]
            if not len(begin):
                break
        pick = row.argmin(axis=1)[:, None]
        return np.take_along_axis(start, pick, 1)[:, 0], np.take_along_axis(columns, pick, 1)[:, 0] + self.part

    def rows_near(self, offs: np.ndarray, item: int, diagonal: int) -> Iterator[int]:
        """The texts that the band reaches and that are long enough for the item."""
        k, size = int(self.edits[item]), len(self.texts[item])
        first, last = np.searchsorted(offs, [max(diagonal - k, 0), max(diagonal + 3 * k + 2 + size, 0)], "right")
        for row in range(max(int(first) - 1, 0), min(int(last), len(offs) - 1)):
            if offs[row + 1] - 1 - offs[row] >= size - k:
                yield row

    def aligned(self, data: np.ndarray, item: int, diagonal: int) -> tuple[int, int] | None:
        """Start and end in data of an alignment of the whole item within its edits, in the band from this diagonal."""
        want, k = self.texts[item], int(self.edits[item])
        from_, upto = max(diagonal - k, 0), max(diagonal + 2 * (k + 1) + k + len(want), 0)
        if (exact := data[from_:upto].tobytes().find(want.tobytes())) >= 0:  # the alignment without edits
            return from_ + exact, from_ + exact + len(want)
        width = 2 * (k + 1) + 2 * k + 1
        low = diagonal - k
        columns = low + np.arange(width)  # data position before row 0
        far = k + 1
        row = np.where((columns >= 0) & (columns <= len(data)), 0, far)
        start = columns.copy()
        for r in range(1, len(want) + 1):
            at = columns + r - 1  # byte consumed on the diagonal
            inside = (at >= 0) & (at < len(data))
            same = np.zeros(width, bool)
            same[inside] = data[at[inside]] == want[r - 1]
            best, begin = np.where(inside, row + ~same, far), start
            skip = np.r_[row[1:], far] + 1  # a byte of the item is missing
            take = skip < best
            best, begin = np.where(take, skip, best), np.where(take, np.r_[start[1:], 0], begin)
            # extra bytes of data: a run to the right costs one each
            slope = best - np.arange(width)
            lead = np.minimum.accumulate(slope)
            source = np.maximum.accumulate(np.where(slope == lead, np.arange(width), 0))
            row, start = np.minimum(lead + np.arange(width), far), begin[source]
            if row.min() > k:
                return None
        end = int(row.argmin())
        return (int(start[end]), int(columns[end] + len(want))) if row[end] <= k else None


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _searched(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for lo, hi, raw, raw_offs in text_slices(batch, "text"):
            data, offs = normalized(raw, raw_offs)
            out, last, before = [], {}, (-1, 0, 0)
            at, place, of = items.hits(data)
            free = np.ones(len(of), bool)
            for item, diagonal in zip(*items.regions(at, place, of, items.edits, items.bounds), strict=True):
                if before[0] == item and before[1] >= diagonal and before[2] > diagonal:
                    continue  # the same passage in the next band
                for row in items.rows_near(offs, item, diagonal):
                    found = items.aligned(data[offs[row] : offs[row + 1] - 1], item, diagonal - int(offs[row]))
                    if found is None:
                        continue
                    found = found[0] + int(offs[row]), found[1] + int(offs[row])
                    if last.get((row, item), -1) > found[0]:
                        continue
                    if len(items.texts[item]) < items.least and (_in_word(data, found[0] - 1) or _in_word(data, found[1])):
                        continue
                    last[row, item] = found[1]
                    before = item, found[0], found[1]
                    free &= (of != item) | (at < found[0]) | (at >= found[1])
                    out.append((keys[lo + row], items.ids[item], found[0] - int(offs[row]), found[1] - int(offs[row])))
            for item, start, end in items.partial(data, offs, at[free], place[free], of[free]):
                row = int(np.searchsorted(offs, start, "right")) - 1
                out.append((keys[lo + row], items.ids[item], start - int(offs[row]), end - int(offs[row])))
            for row in np.flatnonzero(np.diff(offs) <= items.gram + 1).tolist() if items.tiny else ():
                text = data[offs[row] : offs[row + 1] - 1].tobytes().rstrip(b" ")
                out += [(keys[lo + row], i, 0, len(text)) for i in items.tiny.get(text, [])]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "item_id", "start", "end"])


def leaks(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, budget: float = BUDGET, least: int = LEAST) -> DataFrame:
    """(key, item_id, start, end): each passage of docs(doc_id, text) that holds an item of benchmark(item_id, text), or a part of it.

    Offsets are in the normalised text. A part is made of windows of PART bytes of the item, each within the budget.
    Items shorter than `least` normalised bytes are found without edits, between word ends; those shorter than a q-gram
    only where they are the whole text. Empty and null items are left out; null texts hold nothing. Items go to the workers in passes of about PASS_BYTES each, one after the
    other: driver and workers hold one index, about 25 bytes a byte, and the documents are read once a pass. key is a
    hash of id and text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    passes = -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES)
    schema = "key long, item_id long, start long, end long"
    found = spark.createDataFrame([], schema)
    for k in range(passes):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        items = spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in part], gram, budget, least))
        one = rows.mapInArrow(lambda batches, items=items: _searched(batches, items.value), schema)
        if passes > 1:  # written at once, so that driver and workers hold one index at a time
            one = materialize(one, "pass")
            items.destroy()
        found = found.unionByName(one) if k else one
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, items, n_passages) of the rows of docs that hold passages of the benchmark, as leaks() finds them; no others."""
    found = leaks(docs, benchmark).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n_passages"))
    return materialize(found, "leaks")


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_passages, items) of every row; items are the ids of the benchmark, in order.

    Rows repeated whole share their passages' count.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id")
    out = rows.join(contaminated(docs, benchmark), "key", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark: null and empty texts and repeated rows stay; docs must not have a column __key."""
    found = contaminated(docs, benchmark).select(F.col("key").alias("__key"))
    return docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(found, "__key", "left_anti").drop("__key")
