import random

import numpy as np

from selenite.llm import decontamination
from selenite.llm.decontamination import Items, keep_clean, leaks, marked, normalized

SF = "/root/testdata/sf0.001"


def norm(text):
    return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\x0b", " ").split())


def distance(item, text):
    """Least edits of the item against any part of the text."""
    a, b = item.encode(), text.encode()
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_normalized():
    texts = ["  A  b\n\tC ", "", "x", " \n", "Q"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    data, offs = normalized(raw, np.cumsum([0, *map(len, texts)]))
    assert [bytes(data[a : b - 1]).decode().rstrip() for a, b in zip(offs, offs[1:], strict=False)] == [norm(t) for t in texts]


def test_planted_edits_against_alignment(spark):
    rng = random.Random(5)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text][:25]
    rows = []
    for i in range(24):
        _, text = rng.choice(docs)
        item = list(rng.choice(bench)[1])
        for _ in range(rng.choice([0, 2, 6, 12, 30])):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["x"], [item[at], "y"], ["Z"]])
        at = rng.randrange(len(text) + 1)
        rows.append((i, text[:at][-150:] + " " + "".join(item) + " " + text[at:][:150]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = Items(bench)
    got = {r.doc_id: set(r["items"]) for r in marked(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    limit = dict(zip(items.ids, items.edits.tolist(), strict=True))
    for d, text in rows:
        want = {i for i, t in bench if i in limit and distance(norm(t), norm(text)) <= limit[i]}
        assert got[d] == want


def test_edges(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, twice."), (2, "short"), (3, None), (4, "")], "item_id long, text string")
    text = "see:  THE quick\nbrown fox jumps over the lazy dog, twice. "
    docs = spark.createDataFrame([(1, text, 0), (2, "nothing short", 0), (3, None, 0), (4, "", 0), (None, text * 2, 0), (1, text, 0), (5, "w " * 200000 + text, 0)], "doc_id long, text string, item_id int")
    got = sorted(((r.doc_id, r.contaminated, tuple(r["items"])) for r in marked(docs, bench).collect()), key=str)
    assert got == sorted([(1, True, (1,)), (1, True, (1,)), (2, False, ()), (3, False, ()), (4, False, ()), (None, True, (1,)), (5, True, (1,))], key=str)
    assert leaks(docs.where("doc_id IS NULL"), bench).count() == 2
    assert sorted(r.doc_id for r in keep_clean(docs, bench).collect()) == [2, 3, 4]
    assert keep_clean(docs, bench.limit(0)).count() == 7 and marked(docs.limit(0), bench).count() == 0


def test_parts_of_items(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    item = [word() for _ in range(200)]
    other = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, other(30) + " " + " ".join(item[70:120]) + " " + other(30)), (2, " ".join(item[150:])), (3, " ".join(item[:50]) + " " + other(20)), (4, other(80)), (5, " ".join(item[:10])), (6, " ".join([*item[:8], *other(9).split(), *item[8:16]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in marked(docs, bench).where("contaminated").collect()} == {1, 2, 3}
    assert sorted(r.doc_id for r in keep_clean(docs, bench).collect()) == [4, 5, 6]


def test_parts_against_alignment(spark):
    rng = random.Random(8)
    bench = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = [(i, t) for i, t in bench if 150 < len(t.encode()) < 220][:6]
    rows = []
    for d in range(12):
        part = list(rng.choice(bench)[1][rng.randrange(40) :][:100])
        for _ in range([0, 4, 8, 12][d % 4]):
            part[rng.randrange(len(part))] = rng.choice(["", "#", "%%"])
        rows.append((d, "0123 " + "".join(part) + " 4567"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in marked(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()}

    def held(t, text):
        b = t.encode("utf-8", "ignore")
        parts = (b[i : i + 80].decode("latin-1") for i in range(len(b) - 79))
        return any(distance_bytes(p.encode("latin-1"), norm(text).encode()) <= 6 for p in parts)

    want = {d: {i for i, t in bench if held(t, text)} for d, text in rows}
    assert got == want and 0 < sum(map(bool, want.values())) < 12


def distance_bytes(a, b):
    row = np.zeros(len(b) + 1, int)
    b = np.frombuffer(b, np.uint8)
    at = np.arange(len(b) + 1)
    for x in a:
        new = np.r_[row[0] + 1, np.minimum(row[:-1] + (b != x), row[1:] + 1)]
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "Yes"), (3, "an old oak")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: who  wrote it? Nobody"), (2, " yes\n"), (3, "oh yes"), (4, "than an old oaken"), (5, "Who wrote ita?"), (6, "an old oak")], "doc_id long, text string")
    assert {r.doc_id: list(r["items"]) for r in marked(docs, bench).where("contaminated").collect()} == {1: [1], 2: [2], 6: [3]}


def test_passages_at_the_ends_of_neighbours(spark):
    """A band that reaches into the next text is aligned in each text by itself; several passes give the same."""
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = spark.createDataFrame([(1, item[:40]), (2, item), (3, item[30:]), (4, item), (5, "x")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.marked(docs, bench).where("contaminated").collect()) == [2, 4]
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, bench).collect()) == [1, 3, 5]


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_BYTES", 100)
    items = [f"question number {i} asks for the colour of the {i} th flag over the town hall" for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(items)) + [(99, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontamination.marked(docs, bench).collect()}
    assert got.pop(99) == [] and all(i in v for i, v in got.items())
