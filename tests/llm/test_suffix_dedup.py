import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from selenite.llm.suffix_dedup import pointers, repeated_removed


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((d, len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [200, 90])
def test_against_all_strings(spark, length):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(70))
    rows = docs[:120]
    rows += [(10_000 + i, " ".join(word() for _ in range(rng.randint(0, 60))) + passage[: rng.randint(150, len(passage))] + " ".join(word() for _ in range(30))) for i in range(150)]
    base = " ".join(word() for _ in range(300)).split(" ")
    for i in range(20):
        edited = list(base)
        for _ in range(4):
            edited[rng.randrange(300)] = word()
        rows.append((20_000 + i, " ".join(edited)))
    rows += [(30_000, "a" * 450), (30_001, "ab" * 300), (30_002, passage + passage), (30_003, None), (30_004, ""), (None, "x" * 199), (30_005, passage), (30_005, passage), (None, "q" * 3000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(5)
    want = brute(rows, length)
    for hot in (2000, 3):
        assert sorted((tuple(r)[:5] for r in repeated_removed(frame, length, hot).collect()), key=str) == want


@pytest.mark.parametrize("length", [3, 8, 11, 200])
def test_pointers(length):
    rng = random.Random(length)
    raw = b"".join(rng.choice([b"abc", b"ab", b"a" * 40, b"xyz" * 80]) for _ in range(300))
    ids = pointers(np.frombuffer(raw, np.uint8), length)
    seen = {}
    assert len(ids) == len(raw) - length + 1
    for at, i in enumerate(ids.tolist()):
        assert seen.setdefault(i, raw[at : at + length]) == raw[at : at + length]
    assert len(seen) == len(set(seen.values()))
    assert len(pointers(np.zeros(2, np.uint8), 3)) == 0


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_removed(frame).count() == 0
