import random
import zlib
from collections import Counter, defaultdict

from selenite.llm.sharding import communication_matrix, hypergeometric, shards_of


def test_matrix_has_exact_margins():
    counts = [1000, 0, 17, 333, 2048, 1]
    matrix = communication_matrix(counts, 8, 3)
    assert [sum(r) for r in matrix] == counts
    sizes = [sum(c) for c in zip(*matrix, strict=True)]
    assert sum(sizes) == sum(counts) and max(sizes) - min(sizes) <= 1


def test_hypergeometric_moments():
    rng = random.Random(1)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    mean = sum(draws) / len(draws)
    var = sum((x - mean) ** 2 for x in draws) / len(draws)
    assert abs(mean - 6) < 0.05 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.1
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0


def test_shards(spark):
    rows = [(i, f"text {i % 40}", 1) for i in range(1003)] + [(None, None, 1), (None, None, 1), (5, "text 5", 1), (2000, "ü" * 50000, 1), (2001, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shards_of(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    byte = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len(byte(t)) + 1, zlib.crc32(byte(t))) for d, t, _ in rows)
    again = shards_of(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert shards_of(docs.limit(0)).count() == 0
    # neighbours in the input are as good as independent
    together = Counter((a.shard == b.shard) for a, b in zip(sorted(got, key=lambda r: r.doc_id or 0), sorted(got, key=lambda r: r.doc_id or 0)[1:], strict=False))
    assert 60 < together[True] < 200
