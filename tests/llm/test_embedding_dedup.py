import numpy as np

from selenite.llm.embedding_dedup import near_duplicate_vectors


def brute(rows, least=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return {r[0]: (links[i], low[find(i)], low[find(i)] == r[0]) for i, r in enumerate(rows)}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        base = rng.normal(size=(60, 64))
        for k, v in enumerate(base):
            for _ in range(1 if k > 15 else 3):
                noise = rng.normal(size=64)
                rows.append(((v + noise * rng.uniform(0.05, 0.25) * np.linalg.norm(v) / np.linalg.norm(noise)), label))
        hot = rng.normal(size=64)
        rows += [(hot + rng.normal(size=64) * 0.05, label) for _ in range(320)]
        rows += [(base[0], label)] * 5
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 64, 0), (n + 3, [float("nan")] * 64, 0), (n + 4, [None] * 64, 0), (n + 5, rows[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [float("inf")] + [1.0] * 63, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(frame).collect()}
    want = brute(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert got.keys() == want.keys() and 0.999 * there <= found <= there
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_labels_and_sizes_of_any_kind(spark):
    """Text labels, labels that differ in their decimals, and components whose squares are too large or too small."""
    rows = [(1, [1e200, 2e200], "x"), (2, [1e-200, 2e-200], "x"), (3, [5e-324, 1e-323], "x"), (4, [1.0, 2.0], "y"), (5, [-0.0, 1.0], "y"), (6, [0.0, 3.0], "y"), (7, [1e200, float("inf")], "x"), (8, [1.0, None], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0.25), (2, [1.0, 2.0], 0.5), (3, [2.0, 4.0], 0.5)], "vec_id long, embedding array<double>, label double")
    assert {r.vec_id: r.component_id for r in near_duplicate_vectors(frame).collect()} == {1: 1, 2: 2, 3: 2}


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, got = brute(rows), near_duplicate_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert sum(r.n_links for r in got) >= 0.99 * sum(v[0] for v in want.values())
