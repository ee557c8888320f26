from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from selenite.llm import mixing

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(mixing.SQL).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in mixing.mixed_sizes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_targets_fill_by_weight_and_stop_at_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, 1.5, (3, 1, 2), 2.0).collect()}
    assert got["a"] == 200 and got[None] == 0  # both stop at twice their size
    assert got["b"] == pytest.approx(3150 - 200 - 2000 if 2 * (2950 / 3) > 2000 else 2950 / 3)
    assert sum(got.values()) == pytest.approx(3150)


def test_sums_come_near_targets_and_edges(spark):
    rows = [(i, "w " * (i % 50 + 1), "x" if i % 3 else "y", 1) for i in range(900)]
    rows += [(None, "one two", None, 1), (None, "one two", None, 1), (1000, None, "z", 1), (1001, "", "x", 1), (1002, "big " * 5000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_sizes(docs.repartition(7)).collect()), key=str)
    sums, at = defaultdict(int), {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        sums[source[r.doc_id]] += r.taken
        at[source[r.doc_id]] = r.target
    assert all(abs(sums[s] - at[s]) <= 5000 for s in at)
    clashing = docs.select("*", *(F.lit(1).alias(c) for c in ("target", "epochs", "last", "source_size", "e_b", "copies")))
    assert mixing.mixture(clashing).columns == clashing.columns
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    words = mix.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(sums.values())
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0


def test_weights_of_a_column(spark):
    rows = [(i, "w " * 10, "x", 0.9 if i % 2 else 0.01) for i in range(2000)] + [(9999, "", "x", 0.5), (10000, "a b", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = mixing.mixed_sizes(docs, share=0.5, quality="score").collect()
    taken = [r.doc_id for r in got if r.taken]
    assert sum(d % 2 for d in taken) > 0.95 * len(taken) > 900
    assert max(r.copies for r in mixing.mixed_sizes(docs, share=2.0).collect()) == 2
