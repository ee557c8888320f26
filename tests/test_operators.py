import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selenite.operators import aggregates, claims, documents, evidence, joins, lookups, sequences, spectral


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_classified_join_never_fans_out(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "rk string, v long")
    assert rows(joins.classify_left_join(left, right, "k", "rk", ["v"])) == [(1, "a", 10, "matched"), (2, "b", None, "ambiguous"), (3, "c", None, "missing"), (4, None, None, "missing")]
    with pytest.raises(Exception, match="duplicate key: b"):
        joins.unique_join(left, right.withColumnRenamed("rk", "k"), "k").collect()


def test_preference_and_paths(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("m", 3, "z")], "k string, p long, v string")
    assert rows(joins.first_wins(df, ["k"], "p")) == [("k", 1, "x"), ("m", 3, "z")] and rows(joins.last_wins(df, ["k"], "p")) == [("k", 2, "y"), ("m", 3, "z")]
    right = spark.createDataFrame([("/a/x.txt", 1), ("/b/y.txt", 2), ("/c/y.txt", 3)], "path string, v long")
    left = spark.createDataFrame([("/a/x.txt",), ("/z/x.txt",), ("/z/y.txt",)], "path string")
    assert rows(joins.resolve_path(left, right, "path", ["v"])) == [("/a/x.txt", 1), ("/z/x.txt", 1), ("/z/y.txt", None)]


def test_asof_and_band(spark):
    probe = spark.createDataFrame([("u", 5.0, "p1"), ("u", 1.0, "p2"), ("w", 3.0, "p3")], "k string, t double, name string")
    build = spark.createDataFrame([("u", 2.0, "b1"), ("u", 5.0, "b2"), ("u", 6.0, "b3")], "k string, t double, got string")
    assert rows(joins.asof_preceding(probe, build, ["k"], "t", ["got"])) == [("u", 1.0, "p2", None), ("u", 5.0, "p1", "b2"), ("w", 3.0, "p3", None)]
    right = build.select("k", F.col("t").alias("t2"), "got")
    assert {(r.name, r.got) for r in joins.band_join(probe, right, ["k"], "t", "t2", 1.0).collect()} == {("p1", "b2"), ("p1", "b3"), ("p2", "b1")}


def test_segments_and_intervals(spark):
    df = spark.createDataFrame([("m", i, x, float(i)) for i, x in enumerate([1.0, 2.0, 3.0, 2.5, 4.0, 4.0, 1.0])], "m string, i long, x double, y double")
    assert [r.segment for r in sequences.split_segments(df, ["m"], "i", "x").orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 3]
    kept = sequences.clean_segments(sequences.split_segments(df, ["m"], "i", "x"), ["m"], "x", "y")
    assert {r.segment for r in kept.collect()} == {0, 1}
    spans = spark.createDataFrame([("d", 0, 3), ("d", 4, 6), ("d", 9, 10), ("d", 1, 2)], "d string, s int, e int")
    assert rows(sequences.merge_intervals(spans, ["d"], "s", "e", 1)) == [("d", 0, 6, 3), ("d", 9, 10, 1)]
    assert len(rows(sequences.merge_intervals(spans, ["d"], "s", "e", 0))) == 3


def test_evidence_and_budget(spark):
    df = spark.createDataFrame([("d", "\n".join("abXdefXhijk"))], "d string, t string")
    assert rows(sequences.evidence_windows(df, ["d"], "t", "X", 1)) == [("d", 1, 4, 1, "b\nX\nd"), ("d", 5, 8, 1, "f\nX\nh")]
    blocks = spark.createDataFrame([([(1.0, 2, "cc"), (9.0, 5, "aaaa"), (5.0, 1, "bbbbbbbb"), (5.0, 9, "d")],)], "b array<struct<score:double,pos:int,text:string>>")
    assert blocks.select(sequences.greedy_budget(F.col("b"), 7).alias("x")).first().x == ["aaaa", "d", "cc"]
    tokens = spark.createDataFrame([(1, k, t) for k, t in enumerate(["FeO", "19.8", "±", "0.2", "(a)", "<5", "b"])], "r int, k int, t string")
    assert rows(sequences.neighbour_tokens(tokens, ["r"], "k", "t")) == [(1, 1, 19.8, 0.2, "a"), (1, 5, 5.0, None, "b")]


def test_two_weightings(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 4.0), (2, "a", 3.0)], "band int, parent string, v double")
    got = {(r.band, r.weighting): (r.n, r.mean, r.sd) for r in aggregates.member_and_group_means(df, "band", "parent", "v").collect()}
    assert got[1, "member"] == (3, 2.0, pytest.approx(np.sqrt(3))) and got[1, "group"][:2] == (2, 2.5) and got[2, "member"] == (1, 3.0, None)


def test_claims_and_metrics(spark):
    df = spark.createDataFrame([("p", 10.0, "s1"), ("p", 10.0, "s2"), ("p", 12.0, "s1"), ("p", 12.0, "s1")], "p string, v double, s string")
    r = aggregates.claim_summary(df, ["p"], "v", ["s"]).first()
    assert (r.n_claims, r.n_values, r.value_mean) == (3, 2, 11.0) and r.claim_mean == pytest.approx(32 / 3)
    m = aggregates.regression_metrics(spark.createDataFrame([("k", 1.0, 2.0), ("k", 3.0, 3.0), ("k", 5.0, None)], "k string, y double, f double"), ["k"], "y", "f").first()
    assert (m.n, m.mae, m.bias, m.r2) == (2, 0.5, 0.5, 0.5)
    fine, bad = aggregates.accept_within(spark.createDataFrame([(0.0,), (0.005,), (5.0,), (36.0,), (None,)], "v double"), "v", 0.01, 35)
    assert rows(fine) == [(5.0,)] and {r.reject_reason for r in bad.collect()} == {"zero placeholder", "below", "above", "missing"}


def test_bandpass(spark):
    w = spark.createDataFrame([(1.0, 1, 1.0), (2.0, 1, 3.0), (9.0, 2, 1.0), (1.0, 2, 1.0)], "x double, band int, weight double")
    curve = spark.createDataFrame([("m", 1.0, 10.0), ("m", 2.0, 20.0)], "m string, x double, y double")
    got = {r.band: (r.response, r.coverage, r.usable) for r in spectral.bandpass(curve, w, ["m"], "x", "y", 0.6).collect()}
    assert got == {1: (17.5, 1.0, True), 2: (10.0, 0.5, False)}
    assert spectral.check_weights(w, 2) is w
    with pytest.raises(ValueError):
        spectral.check_weights(w, 3)


def test_kernels():
    x = np.array([0.0, 1.0, 2.0, 4.0])
    assert spectral.natural_spline(x, 3 * x + 1, np.array([0.5, 3.0, 5.0]))[:2] == pytest.approx([2.5, 10.0])
    y = np.array([0.0, 1.0, 1.0, 3.0])
    # second derivatives of the natural spline solve a tridiagonal system
    a = np.array([[4.0, 1.0], [1.0, 6.0]])
    m1, m2 = np.linalg.solve(a, 6 * np.array([0.0 - 1.0, 1.0 - 0.0]))
    assert spectral.natural_spline(x, y, np.array([1.5]))[0] == pytest.approx(1.0 + ((0.125 - 0.5) * m1 + (0.125 - 0.5) * m2) / 6)
    p = spectral.pchip(x, y, np.array([0.0, 1.0, 1.5, 2.0, 4.0, 4.1]))
    assert p[:5] == pytest.approx([0.0, 1.0, 1.0, 1.0, 3.0]) and np.isnan(p[5])
    dense = spectral.pchip(x, y, np.linspace(0, 4, 101))
    assert (np.diff(dense) >= -1e-12).all()
    assert spectral.pchip(np.array([0.0, 2.0]), np.array([0.0, 4.0]), np.array([0.5]))[0] == 1.0


def test_resample_segments(spark):
    df = spark.createDataFrame(pd.DataFrame({"m": "a", "segment": [0, 0, 0, 1, 1], "x": [0.0, 1.0, 9.0, 1.0, 2.0], "y": [0.0, 1.0, 9.0, 3.0, 3.0]}))
    got = {r["at"]: r["value"] for r in spectral.resample_segments(df, "m", "x", "y", [0.5, 1.0, 1.5, 5.0], "linear", gap=2.0).collect()}
    assert got == {0.5: 0.5, 1.0: 2.0, 1.5: 3.0}


def test_documents(spark):
    cells = spark.createDataFrame([("d", 10.0, 1.0), ("d", 57.0, 2.0), ("d", 2.0, 3.0)], "d string, x0 double, value double")
    heads = spark.createDataFrame([("d", 12.0, "A"), ("d", 60.0, "B")], "d string, x0 double, text string")
    assert {(r.value, r.header) for r in documents.column_references(cells, heads, ["d"]).collect()} == {(1.0, "A"), (2.0, "B"), (3.0, "A")}
    r = spark.createDataFrame([("The value is 48.", "value is “48”", "48"), ("The value is 48.", "the VALUE  is 48", "48"), ("none", "none", "250")], "s string, q string, v string")
    assert [x.warnings for x in documents.validated(r, "s", "q", "v", 0, 200).collect()] == ["quote_not_in_source", "", "number_not_in_source;value_out_of_range"]
    j = spark.createDataFrame([("Sure:\n```json\n{\"a\": 1}\n```",), ("nothing",)], "t string").select(documents.model_json(F.col("t"), "a int").alias("x")).collect()
    assert j[0].x.a == 1 and j[1].x is None
    pages = spark.createDataFrame([("d", 1, "text"), ("d", 2, "References"), ("d", 3, "more"), ("e", 1, "all")], "d string, p int, t string")
    assert rows(documents.pages_before(pages, ["d"], "p", "t", "^References")) == [("d", 1, "text"), ("e", 1, "all")]


def test_metrics_of_groups_without_numbers(spark):
    df = spark.createDataFrame([("k", "a", 1.0, 2.0), ("k", "a", 1.0, float("nan")), ("k", "b", 3.0, 3.0), ("k", "c", float("inf"), 1.0), ("k", "d", None, 1.0)], "k string, g string, y double, f double")
    assert aggregates.group_mean_metrics(df, ["k"], "g", "y", "f").first().n == 2


def test_duplicate_band_stops(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0)], "k string, b int, v double")
    assert rows(aggregates.complete_pivot(df, "k", "b", "v", [1, 2])) == [("a", 1.0, 2.0)]
    with pytest.raises(Exception, match="duplicate band 1 of b"):
        aggregates.complete_pivot(df.union(df), "k", "b", "v", [1, 2]).where("k = 'b'").collect() or aggregates.complete_pivot(df.union(df.where("k = 'b'")), "k", "b", "v", [1]).collect()


def test_assertions_stop_with_reasons(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "y", None), (2, "z", 5.0)], "k int, name string, v double")
    assert rows(lookups.exactly_one(df.where("k = 2"), ["k"], "name")) == [(2, "z", 5.0)]
    with pytest.raises(Exception, match="several match: x, y"):
        lookups.exactly_one(df, ["k"], "name").collect()
    with pytest.raises(Exception, match="no rows of 9"):
        lookups.all_present(spark.createDataFrame([(9,)], "k int"), df, "k").collect()
    with pytest.raises(Exception, match="flag and value differ: y"):
        lookups.consistent(df, F.lit(True), F.col("v"), F.col("name")).collect()
    with pytest.raises(Exception, match="v is not 4.0: 5.0"):
        lookups.known_answer(df, F.col("k") == 2, "v", 4.0).collect()
    pairs = spark.createDataFrame([(1, "x")], "a int, b string")
    left, right = spark.createDataFrame([(1, 7)], "a int, l int"), spark.createDataFrame([("q", 8)], "b string, r int")
    with pytest.raises(Exception, match="pair without its row: x"):
        lookups.mapped_pairs(pairs, left, right, "a", "b").collect()
    cached = spark.createDataFrame([("u", "1")], "u string, d string")
    with pytest.raises(Exception, match="source has changed: u"):
        lookups.cache_state(spark.createDataFrame([("u", "2")], "u string, d string"), cached, "u", "d").collect()
    order = spark.createDataFrame([("<10",), ("9",), ("none",), ("~ 9.5",), (None,)], "c string").orderBy(lookups.value_order(F.col("c"))).collect()
    assert [r.c for r in order] == ["9", "~ 9.5", "<10", None, "none"]


def test_claims_of_manual_rows(spark):
    cells = [("15041", "n", "x"), ("15041, 15042", "1.5", "x"), ("15041", "1.5", "no"), ("10072A", "1.5", "yes")]
    df = spark.createDataFrame([(str(k), *c, "", "", "", "", "", "") for k, c in enumerate(cells)], "row string, sample_id string, value string, include string, source_kind string, scope string, source_id string, source_url string, reference string, note string")
    made, lost = claims.manual_claims(df)
    assert [(r.parent, r.value, r.source_kind, r.scope, r.source_id) for r in made.collect()] == [("10072A", 1.5, "manual_reviewed", "bulk_or_whole_sample", "manual:3")]
    assert sorted(r.row for r in lost.collect()) == ["0", "1"]
    assert [f.name for f in made.schema] == [f.name for f in claims.CLAIM]


def test_headers_and_their_columns(spark):
    words = [("reference", 90.0, 120.0), ("Haramura", 130.0, 160.0), ("in", 161.0, 165.0), ("Compston70", 166.0, 200.0), ("LSPET70,", 250.0, 280.0)]
    df = spark.createDataFrame([(words,)], "w array<struct<text:string,x0:double,x1:double>>").select(evidence.header_tokens(F.col("w")).alias("h"))
    assert [(h.text, h.x0, h.complex) for h in df.first().h] == [("Haramura in Compston70", 130.0, True), ("LSPET70", 250.0, False)]
    at = lambda x: df.select(evidence.mapped_reference(F.col("h"), F.lit(x)).alias("r")).first().r
    assert (at(249.0).text, at(131.0).text, at(10.0).text) == ("LSPET70", "Haramura in Compston70", "Haramura in Compston70")


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=5001), "b": np.r_[np.zeros(4000), rng.exponential(size=7)], "c": np.array([5.0]), None: np.array([1.0, 2.0]), "d": np.r_[1e18, rng.normal(size=500)]}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("a", float("nan")), ("e", None)], "k string, v double").repartition(5)
    p = {"low": 0.01, "mid": 0.5, "top": 1.0, "first": 0.0, "q": 0.777}
    got = {r.k: r for r in aggregates.exact_quantiles(df, ["k"], "v", p).collect()}
    assert got.keys() == data.keys()
    for k, x in data.items():
        for name, share in p.items():
            assert got[k][name] == pytest.approx(np.quantile(x, share), rel=1e-12, abs=1e-12)


def test_cells_change_nothing(spark):
    """As-of joins and segments by cells give what one pass over a key gives, with nulls, ties and hot keys."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), i if i % 50 else None, rng.choice([None, *map(float, range(6))])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at int, v double").where("at IS NOT NULL")
    want = sorted(map(str, sequences.split_segments(df, ["k"], "at", "v").collect()))
    for width in (1, 7, 1000):
        assert sorted(map(str, sequences.split_segments(df, ["k"], "at", "v", width=width).collect())) == want
    probe = df.select("k", F.when(F.col("at") % 40 > 0, (F.col("at") / 3).cast("int")).alias("at"), F.col("at").alias("id"))
    build = df.where("at % 11 = 3").select("k", (F.col("at") / 3).cast("int").alias("at"), F.col("v").alias("got"))
    build = build.unionByName(spark.createDataFrame([(1, None, 99.0)], build.schema))
    want = sorted(map(str, joins.asof_preceding(probe, build, ["k"], "at", ["got"]).collect()))
    for width in (1, 5, 1000):
        assert sorted(map(str, joins.asof_preceding(probe, build, ["k"], "at", ["got"], width).collect())) == want
    times = lambda d: d.withColumn("at", F.timestamp_seconds(F.col("at") * 3600))
    hours = joins.asof_preceding(times(probe), times(build), ["k"], "at", ["got"], width=1)
    assert sorted(map(str, hours.withColumn("at", (F.unix_timestamp("at") / 3600).cast("int")).collect())) == want
