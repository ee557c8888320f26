import zlib

import numpy as np

from selenite.llm.quality import NonNegativePU, features, keep_good, quality_scores

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.values())
    test = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in test]) >= 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "some words", 0.0), (3, "x" * 300000, 0.0), (3, "x" * 300000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality_scores(docs, labels).count() == 5
    assert keep_good(docs, labels).columns == docs.columns
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_learner_separates_with_unlabelled_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (2000, 5)), rng.normal(3, 1, (600, 5))
    model = NonNegativePU().fit(good[:1000], np.r_[good[1000:], bad], 1000 / 1600)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad) < 0.5).mean() > 0.97
    assert features(np.zeros(0, np.uint8), np.array([0, 0])).shape[0] == 1
