from collections import Counter

import corpus_pipeline
from selenite.llm.common import materialize

from .test_ngram_join import shingles

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.columns == columns
        at[name] = before, docs
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    raw, kept = ({r.doc_id for r in x.collect()} for x in at["quality classifier"])
    assert len(good & raw - kept) <= 0.03 * len(good & raw) and len(bad & kept) <= 0.3 * len(bad & raw)

    before, after = (x.collect() for x in at["n-gram jaccard join"])
    sets = {r.doc_id: shingles(r.text, 5) for r in before}
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    ids = sorted(r.doc_id for r in after)
    assert all(not near(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[:i])
    gone = set(sets) - set(ids)
    assert all(any(near(sets[g], s) for d, s in sets.items() if d != g) for g in gone)

    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = (x.collect() for x in at["benchmark decontamination"])
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not any(i in norm(r.text) for i in items)}

    before, after = (Counter(r.doc_id for r in x.collect()) for x in at["source mixing"])
    assert max(after.values()) <= 2 and set(after) <= set(before)

    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out) == after
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows and an empty table: stages keep clean documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    good = next(r for r in docs.orderBy("doc_id").collect() if r.doc_id in labels and r.text and 200 < len(r.text) < 3000)
    rows = [(900_001, good.text + " one more", None, None, None), (None, good.text + " and then two", "en", "s", 1), (900_002, None, "en", "s", 0), (900_003, "", "en", None, 0), (900_004, "word " * 60_000, "en", "s", 1), (900_005, None, None, None, None)] + [(900_006, good.text.upper()[:150], "en", "s", 5)] * 3
    odd = spark.createDataFrame(rows, docs.schema)
    for start in (odd, odd.limit(0), docs.limit(30).unionByName(odd)):
        at = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = materialize(stage(spark, at, SF), "t")
            assert at.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, at, SF)
        assert out.count() == at.count()
    kept = corpus_pipeline.STAGES[1][1](spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["900001", "900002", "900003", "900004", "900005", "900006"]
