"""A corpus from raw documents: quality, near duplicates, benchmark passages, mixture, shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from selenite.llm import decontamination, mixing, ngram_join, quality, sharding
from selenite.llm.common import materialize, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the positive-unlabelled classifier rejects."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words, similarity 0.8."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: 150% of all words, sources weighted 3, 1, 2 in turn."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: eight shards of row counts at most one apart."""
    return sharding.shards_of(docs, shards=8)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed),
    ("sharding", sharded),
]

#: The classifier, the alignments and the drawn matrix have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
