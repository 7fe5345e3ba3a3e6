"""A training corpus from documents: quality, toxicity, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is
written and read again before the next. All but the last return the columns of documents; the
last returns one row per piece of a document: where it lies in which bin. No stage fails on null
or empty texts: such a document has no n-grams and no toxic features, so the first two keep it; all empty
texts are one to exact dedup; the packing has nothing to pack of it. Of rows that repeat doc_id and text exact dedup keeps one; rows that
share a doc_id but not the text are documents of their own. Ties at the quality threshold all stay, of equal texts the smallest doc_id, of near copies the smallest of their
group. Very long texts are read whole. Empty tables give empty results, and extra columns go through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import exact_dedup, ngram_join, packing, quality, toxicity
from fieldloom.llm.common import own_table, shipped, stored

#: Fixed by the task: near duplicates share 80 of 100 shingles of five words.
WIDTH, PERCENT = 5, 80

#: Rows of an Arrow batch at most: whole texts go through it, and tasks work on fewer at a time anyway.
BATCH_ROWS = 1000


def _ready(spark: SparkSession) -> None:
    """Gives the executors this package, and keeps the batches of texts between them and Python small."""
    shipped(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return toxicity.clean_rows(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exactly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return exact_dedup.kept_rows(docs, exact_dedup.DigestIndex(spark, own_table(spark, f"fieldloom_digests_{uuid.uuid4().hex}")))


def nearly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return ngram_join.one_of_each(docs, WIDTH, PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("exact dedup", exactly_once),
    ("n-gram Jaccard join", nearly_once),
    ("best-fit packing", packed),
]

#: Neither the classifiers nor best-fit packing can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
