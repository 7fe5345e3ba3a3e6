"""The labelled documents that a classifier is fitted on: all of them up to a bound, chosen by hash beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import kth_largest, stored

#: At most so many labelled documents are used for a fit.
MAX_LABELLED = 20_000


def labelled_ids(labels: DataFrame, column: str, most: int = MAX_LABELLED) -> dict[int, int]:
    """doc_id to 0 or 1: the `most` labelled documents with the largest hashes of doc_id, with ties.

    Rows without doc_id or label are left out; a document labelled twice counts as 1 if any label is."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(column) > 0).cast("int")).alias("label"))
    rows = stored(rows.withColumn("place", F.shiftright(F.xxhash64("doc_id"), 11).cast("double")), "labels")  # exact as a double
    n = rows.count()
    chosen = rows if n <= most else rows.where(F.col("place") >= kth_largest(rows, "place", most))
    return {r["doc_id"]: r["label"] for r in chosen.select("doc_id", "label").collect()}  # `most`, and ties
