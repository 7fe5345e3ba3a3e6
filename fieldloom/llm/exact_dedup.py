"""Exact deduplication against a persistent digest index.

The index is a table of one row per known text, bucketed and sorted by the text's SHA-256. New
documents are reduced to one row per digest (partial aggregation comes before the shuffle, so a
huge group of copies costs no more than any other) and written in the same buckets as the index. A sort-merge anti-join with the index leaves the texts that are new, which
are appended, and an inner join gives the others' documents; neither moves the index.

Only DataFrame operations run. Null texts count as empty, and all empty texts are equal.
Rows that repeat the same doc_id and text are copies of each other: one of them stays. Rows
without doc_id stay only if no row of the same text has one. An empty table adds nothing. A text of
any length counts whole; only its digest moves.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACES, bucketed, hot_join, require, stored, text_or_empty


def text_digest(column: str = "text"):
    """SHA-256 (lowercase hex) of the text in UTF-8 with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(text_or_empty(column), SPACES, " "), 256)


class DigestIndex:
    """The index table `name`; `buckets` is fixed when the table is made: about one for every 100 million texts at full size."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16):
        self.spark, self.name, self.buckets = spark, name, buckets

    def known(self) -> DataFrame:
        """text_sha256, keep_id."""
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.range(0).select(F.col("id").cast("string").alias("text_sha256"), F.col("id").alias("keep_id"))
        return self.spark.table(self.name).select("text_sha256", "keep_id")

    def append(self, rows: DataFrame) -> None:
        rows.select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256").write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """Decides on every row of docs, appends what is new, and returns doc_id, keep_id, group_size, kept, text_sha256.

        keep_id: the document that stays, from this or an earlier call; null where that had no doc_id, and then no later row stays. group_size: rows of this text in this call."""
        require(docs, ("doc_id", "text"), "exact dedup")
        rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
        groups = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
        groups = bucketed(groups, "text_sha256", self.buckets)
        new = stored(self.unseen(groups).select("text_sha256", "group_size", F.col("first_id").alias("keep_id"), F.lit(False).alias("known")), "new")
        old = stored(self.seen(groups).select("text_sha256", "group_size", "keep_id", F.lit(True).alias("known")), "old")
        self.append(new)
        # Rows that repeat a doc_id and its text: the first of them. Counted before they meet, so a text with very many such rows is no task of its own.
        again = stored(rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")).where("n > 1").select("text_sha256", F.col("doc_id").alias("__doc"), "first_row"), "repeated")
        judged = hot_join(rows, new.unionByName(old), ["text_sha256"], ["row"])
        if not again.isEmpty():
            judged = judged.join(again.withColumnRenamed("text_sha256", "__sha"), (F.col("text_sha256") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
        else:
            judged = judged.withColumn("first_row", F.lit(None).cast("long"))
        first = F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & first & ~(F.col("known") & F.col("doc_id").isNull())
        return judged.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """groups (bucketed as the index is) that the index does not hold: a sort-merge anti-join that leaves the index where it is."""
        return groups.join(self.known().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def seen(self, groups: DataFrame) -> DataFrame:
        """groups that the index holds, with its keep_id; the index is not moved."""
        return groups.join(self.known().hint("merge"), "text_sha256")


def kept_rows(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, with all their columns; a text stays once."""
    decided = stored(index.deduplicate(docs).select("doc_id", "text_sha256", "kept"), "decided")
    stay = decided.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__key", F.col("doc_id").cast("long")).withColumn("__digest", text_digest())
    joined = marked.join(stay, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    # Only rows that repeat both doc_id and text have more than one row left.
    if not decided.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        joined = joined.dropDuplicates(["__key", "__digest"])  # one row of each before they meet
    return joined.select(*docs.columns)
