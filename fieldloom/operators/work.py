"""Work tables in the folder that driver and executors share. They stay until `cleared`, at the latest to the session's end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/fieldloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _made(spark: SparkSession, path: str, table: str | None = None) -> None:
    sc = spark.sparkContext
    if not hasattr(sc, "_fieldloom_work"):
        sc._fieldloom_work, sc._fieldloom_buckets = [], []
        atexit.register(cleared, spark)
    sc._fieldloom_work.append(path)
    if table:
        sc._fieldloom_buckets.append(table)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df, which is to be partitioned by column into so many parts, as a work table in buckets by it: what is joined or grouped by the column afterwards is not moved again."""
    spark, name = df.sparkSession, f"fieldloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
    _made(spark, path, name)
    return spark.table(name)


#: Bits of `likely` for each member, and in all: a million words of 64.
MEMBER_BITS, MOST_BITS = 16, 1 << 26


def likely(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is one of members' (distinct), and some others: one in MEMBER_BITS, more where there are so many members that these would take more than MOST_BITS.

    The members are hashed to bits, whose words are broadcast, so that df need not move to be rid of most other rows; what passes is to be joined exactly afterwards."""
    bits = min(MOST_BITS, 1 << max(10, (MEMBER_BITS * members.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    words = members.select(at.alias("at")).groupBy(F.expr("at div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("__bits"))
    met = df.withColumns({"__at": at, "__word": F.floor(at / 64)}).join(F.broadcast(words), "__word")  # MOST_BITS / 64 rows at most
    return met.where("shiftright(__bits, int(__at % 64)) & 1 = 1").select(*df.columns)


def dealt(df: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """df partitioned by keys, with a partition for about so many rows: what is grouped by them afterwards holds no more in a task, however large df is. Counts df first."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def cleared(spark: SparkSession) -> None:
    """Removes the session's work tables; call it once results have been written. What is gone already is no fault, nor is a session that has ended."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for name in getattr(sc, "_fieldloom_buckets", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in getattr(sc, "_fieldloom_work", []):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    sc._fieldloom_work, sc._fieldloom_buckets = [], []
