"""Helpers the training-data operators share: work tables in the shared folder, and text rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, [\x20\x09-\x0D], as Java and as DuckDB regular expressions read it.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shipped(spark: SparkSession) -> None:
    """Gives the executors this package, once a session: their Python may not have it."""
    sc = spark.sparkContext
    if getattr(sc, "_fieldloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='fieldloom-')}/fieldloom", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    sc._fieldloom_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, so that later steps neither repeat nor lose its work.

    Results are read when they are asked for, so the folder stays until `cleared` or the session's end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _made(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if not hasattr(sc, "_fieldloom_paths"):
        sc._fieldloom_paths, sc._fieldloom_tables = [], []
        atexit.register(cleared, spark)
    sc._fieldloom_paths.append(path)


def own_table(spark: SparkSession, name: str) -> str:
    """A table's name, for a table that is dropped as work folders are."""
    _made(spark, f"{shared_dir(spark)}/fieldloom-none")
    spark.sparkContext._fieldloom_tables.append(name)
    return name


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df as a table of its own in buckets by a column, sorted by it: joins by the column with tables of as many buckets move neither."""
    name = own_table(df.sparkSession, f"fieldloom_{uuid.uuid4().hex}")
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    return df.sparkSession.table(name)


def cleared(spark: SparkSession) -> None:
    """Removes all work folders and own tables of the session; call it once results have been written. What is gone already is no fault, nor is a session that has ended."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for name in getattr(sc, "_fieldloom_tables", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in getattr(sc, "_fieldloom_paths", []):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    sc._fieldloom_paths, sc._fieldloom_tables = [], []


def hot_keys(left: DataFrame, on: list[str], share: int = 500) -> DataFrame:
    """The keys with more than one in `share` of the rows, of which there are fewer than `share`, and into how many parts each is dealt."""
    n = left.count()
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * share > n).select(*on, F.ceil(F.col("__n") * share / max(n, 1)).cast("int").alias("__parts"))
    return left.sparkSession.createDataFrame(hot.collect(), hot.schema)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right, whose keys are unique; keys with very many of left's rows (hot_keys) are dealt over several tasks by a hash of `spread`. Keys that are null join as they do in any join."""
    hot = F.broadcast(hot_keys(left, on) if hot is None else hot)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("__parts")
    copied = right.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [*on, "__part"], how).drop("__part")


#: Bits of a membership filter for each member, and of any filter at most: 32 MB.
MEMBER_BITS, MOST_BITS = 12, 1 << 28


class Membership:
    """A filter of 64-bit hashes that lets all members pass, and of others about one in MEMBER_BITS; more where there are so many members that the filter would exceed MOST_BITS.

    It saves moving rows; what passes is joined exactly afterwards."""

    def __init__(self, members: DataFrame, column: str):
        spark = members.sparkSession
        n = members.count()
        self.bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (MEMBER_BITS * max(n, 1) - 1).bit_length()))
        block = min(self.bits, 1 << 19)
        at = F.pmod(F.col(column), F.lit(self.bits))
        rows = members.select((at / block).cast("int").alias("block"), (at % block).cast("int").alias("at"))

        def run(key: tuple, group: pa.Table) -> pa.Table:
            on = np.zeros(block, np.uint8)
            on[group.column("at").to_numpy()] = 1
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

        whole = np.zeros(self.bits // 8, np.uint8)
        for r in rows.distinct().groupBy("block").applyInArrow(run, "block int, bits binary").collect():  # MOST_BITS in all
            whole[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
        self.filter = spark.sparkContext.broadcast(whole)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Which may be members; called in tasks."""
        at = hashes.astype(np.int64) & (self.bits - 1)
        return (self.filter.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def __getstate__(self):
        return {"bits": self.bits, "filter": self.filter}


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds what it makes of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kth_largest(df: DataFrame, column: str, k: int, parts: int = 4096) -> float:
    """The k-th largest value, by counting over ever narrower ranges: no sort, and nothing but counts reaches the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            break
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1))
        inside = df.where(F.col(column).between(low, high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(inside, key=lambda r: -r["slot"]):
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return high


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, as UTF-8: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def require(df: DataFrame, columns: Iterable[str], who: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{who} needs the columns {missing}")
