"""The digest index and the count cache stay where they are, whatever the number of shuffle partitions."""

import uuid

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup, token_counts


@pytest.fixture
def wide(spark):
    """200 shuffle partitions and no broadcasts, as between large tables."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(keep, ("200", "-1", "true"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def joins(monkeypatch, module, call):
    """The plans of what `call` writes, by the names of its work tables."""
    plans, write = {}, module.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(module, "stored", noted)
    call()
    return plans


def docs(spark, n=300):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))


def test_deduplicate_does_not_move_the_index(wide, monkeypatch):
    index = exact_dedup.DigestIndex(wide, f"index_{uuid.uuid4().hex}")
    index.deduplicate(docs(wide, 40)).collect()
    plans = joins(monkeypatch, exact_dedup, lambda: index.deduplicate(docs(wide)).collect())
    for name, kind in (("new", "LeftAnti"), ("old", "Inner")):
        assert "SortMergeJoin" in plans[name] and kind in plans[name] and "Exchange" not in plans[name], plans[name]
    got = index.deduplicate(docs(wide)).collect()
    assert not any(r["kept"] for r in got if r["doc_id"] >= 50) and all(r["kept"] and r["keep_id"] == r["doc_id"] for r in got if r["doc_id"] < 50)
    assert wide.table(index.name).count() == 50


def test_count_does_not_move_the_cache(wide, monkeypatch):
    cache = token_counts.CountCache(wide, f"cache_{uuid.uuid4().hex}")
    call = lambda df: {r["doc_id"]: r["n_tokens"] for r in cache.count(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    first = call(docs(wide, 40))
    plans = joins(monkeypatch, token_counts, lambda: call(docs(wide)))
    for name, kind in (("misses", "LeftAnti"), ("counts", "Inner")):
        assert "SortMergeJoin" in plans[name] and kind in plans[name] and "Exchange" not in plans[name], plans[name]
    again = call(docs(wide))
    assert {k: again[k] for k in first} == first and wide.table(cache.name).count() == 50


def test_very_many_rows_of_one_text_without_doc_id(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(" same  text").alias("text"), F.lit("x").alias("row"), F.lit(1).alias("first_row"))
    got = exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}").deduplicate(df.unionByName(df.limit(3).withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit("other " * 40_000)))).collect()
    assert len(got) == 5003 and sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got} == {3, 5000}
    assert exact_dedup.kept_rows(df, exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}")).count() == 1
