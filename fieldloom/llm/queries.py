"""The queries op1_ to op13_, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, chat_format, exact_dedup, lm_scoring, ngram_join, oracles, packing, periodic_runs, quality, rp_forest, spelling, token_counts, toxicity, url_filter
from fieldloom.llm.common import own_table, shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Fixed values of the contract.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The rules of the query's SQL, which has the verdicts of the third and fourth the other way round and is left as it was: so verdicts and scores of the two differ.
SQL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), every=True)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index, filled by one call."""
    index = exact_dedup.DigestIndex(spark, own_table(spark, f"fieldloom_digests_{uuid.uuid4().hex}"))
    return index.deduplicate(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache, filled by one call."""
    cache = token_counts.CountCache(spark, own_table(spark, f"fieldloom_counts_{uuid.uuid4().hex}"))
    return cache.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least=7, seldom=2, ratio=10, delete_every=31)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeating(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.find(docs))


#: The fixed conversation of the contract: what both of its turns say.
TRICKY = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = rows.unionByName(fixed).withColumn("parts", chat_format.text_part(F.coalesce("text", F.lit(""))))
    return chat_format.digests(chat_format.formatted(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_resampling": op2_quality_resampling,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}


def _url_sql(rounds: int = 8, follow: float = 0.85) -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in SQL_RULES)
    away = url_filter.HREF.replace("'", "''")
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '{url_filter.HOST}', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    steps = "".join(
        f""", s{k + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM s0
        UNION ALL SELECT dst, trust * n / out_n * {follow}, 0.0 FROM shares JOIN s{k} ON src = host
        UNION ALL SELECT src, 0.0, distrust * n / in_n * {follow} FROM shares JOIN s{k} ON dst = host) GROUP BY host)"""
        for k in range(rounds)
    )
    return f"""WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {rules}),
    parts AS MATERIALIZED (SELECT page_id, {host("url")} AS host, regexp_extract(coalesce(url, ''), '{url_filter.PATH}', 1) AS path FROM pages),
    best AS MATERIALIZED (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS ruled FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
    votes AS MATERIALIZED (SELECT host, sum(CASE ruled WHEN 'block' THEN 1 ELSE -1 END) > 0 AS bad FROM parts JOIN best USING (page_id) GROUP BY host),
    s0 AS MATERIALIZED (SELECT host, CASE WHEN bad THEN 0 ELSE 1.0 / sum((NOT bad)::INT) OVER () END * (1 - {follow}) AS trust, CASE WHEN bad THEN 1.0 / sum(bad::INT) OVER () ELSE 0 END * (1 - {follow}) AS distrust FROM votes),
    hrefs AS (SELECT {host("url")} AS src, regexp_replace(unnest(regexp_extract_all(coalesce(html, ''), '{away}', 1)), '^//', 'http://') AS href FROM pages),
    links AS (SELECT src, {host("href")} AS dst, count(*) AS n FROM hrefs GROUP BY ALL HAVING src <> '' AND dst <> '' AND src <> dst),
    shares AS MATERIALIZED (SELECT src, dst, n, sum(n) OVER (PARTITION BY src) AS out_n, sum(n) OVER (PARTITION BY dst) AS in_n FROM links){steps}
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(coalesce(distrust, 0), 9) > round(coalesce(trust, 0), 9) THEN 'block' ELSE 'allow' END) AS verdict,
        round(coalesce(trust, 0), 9)::DOUBLE AS trust, round(coalesce(distrust, 0), 9)::DOUBLE AS distrust
    FROM parts LEFT JOIN best USING (page_id) LEFT JOIN s{rounds} USING (host)"""


SQL: dict[str, str] = {
    "op6_url_filter": _url_sql(),
    "op8_exact_dedup": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)""",
    "op11_spelling_variants": oracles.VARIANTS,
    "op12_periodic_runs": oracles.RUNS,
    "op13_chat_format": r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS e, length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n')) AS n FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, e)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, e) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<turn>#') + n + 1 + length(e) + length('</turn>') + 1)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
}
