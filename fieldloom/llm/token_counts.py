"""Token counts through a digest cache.

A count is stored under the SHA-256 of the content and the SHA-256 of the tokenizer file. Rows
join the cache by digest; of the contents that miss, each distinct one is encoded once, and its
count is appended. Content is the whole text, null as empty; nothing else is normalised, since
any other change could change the count.

The library counts: either the whole text or, where the text holds no special string and only
characters that every regular-expression library classes alike, its pieces, each encoded once and
remembered within bounds. Repeated rows get equal counts; an empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Membership, bucketed, hot_join, require, small, stored, text_or_empty

REMEMBERED = 300_000
#: ASCII, Latin, Greek and Cyrillic letters and signs without the odd spaces and controls.
ODD = re.compile("[^\\t\\n\\r -~¡-¬®-ɏΑ-ΡΣ-ώЀ-ҁҊ-ӿ]")


def version(path: str) -> str:
    """The digest of the tokenizer: file content and kind of library."""
    with open(path, "rb") as file:
        return hashlib.sha256(os.path.splitext(path)[1].encode() + b"\0" + file.read()).hexdigest()


class Counter:
    """Counts tokens of texts by a tokenizers (.json) or sentencepiece (.model) file. `pattern` splits texts for byte-level .json files."""

    def __init__(self, path: str, pattern: str | None):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.pattern, self.many = None, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.special = [a.content for a in t.get_added_tokens_decoder().values()]
            self.pattern = regex.compile(pattern) if pattern else None
            self.many = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        self.fresh: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if self.pattern is None:
            return self.many(texts)
        out, split = [0] * len(texts), []
        whole = [i for i, t in enumerate(texts) if ODD.search(t) or any(s in t for s in self.special)]
        for i, n in zip(whole, self.many([texts[i] for i in whole]), strict=True):
            out[i] = n
        for i in sorted(set(range(len(texts))) - set(whole)):
            split.append((i, self.pattern.findall(texts[i])))
            if len(split) >= 256:
                self._pieces(split, out)
                split = []
        self._pieces(split, out)
        return out

    def _pieces(self, split: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self.fresh) > REMEMBERED:
            self.fresh, self.older = {}, self.fresh
        missing = {p for _, pieces in split for p in pieces if p not in self.fresh}
        for p in [p for p in missing if p in self.older]:
            self.fresh[p] = self.older[p]
            missing.discard(p)
        new = list(missing)
        self.fresh.update(zip(new, self.many(new), strict=True))
        for i, pieces in split:
            out[i] = sum(map(self.fresh.__getitem__, pieces))


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str | None) -> Counter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path, pattern)


class CountCache:
    """Stored counts: the table `name`, which only grows, bucketed and sorted by content; `buckets` is fixed when it is made."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16):
        self.spark, self.name, self.buckets = spark, name, buckets

    def of(self, tokenizer: str) -> DataFrame:
        """content, n_tokens of one tokenizer version. Joins by content with tables of the same buckets do not move these rows."""
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.range(0).select(F.col("id").cast("string").alias("content"), F.col("id").alias("n_tokens"))
        return self.spark.table(self.name).where(F.col("tokenizer") == tokenizer).select("content", "n_tokens")

    def append(self, rows: DataFrame, tokenizer: str) -> None:
        made = rows.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").repartition(self.buckets, "content")
        made.write.mode("append").format("parquet").bucketBy(self.buckets, "content").sortBy("content").saveAsTable(self.name)

    def count(self, docs: DataFrame, path: str, pattern: str | None = None, limit: int = 512) -> DataFrame:
        """Per row doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Documents are told apart by doc_id and content."""
        require(docs, ("doc_id", "text"), "token counts")
        tokenizer = version(path)
        texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("content", F.sha2("text", 256))
        rows = stored(texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "contents")
        first = rows.groupBy("content").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("key"))
        asked = bucketed(first, "content", self.buckets)
        misses = stored(self.missing(asked, tokenizer).withColumn("mark", F.xxhash64("content", "key")), "misses")
        if not misses.isEmpty():
            self._encode(texts, misses, path, pattern, tokenizer)
        counts = stored(self.found(asked, tokenizer), "counts")
        return hot_join(rows, counts, ["content"], ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

    def missing(self, asked: DataFrame, tokenizer: str) -> DataFrame:
        """asked (content and more, bucketed as the cache is) without what the cache holds. The cache is not moved."""
        return asked.join(self.of(tokenizer).select("content").hint("merge"), "content", "left_anti")

    def found(self, asked: DataFrame, tokenizer: str) -> DataFrame:
        """content, n_tokens of what is asked and the cache holds. The cache is not moved."""
        return asked.select("content").join(self.of(tokenizer).hint("merge"), "content")

    def _encode(self, texts: DataFrame, misses: DataFrame, path: str, pattern: str | None, tokenizer: str) -> None:
        """Encodes one text of each missing content and appends the counts. A filter of the misses, sized by their number, keeps all other texts where they are."""
        missing = Membership(misses, "mark")

        def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            zip_ = zstandard.ZstdCompressor(level=1).compress
            for batch in small(batches):
                batch = batch.filter(pa.array(missing.of(batch.column("mark").to_numpy())))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("content"), pa.array([zip_(t.as_buffer()) for t in batch.column("text")], pa.binary())], ["key", "content", "text"])

        # The texts that miss are shuffled by key: compressed, as that is all this job writes of size.
        keyed = texts.withColumn("key", F.coalesce("doc_id", F.lit(-1))).select("key", "content", F.xxhash64("content", "key").alias("mark"), F.col("text").cast("binary").alias("text"))
        zipped = keyed.mapInArrow(smaller, "key long, content string, text binary")
        encode = zipped.join(misses.select("key", "content").hint("merge"), ["key", "content"], "left_semi").select("content", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, unzip = counter(path, pattern), zstandard.ZstdDecompressor().decompress
            for batch in small(batches):
                texts = [str(unzip(t.as_buffer()), "utf-8", "replace") if len(t.as_buffer()) else "" for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(c.counts(texts), pa.int64())], ["content", "n_tokens"])

        # Rows that repeat a doc_id and its text miss together; they count once.
        self.append(encode.mapInArrow(run, "content string, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), tokenizer)
