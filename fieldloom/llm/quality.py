"""Quality classifier by importance resampling.

Two bags of hashed n-grams are counted: over all documents (raw), and over those labelled good
(target). A document's log weight is the mean, over its n-grams, of log p_target - log p_raw, so that
long texts weigh no more than short ones. Of all documents, k are drawn without replacement with
chances in proportion to exp(log weight / temperature): Gumbel noise times the temperature is added to each
log weight and the k largest sums are taken.

k is the number of documents whose weight exceeds the threshold that best separates good from bad among
the labelled documents of one fold, which are not in the target: a model's opinion of what it was made
of would be too good. The noise comes from a hash of doc_id and the seed, so that a run repeats itself.

n-grams: words and punctuation runs, and pairs of neighbours. Both counts are over whole texts of all
documents; only the labelled ids are bounded (labelled.MAX_LABELLED).

Null and empty texts have no n-grams and log weight 0. Repeated rows get equal weights and, with
equal doc_ids, equal noise. Ties at the k-th place all stay, as do ties at the threshold. Without labels of both
kinds every document is kept. An empty table gives an empty result. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import kth_largest, require, small, stored, text_or_empty
from fieldloom.llm.labelled import MAX_LABELLED, labelled_ids

BUCKETS = 1 << 18
NOISE = "__gumbel_noise"
TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Counts added to both sides of a ratio: this share of the target's n-grams, at least half of one. Folds of labels; the first makes the threshold.
SMOOTH, FOLDS = 1 / 60_000, 5


class Grams:
    """The buckets of a text's n-grams; remembers the hashes of a bounded number of words."""

    def __init__(self, most: int = 150_000):
        self.known: dict[str, int] = {}
        self.most = most

    def _hash(self, token: str) -> int:
        value = self.known.get(token)
        if value is None:
            if len(self.known) >= self.most:
                self.known.clear()
            value = self.known[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str) -> np.ndarray:
        tokens = TOKENS.findall(text)
        if not tokens:
            return np.zeros(0, np.int64)
        h = np.fromiter(map(self._hash, tokens), np.uint64, len(tokens))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        both = np.concatenate([h, pair ^ (pair >> np.uint64(31))])
        return ((both >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame, good: set[int]) -> DataFrame:
    """bucket, raw, target: n-grams in all documents, and in those of `good`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in small(batches):
            found = [grams.of(text) for text in batch.column(1).to_pylist()]
            chosen = [x for x, doc_id in zip(found, batch.column(0).to_pylist(), strict=True) if doc_id in good]
            for total, part in ((raw, found), (target, chosen)):
                if part:
                    total += np.bincount(np.concatenate(part), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counted: DataFrame) -> np.ndarray:
    """Per bucket log p_target - log p_raw, smoothed in proportion to the target; BUCKETS numbers whatever the input."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    more = max(0.5, SMOOTH * target.sum())
    return np.log((target + more) / (raw * (target.sum() / raw.sum()) + more))


def weight(ratios: np.ndarray, grams: np.ndarray) -> float:
    return float(ratios[grams].mean()) if len(grams) else 0.0


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight, n_grams per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in small(batches):
            found = [grams.of(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([weight(ratios, x) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "log_weight", "n_grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, log_weight double, n_grams long")


def best_threshold(scores: list[tuple[float, int]]) -> float | None:
    """The log weight that best separates good (1) from bad (0): lost good documents, weighing four times, and kept bad ones are fewest by share; None without both kinds."""
    s = np.array(sorted(scores), dtype=float).reshape(-1, 2)
    good, bad = (s[:, 1] == 1).sum(), (s[:, 1] == 0).sum()
    if not good or not bad:
        return None
    lost = np.concatenate([[0], np.cumsum(s[:, 1] == 1)]) / good
    gone = np.concatenate([[0], np.cumsum(s[:, 1] == 0)]) / bad
    error = 4 * lost + 1 - gone
    error[1:-1][s[1:, 0] == s[:-1, 0]] = 9  # no cut between equal weights
    cut = int(np.argmin(error))
    return -np.inf if cut == 0 else np.inf if cut == len(s) else float(s[cut - 1, 0] + s[cut, 0]) / 2


def _noise(seed: int, temperature: float):
    """Gumbel noise from a hash of doc_id."""
    uniform = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -temperature * F.log(-F.log(uniform))


def decided(docs: DataFrame, labels: DataFrame, seed: int = 17, temperature: float = 0.01, most: int = MAX_LABELLED) -> tuple[DataFrame, np.ndarray, float]:
    """The weights of all rows (stored), the log ratios, and the k-th largest Gumbel key."""
    require(docs, ("doc_id", "text"), "the quality classifier")
    label = labelled_ids(labels, "quality", most)
    held = {d: x for d, x in label.items() if xxhash.xxh3_64_intdigest(str(d).encode()) % FOLDS == 0}
    if len(set(held.values())) < 2:
        held = label  # too few labels to hold any out
    ratios = log_ratios(counts(docs, {d for d, x in label.items() if x and (d not in held or held is label)}))
    rows = stored(weights(docs, ratios).withColumn("gumbel_key", F.col("log_weight") + _noise(seed, temperature)), "weights")
    known = rows.sparkSession.createDataFrame([(d,) for d in held], "doc_id long")  # at most `most` rows
    cut = best_threshold([(r["log_weight"], held[r["doc_id"]]) for r in rows.join(F.broadcast(known), "doc_id", "left_semi").select("doc_id", "log_weight").distinct().collect()]) if held else None
    k = rows.count() if cut is None else rows.where(F.col("log_weight") > cut).count()
    return rows, ratios, float(kth_largest(rows, "gumbel_key", k)) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame, seed: int = 17, temperature: float = 0.01, most: int = MAX_LABELLED) -> DataFrame:
    """Per row doc_id, log_weight, gumbel_key (log weight with noise), kept."""
    rows, _, least = decided(docs, labels, seed, temperature, most)
    return rows.select("doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, seed: int = 17, temperature: float = 0.01, most: int = MAX_LABELLED) -> DataFrame:
    """The drawn documents with all their columns. Their keys are computed anew from the text, so that texts need no shuffle."""
    _, ratios, least = decided(docs, labels, seed, temperature, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in small(batches):
            found = [grams.of(text or "") for text in batch.column("text").to_pylist()]
            kept = np.array([weight(ratios, x) for x in found]) + batch.column(NOISE).to_numpy(zero_copy_only=False) >= least
            yield batch.filter(pa.array(kept, pa.bool_())).drop_columns([NOISE])

    return docs.withColumn(NOISE, _noise(seed, temperature)).mapInArrow(run, docs.schema)
