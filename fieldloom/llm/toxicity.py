"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other: each model sees the text's features and the
probabilities of the categories before it. For training, those probabilities come from models
fitted on other folds, as a model's opinion of its own training rows would be too sure.

Features: words and their beginnings of three to six letters, present or not. Of all, those are
used that occur in toxic documents of several families and far more often there than in clean
ones. A family is told by the smallest word hash, so that copies of one text count about once.
The fit uses at most labelled.MAX_LABELLED labelled documents and MAX_FEATURES features.

The tables label one thing only: toxic or not. The categories before it are found in the labelled toxic
documents: the first is those with the word that most of them hold, the next those with the word that most of the
others hold, and so on (KINDS of them at most). Where labels of real categories exist, pass their words instead.

Null and empty texts have no features and get the lowest probability. Repeated rows get equal
results. Without labelled documents of both kinds nothing is toxic. Features of equal count are all used, or none is;
of equal markers the first by name counts. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import kth_largest, require, small, stored, text_or_empty
from fieldloom.llm.labelled import MAX_LABELLED, labelled_ids

KINDS = 3
MAX_FEATURES = 4096
FAMILIES, TIMES = 4, 40.0
FOLDS = 5
WORD = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in range(3, 7) if len(word) >= n)]


def family(found: set[str]) -> int:
    return min((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in found), default=0)


@dataclass
class Chain:
    """features: name to column; per category the weights of features, of the categories before it, and the bias."""

    features: dict[str, int]
    names: tuple[str, ...]
    models: list[np.ndarray]
    threshold: float

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        columns = np.array([c for x in rows for c in x], dtype=np.int64)
        done = np.zeros((len(rows), 0))
        for w in self.models:
            done = np.column_stack([done, predicted(w, at, columns, done, len(self.features))])
        return done


def predicted(w: np.ndarray, at: np.ndarray, columns: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    z = np.bincount(at, w[columns], len(before)) + before @ w[n:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fitted(at: np.ndarray, columns: np.ndarray, before: np.ndarray, y: np.ndarray, n: int, steps: int = 400) -> np.ndarray:
    """Logistic regression with a small quadratic penalty, by Adam over all rows; both kinds weigh the same."""
    w, m, v = np.zeros(n + before.shape[1] + 1), 0.0, 0.0
    good = max(y.sum(), 1)
    weight = np.where(y > 0, 0.5 / good, 0.5 / max(len(y) - y.sum(), 1))
    for t in range(1, steps + 1):
        e = (predicted(w, at, columns, before, n) - y) * weight
        g = np.concatenate([np.bincount(columns, e[at], n), before.T @ e, [e.sum()]]) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def trained(rows: list[list[int]], labels: np.ndarray, folds: np.ndarray, features: dict[str, int], names: tuple[str, ...]) -> Chain:
    """labels: a row per document and a column per category, in the order of the chain."""
    n, models = len(features), []
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), sizes)
    columns = np.array([c for x in rows for c in x], dtype=np.int64)
    outside = np.zeros((len(rows), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        held = np.zeros(len(rows))
        for f in range(FOLDS):
            inside, test = folds != f, folds == f
            number = np.cumsum(inside) - 1
            used = inside[at]
            w = fitted(number[at[used]], columns[used], outside[inside], y[inside], n)
            held[test] = predicted(w, at, columns, outside, n)[test]
        models.append(fitted(at, columns, outside, y, n))
        outside = np.column_stack([outside, held])
    y, p = labels[:, -1].astype(float), outside[:, -1]
    cuts = np.linspace(0.2, 0.8, 25)
    wrong = [(5 * ((p >= c) & (y == 0)).sum() / max((y == 0).sum(), 1) + ((p < c) & (y == 1)).sum() / max(y.sum(), 1), abs(c - 0.5), c) for c in cuts]
    return Chain(features, names, models, float(min(wrong)[2]))


def kinds(rows: list[list[int]], toxic: np.ndarray, features: dict[str, int], most: int = KINDS) -> list[int]:
    """The columns of whole words that, one after the other, most toxic rows without an earlier one hold."""
    words = {c for f, c in features.items() if f.startswith("=")}
    left, out = [set(r) & words for r, t in zip(rows, toxic, strict=True) if t], []
    while len(out) < most:
        held = Counter(c for r in left for c in r)
        if not held:
            break
        out.append(min(held, key=lambda c: (-held[c], c)))
        left = [r for r in left if out[-1] not in r]
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, categories: dict[str, tuple[str, ...]] | None = None) -> Chain | None:
    """The chain, or None without labelled documents of both kinds. categories: names and words of categories, in place of those found in the documents."""
    label = labelled_ids(labels, "toxic", most)
    if len(set(label.values())) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame(list(label.items()), "__id long, __toxic int")  # at most `most` rows
    sample = docs.select(F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "__id")

    def seen(toxic: int, among: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                out: set[tuple[str, int]] = set()
                for text in batch.column("text").to_pylist():
                    found = words(text)
                    kin = family(found)
                    out.update((f, kin) for w in found for f in features_of(w) if among is None or f in among)
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], ["feature", "kin"])

        return sample.where(F.col("__toxic") == toxic).mapInArrow(run, "feature string, kin long").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))

    n_toxic, n_clean = max(1, sum(label.values())), max(1, len(label) - sum(label.values()))
    often = stored(seen(1, None).where(F.col("n") >= FAMILIES), "features")
    least = kth_largest(often, "n", 16 * MAX_FEATURES) if often.count() > 16 * MAX_FEATURES else 0
    bad = {r["feature"]: r["n"] for r in often.where(F.col("n") > least).collect()}  # 16 * MAX_FEATURES at most
    good = {r["feature"]: r["n"] for r in seen(0, set(bad)).collect()}
    ratio = {f: (n / n_toxic) / ((good.get(f, 0) + 0.5) / n_clean) for f, n in bad.items()}
    best = sorted((f for f in bad if ratio[f] >= TIMES), key=lambda f: (-bad[f] * np.log(ratio[f]), f))[:MAX_FEATURES]
    features = {f: k for k, f in enumerate(best)}
    seeds = [frozenset(words) for words in (categories or {}).values()]

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(features)
        for batch in small(batches):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            weak = [[int(bool(s & t)) for s in seeds] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__toxic"), pa.array(list(map(index.of, texts)), pa.list_(pa.int64())), pa.array(weak, pa.list_(pa.int64()))], ["id", "toxic", "columns", "weak"])

    rows = sample.mapInArrow(columns, "id long, toxic int, columns array<long>, weak array<long>").orderBy("id").collect()
    if not rows:
        return None
    found, toxic = [r["columns"] for r in rows], np.array([r["toxic"] for r in rows])
    marks = [] if categories else kinds(found, toxic, features)
    weak = np.array([r["weak"] if categories else [c in set(r["columns"]) for c in marks] for r in rows], dtype=int).reshape(len(rows), -1)
    y = np.column_stack([weak * toxic[:, None], toxic])
    names = (*categories, "toxic") if categories else (*(f"kind_{k + 1}" for k in range(len(marks))), "toxic")
    folds = np.array([xxhash.xxh3_64_intdigest(str(r["id"]).encode()) % FOLDS for r in rows])
    return trained(found, y, folds, features, names)


class Index:
    """The feature columns of a text; remembers a bounded number of words."""

    def __init__(self, features: dict[str, int], most: int = 150_000):
        self.features, self.most = features, most
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, found: set[str]) -> list[int]:
        out: set[int] = set()
        for w in found:
            columns = self.known.get(w)
            if columns is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                columns = self.known[w] = tuple(self.features[f] for f in features_of(w) if f in self.features)
            if columns:
                out.update(columns)
        return sorted(out)


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """Per row doc_id, a probability p_<category> for each of the chain, and toxic: whether the last one reaches the threshold."""
    require(docs, ("doc_id", "text"), "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if chain is None:
        return rows.select("doc_id", F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chain.features)
        for batch in small(batches):
            p = chain.probabilities([index.of(words(t)) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= chain.threshold)], ["doc_id", *(f"p_{c}" for c in chain.names), "toxic"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.names) + ", toxic boolean")


def clean_rows(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    require(docs, ("text",), "toxicity")
    if chain is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chain.features)
        for batch in small(batches):
            p = chain.probabilities([index.of(words(t or "")) for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(p[:, -1] < chain.threshold))

    return docs.mapInArrow(run, docs.schema)
