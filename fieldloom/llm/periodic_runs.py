"""Maximal runs of words by a suffix tree (Stoye and Gusfield's branching tandem repeats).

The texts of a batch go into one array of word numbers. Each text has numbers of its own and an
end that occurs once, so that no two texts share a prefix, and the suffix tree of the array is the
trees of the texts side by side. Its nodes are the intervals of the sorted suffixes between which
the common prefix is nowhere shorter than the node's depth.

At each node the leaf lists of all children but the largest are walked (every leaf is walked
O(log n) times at most). A leaf i of a node of depth d begins a tandem repeat of period d if leaf
i + d is in the node too, and ends one if leaf i - d is; the repeat is branching if the words after
its halves differ. Every run has just one branching repeat of its period, the one at its end. From
there rotations to the left lead to the run's start, and repeats whose period is a multiple of a
run's at the same end are that run again.

Rows are handled each on its own, in Arrow batches where Spark has put them: nothing is shuffled.
Memory follows a batch of about BATCH_WORDS words, or the longest single text. Null texts have no
words. Repeated rows get equal results, whatever doc_id they have; an empty table gives an empty
result; extra columns are ignored, whatever their names. Ties: see `best`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import WORDS, require, small, text_or_empty

BATCH_WORDS = 200_000


class _Numbers(dict):
    """Numbers from 1 on, in the order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts, each text with its end behind it, and where each text begins (and the last ends)."""
    numbers = _Numbers()
    at = np.cumsum([0, *(len(words) + 1 for words in texts)])
    s = np.zeros(at[-1], np.int64)
    for k, words in enumerate(texts):
        s[at[k] : at[k + 1] - 1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return s + np.repeat(np.arange(len(texts)) * (len(numbers) + 1), np.diff(at)), at


def _heads(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot of the first of each group; `new` marks the firsts."""
    return np.maximum.accumulate(np.where(new, slots, 0))


def sorted_suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in an order that keeps common prefixes together, the rank of each, and its common prefix with the one before (-1 at either end of the list).

    Prefix doubling. Only suffixes that still have a like are sorted again, and the ranks of every round stay, as they tell how long a prefix two suffixes share."""
    n = len(s)
    key = s * (int(s.max()) + 1)
    key[:-1] += s[1:]
    sa = np.argsort(key).astype(np.int32)
    sorted_key, first = key[sa], s[sa]
    slots = np.arange(n, dtype=np.int32)
    new = np.ones(n + 1, bool)
    new[1:-1] = sorted_key[1:] != sorted_key[:-1]
    lcp = np.full(n + 1, -1, np.int32)
    lcp[1:-1] = first[1:] == first[:-1]
    rank = np.empty(n, np.int32)
    rank[sa] = _heads(new[:-1], slots)
    levels, h = [s], 2
    slots = slots[~(new[:-1] & new[1:])]
    while len(slots):
        at = sa[slots]
        key = (rank[at].astype(np.int64) << 32) | rank[at + h]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        fresh = np.ones(len(at) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        levels.append(rank.copy())
        split = np.flatnonzero(fresh[1:-1] & (key[1:] >> 32 == key[:-1] >> 32)) + 1
        a, b, shared = at[split - 1] + h, at[split] + h, np.full(len(split), h, np.int32)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][a] == levels[k][b]
            step = same.astype(np.int32) << k
            a, b, shared = a + step, b + step, shared + step
        lcp[slots[split]] = shared
        rank[at] = _heads(fresh[:-1], slots)
        slots = slots[~(fresh[:-1] & fresh[1:])]
        h *= 2
    return sa, rank, lcp


def _jumped(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each of `at`, the nearest place in the step's direction with a smaller value; the pointers of places passed over are used again."""
    to = np.arange(len(lcp), dtype=np.int32) + step
    todo = at
    while len(todo):
        over = to[todo]
        todo, over = todo[(low := lcp[over] >= lcp[todo])], over[low]
        to[todo] = to[over]
    return to[at]


def lesser_children(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per child of an inner node that isn't the node's largest: first and last (exclusive) leaf, and depth, first and last leaf of the node."""
    one, deep = np.flatnonzero(lcp == 1), np.flatnonzero(lcp > 1)
    ends = np.flatnonzero(lcp < 1)
    after = np.searchsorted(ends, one)
    left, right = _jumped(lcp, deep, -1), _jumped(lcp, deep, 1)
    order = np.lexsort((deep, right, left))
    ks = np.concatenate([one, deep[order]])  # where a child begins, node after node
    lo = np.concatenate([ends[after - 1], left[order]])
    hi = np.concatenate([ends[after], right[order]])
    if not len(ks):
        return ks, ks, ks, ks, ks
    new = np.ones(len(ks), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    new[len(one) :][:1] = True
    starts = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    end = np.where(np.append(new[1:], True), hi, np.append(ks[1:], 0))
    size, size_first = end - ks, ks[starts] - lo[starts]
    most = np.maximum(np.maximum.reduceat(size, starts), size_first)
    largest = np.flatnonzero((size == most[node]) & (size_first < most)[node])
    largest = largest[np.append(True, np.diff(node[largest]) > 0)[: len(largest)]]
    keep = np.ones(len(ks), bool)
    keep[largest] = False
    firsts = starts[size_first < most]
    pick = np.flatnonzero(keep)
    both = np.concatenate([pick, firsts])
    return np.concatenate([ks[pick], lo[firsts]]), np.concatenate([end[pick], ks[firsts]]), lcp[ks[both]], lo[both], hi[both]


def branching_repeats(s: np.ndarray, sa: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Rows (start, period) of all branching tandem repeats with a word before them that keeps their period."""
    first, last, depth, lo, hi = lesser_children(lcp)
    found, n = [np.zeros((0, 2), np.int64)], len(s)
    step = np.cumsum(last - first)
    for cut in np.split(np.arange(len(first)), np.searchsorted(step, np.arange(4 * BATCH_WORDS, step[-1] if len(step) else 0, 4 * BATCH_WORDS))):
        size = (last - first)[cut]
        leaf = np.repeat(first[cut] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(cut) else first[cut], size) + np.arange(size.sum())
        d, low, high = (np.repeat(x[cut], size) for x in (depth, lo, hi))
        i = sa[leaf]
        for start, other in ((i, i + d), (i - d, i - d)):
            inside = (other >= 0) & (other < n)
            r = rank[np.where(inside, other, 0)]
            at = np.flatnonzero(inside & (r >= low) & (r < high) & (start > 0))
            x, p = start[at].astype(np.int64), d[at].astype(np.int64)
            ok = (s[x + p] != s[x + 2 * p]) & (s[x - 1] == s[x - 1 + p])
            found.append(np.column_stack([x[ok], p[ok]]))
    return np.unique(np.concatenate(found), axis=0)


def _rotated(s: np.ndarray, start: int, period: int) -> int:
    """How far left a repeat's period goes on."""
    width = 2 * period + 8
    while True:
        low = max(0, start - width)
        differ = np.flatnonzero(s[low:start] != s[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        if low == 0:
            return 0
        width *= 4


def maximal_runs(s: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least max(least, repeats * period) words; repeats >= 3, so that a run's last repeat has a word before it."""
    if not len(s):
        return []
    ends: dict[int, list[tuple[int, int]]] = {}
    pairs = branching_repeats(s, *sorted_suffixes(s))
    for x, p in pairs[np.argsort(pairs[:, 1], kind="stable")].tolist():
        same = ends.setdefault(x + 2 * p, [])
        if not any(p % q == 0 and begun <= x for begun, q in same):
            same.append((_rotated(s, x, p), p))
    return sorted((begun, end - begun, q) for end, found in ends.items() for begun, q in found if end - begun >= max(least, repeats * q))


def find(docs: DataFrame, least: int = 6, repeats: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words that no run holds after its first period, joined by one space."""
    require(docs, ("doc_id", "text"), "periodic runs")
    if repeats < 3:
        raise ValueError("a run must hold its period at least three times")

    def several(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        s, at = numbered(texts)
        by: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for start, length, period in maximal_runs(s, least, repeats):
            k = int(np.searchsorted(at, start, side="right")) - 1
            by[k].append((start - int(at[k]), length, period))
        out = []
        for words, runs in zip(texts, by, strict=True):
            if runs:
                keep = np.ones(len(words), bool)
                for start, length, period in runs:
                    keep[start + period : start + length] = False
                words = [words[k] for k in np.flatnonzero(keep).tolist()]
            out.append(b" ".join(words))
        spans = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in runs] for runs in by], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        counts = pa.array([len(words) for words in texts], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), counts, spans, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts, n = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = bytes(t.as_buffer()).split() if len(t.as_buffer()) else []
                if texts and n + len(words) > BATCH_WORDS:
                    yield several(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(words)
                n += len(words)
            if texts:
                yield several(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def best(runs: str = "runs") -> Column:
    """The run with the greatest exact length over period; ties: the smallest start, then the smallest period. Null without runs."""
    higher = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce(F.col(runs), F.col(runs)[0], lambda a, b: F.when(higher(b, a), b).otherwise(a))


def digests(found: DataFrame) -> DataFrame:
    """Of what find returns: doc_id, n_runs, start, length, period and exponent_milli of the best run, and SHA-256 of the runs' list and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.withColumn("best", F.when(F.size("runs") > 0, best()))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeating(docs: DataFrame) -> DataFrame:
    """The texts of the query's contract: in a tenth of them, by a hash of doc_id, the words from a place on repeat a stretch. Others stay as they are."""
    words = F.regexp_extract_all(text_or_empty(), F.lit(f"({WORDS})"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("__h", h).withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    g, n = F.floor(F.col("__h") / 10), F.size("__w")
    placed = chosen.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", F.when(n > 0, 1 + F.floor((n - F.col("__a")) / (3 + g % 8))))
    again = F.expr("array_join(transform(__w, (w, i) -> if(i >= __a, __w[int(__a + (i - __a) % __p)], w)), ' ')")
    return placed.withColumn("text", F.when(n > 0, again).otherwise(text_or_empty())).drop("__h", "__w", "__a", "__p")
