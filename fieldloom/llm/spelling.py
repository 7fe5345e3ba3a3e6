"""Grouping of spelling variants: words one edit apart, found by automata over trie shards.

Words are counted where their texts are, and the counts added up. The sorted vocabulary is cut into
shards of about SHARD_CHARS code points; each shard becomes a compact trie: arrays of nodes and
edges, in which a path that leads to one word only is kept as that word's tail. Shards are
broadcast in groups of at most BROADCAST_BYTES (or one shard), one group after another, so what is
broadcast does not grow with the vocabulary; only the number of groups does.

Against every shard, the distance-one Levenshtein automaton of each word walks depth-first: along
the word's own path, and at each place it finishes all the walks that leave it by one edit (block
by block, as arrays) before it goes on. Edits are taken in one way only: the last of equal
neighbouring letters is deleted, and a letter is inserted behind its equals. So each accepted word
is met once. Neighbours are counted, and the best kept, where they are found; then per word.

A word's form is its neighbour of largest count (ties: the smallest in code-point order), if that
is at least `ratio` times its own; roots follow forms by joins of doubling reach.

Null texts have no words; a null doc_id counts as an empty one; repeated rows count as often as
they stand; an empty table gives no words. A word of any length is one word. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import require, small, stored, text_or_empty

#: Fixed value of the contract: the letters of words, A-Z lower-cased.
LETTERS = "[a-zÀ-ÿ]"
#: Distinct words that a task counts before it passes them on.
MOST_COUNTED = 200_000
SHARD_CHARS = 4_000_000
BROADCAST_BYTES = 64 << 20
#: Words that a task looks up, and at a time.
TASK_WORDS, BLOCK = 20_000, 2_000
#: The end of a tail is END and the word's number; no code point is as high, and any fits BITS.
END, BITS = 0x110000, 21


def word_counts(docs: DataFrame, least: int = 7, delete_every: int | None = None) -> DataFrame:
    """word, n: runs of LETTERS with at least `least` code points, A-Z lower-cased.

    delete_every: where it divides the CRC-32 of `<doc_id>:<run>`, the run loses the code point at that number, modulo its length."""
    found = re.compile(f"{LETTERS}{{{least},}}").findall  # greedy, so that a run is whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in small(batches):
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                own = Counter(found(str(bytes(t.as_buffer()).lower(), "utf-8", "replace"))) if len(t.as_buffer()) else Counter()
                if delete_every:
                    before = zlib.crc32(b"%s:" % (str(i).encode() if i.is_valid else b""))
                    changed: Counter[str] = Counter()
                    for w, n in own.items():
                        h = zlib.crc32(w.encode(), before)
                        if h % delete_every == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                        if len(w) >= least:
                            changed[w] += n
                    own = changed
                words.update(own)
            if len(words) > MOST_COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
                words = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each word begins (and the last ends)."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Trie:
    """Sorted distinct words as arrays. Nodes count from 0 (the root); a node below 0 is the place ~node in `tail`."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        self.words, self.n = words, n
        chars, at = code_points(words)
        size = np.diff(at)
        a, g, depth, nodes = np.arange(len(words)), np.zeros(len(words), np.int64), 0, 1
        ended, low, high, parent, label, child, tails, tail_at = [], [[size.min(initial=0)]], [[size.max(initial=0)]], [], [], [], [], 0
        while len(a):
            over = size[a] == depth
            ended.append(np.column_stack([g[over], a[over]]))
            a, g = a[~over], g[~over]
            if not len(a):
                break
            c = chars[at[a] + depth]
            new = np.ones(len(a), bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(a)))
            alone = count == 1
            inner = np.cumsum(~alone) - 1 + nodes
            lone = a[first[alone]]
            ends = np.cumsum(size[lone] - depth)
            to = inner.copy()
            to[alone] = ~(tail_at + ends - (size[lone] - depth))
            tail_at += int(ends[-1]) if len(ends) else 0
            tails.append(np.column_stack([lone, np.full(len(lone), depth + 1)]))
            parent.append(g[first])
            label.append(c[first])
            child.append(to)
            low.append(np.minimum.reduceat(size[a], first)[~alone] - depth - 1)
            high.append(np.maximum.reduceat(size[a], first)[~alone] - depth - 1)
            nodes += int((~alone).sum())
            stay = np.repeat(~alone, count)
            a, g = a[stay], np.repeat(inner, count)[stay]
            depth += 1
        whole = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        self.low, self.high, self.label, self.child = whole(low), whole(high), whole(label), whole(child)
        self.first = np.searchsorted(whole(parent), np.arange(nodes + 1)).astype(np.int32)
        self.word = np.full(nodes, -1, np.int32)
        if ended:
            pairs = np.concatenate(ended)
            self.word[pairs[:, 0]] = pairs[:, 1]
        lone = np.concatenate(tails) if tails else np.zeros((0, 2), np.int64)
        long = size[lone[:, 0]] - lone[:, 1] + 1  # with the end
        stop = np.cumsum(long)
        self.tail = np.zeros(int(long.sum()), np.int32)
        fill = np.repeat(at[lone[:, 0]] + lone[:, 1] - (stop - long), long) + np.arange(len(self.tail))
        self.tail[:] = np.append(chars, 0)[np.minimum(fill, len(chars))]
        self.tail[stop - 1] = END + lone[:, 0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "keys"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.keys = (np.repeat(np.arange(len(self.word), dtype=np.int64), np.diff(self.first)) << BITS) | self.label

    def size(self) -> int:
        return sum(x.nbytes for x in (self.words, self.n, self.low, self.high, self.label, self.child, self.first, self.word, self.tail))

    def step(self, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by c, and these children."""
        inner = np.flatnonzero(node >= 0)
        ok, to = np.zeros(len(node), bool), node - 1
        want = (node[inner] << BITS) | c[inner]
        k = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        if len(self.keys):
            ok[inner] = self.keys[k] == want
            to[inner] = self.child[k]
        outer = np.flatnonzero(node < 0)
        ok[outer] = self.tail[~node[outer]] == c[outer]
        return ok, to[ok]

    def accepted(self, node: np.ndarray) -> np.ndarray:
        """The word that ends at each node, or -1."""
        out = np.full(len(node), -1, np.int64)
        inner = node >= 0
        out[inner] = self.word[node[inner]]
        sign = self.tail[~node[~inner]] - END
        out[~inner] = np.where(sign >= 0, sign, -1)
        return out

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All children: which of `node` it is of, by what code point, and the child."""
        inner, outer = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        lo, count = self.first[node[inner]], self.first[node[inner] + 1] - self.first[node[inner]]
        edge = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        sign = self.tail[~node[outer]]
        goes = outer[sign < END]
        return np.concatenate([np.repeat(inner, count), goes]), np.concatenate([self.label[edge], sign[sign < END]]), np.concatenate([self.child[edge], node[goes] - 1]).astype(np.int64)

    def fits(self, node: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Whether some word may end `left` code points below each node."""
        k = np.maximum(node, 0)
        return (node < 0) | ((self.low[k] <= left) & (left <= self.high[k]))

    def near(self, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which word, number of the trie's word) of all pairs one edit apart."""
        size = np.diff(at)
        w, node, found = np.arange(len(size)), np.zeros(len(size), np.int64), []
        chars = np.append(chars, -1)  # a word's end reads the next word's first sign, which `depth < size` rules out
        depth = 0
        while len(w):
            inside = depth < size[w]
            sign, following = chars[at[w] + np.where(inside, depth, 0)], chars[at[w] + np.where(inside, depth + 1, 0)]
            of, c, to = self.children(node)
            other = ~inside[of] | (c != sign[of])
            replaced = np.flatnonzero(other & inside[of])
            added = np.flatnonzero(other)
            deleted = np.flatnonzero(inside & ((depth + 1 == size[w]) | (sign != following)))
            found.append(
                self._exact(
                    chars,
                    at,
                    np.concatenate([w[of[replaced]], w[of[added]], w[deleted]]),
                    np.concatenate([to[replaced], to[added], node[deleted]]),
                    np.concatenate([np.full(len(replaced), depth + 1), np.full(len(added), depth), np.full(len(deleted), depth + 1)]),
                )
            )
            at_, sign_ = np.flatnonzero(inside), sign[inside]
            ok, node = self.step(node[at_], sign_)
            w = w[at_[ok]]
            depth += 1
        pairs = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
        return pairs[0], pairs[1]

    def _exact(self, chars: np.ndarray, at: np.ndarray, w: np.ndarray, node: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks on without edits, to the words' ends."""
        out = []
        while len(w):
            left = at[w + 1] - at[w] - place
            ok = self.fits(node, left)
            w, node, place, left = w[ok], node[ok], place[ok], left[ok]
            done = left == 0
            word = self.accepted(node[done])
            out.append((w[done][word >= 0], word[word >= 0]))
            w, node, place = w[~done], node[~done], place[~done]
            ok, node = self.step(node, chars[at[w] + place])
            w, place = w[ok], place[ok] + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def shards(vocabulary: DataFrame) -> DataFrame:
    """shard, size, trie (pickled): the sorted vocabulary (word, n) in stretches of SHARD_CHARS code points."""
    length = F.char_length("word").cast("long")
    total = vocabulary.agg(F.sum(length)).first()[0] or 0
    parts = stored(vocabulary.repartitionByRange(max(1, -(-total // SHARD_CHARS)), "word").withColumn("part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in parts.groupBy("part").agg(F.sum(length).alias("chars")).orderBy("part").collect():  # a row a range
        offsets.append((r["part"], before))
        before += r["chars"]
    starts = vocabulary.sparkSession.createDataFrame(offsets, "part int, before long")
    inside = F.sum(length).over(Window.partitionBy("part").orderBy("word"))
    cut = parts.join(F.broadcast(starts), "part").select(F.floor((F.col("before") + inside - length) / SHARD_CHARS).alias("shard"), "word", "n")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("word").combine_chunks()
        t = Trie(table.column("word").chunk(0).cast(pa.string()), table.column("n").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([t.size()], pa.int64()), "trie": pa.array([pickle.dumps(t, 5)], pa.binary())})

    return cut.groupBy("shard").applyInArrow(build, "shard long, size long, trie binary")


def _groups(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    group, held = [], 0
    for shard, size in sizes:
        if group and held + size > BROADCAST_BYTES:
            yield group
            group, held = [], 0
        group.append(shard)
        held += size
    if group:
        yield group


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of all words that have a neighbour; form: the one of largest count, ties by code points. vocabulary: word, n, distinct, read more than once."""
    spark: SparkSession = vocabulary.sparkSession
    made = stored(shards(vocabulary), "tries")
    rows = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, -(-vocabulary.count() // TASK_WORDS)), "word").select("word")
    found = None
    for group in _groups([(r["shard"], r["size"]) for r in made.select("shard", "size").orderBy("shard").collect()]):
        sent = spark.sparkContext.broadcast([r["trie"] for r in made.where(F.col("shard").isin(group)).orderBy("shard").collect()])  # at most BROADCAST_BYTES, or one shard
        part = stored(rows.mapInArrow(_search(sent), "word string, n_near long, form string, form_n long"), "near")
        found = part if found is None else found.unionByName(part)
        sent.destroy()
    if found is None:
        found = spark.createDataFrame([], "word string, n_near long, form string, form_n long")
    best = F.min(F.struct(-F.col("form_n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.col1")).alias("form_n"))


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: list[Trie] | None = None
        for batch in small(batches, BLOCK):
            tries = tries or [pickle.loads(bytes(t)) for t in sent.value]
            words = batch.column("word").cast(pa.string())
            chars, at = code_points(words)
            for t in tries:
                w, other = t.near(chars, at)
                order = np.lexsort((other, -t.n[other], w))
                w, other = w[order], other[order]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
                count = np.diff(np.append(first, len(w)))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(w[first])), pa.array(count.astype(np.int64)), t.words.take(pa.array(other[first])), pa.array(t.n[other[first]].astype(np.int64))], ["word", "n_near", "form", "form_n"])

    return run


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: the last of word, form, form's form and so on; forms: word, form, one row a word. Counts rise from word to form, so there is no ring."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        new = stored(now.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, least: int = 7, seldom: int = 2, ratio: int = 10, delete_every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words with at least `least` code points and `seldom` occurrences."""
    require(docs, ("doc_id", "text"), "spelling variants")
    words = stored(word_counts(docs, least, delete_every).where(F.col("n") >= seldom), "vocabulary")
    near = words.join(neighbours(words), "word", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    judged = stored(near.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")), "judged")
    roots = rooted(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
