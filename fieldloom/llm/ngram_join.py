"""N-gram Jaccard join: the sparse product of the document by n-gram incidence matrix, in blocks.

A document's row is the set of its distinct word n-grams, as 64-bit hashes. Entry (a, b) of the
matrix times its transpose is the overlap of a and b. Only entries that can reach the threshold
are wanted, and the sizes of both sets bound them:

- Overlap must reach t times the larger set. So with the columns in any fixed order, two documents
  that link share a column among the first n - ceil(t n) + 1 of each. Only these columns are
  multiplied. Rare columns come first, by a count sketch of fixed size over all documents, so that
  common passages hardly ever meet.
- The first shared column at positions i and j leaves an overlap of at most min(n_a - i, n_b - j),
  and the sizes must be within t of each other. Pairs below that are discarded.

Equal sets are one row. A block is one column's documents. In a first round each block pairs its
documents with a few of them, as far as possible the same in every block; linked documents join
components. In a second round a block with several components pairs the documents outside its
main component, the one with most documents, with some of that one. In a last round a block yields
all pairs of different components that are left, so a large family of near copies is not
multiplied out.

The pairs found are the places at which the product is wanted. It is summed there over all columns, in
BLOCKS blocks: rows of both documents meet block by block, the overlap is added up, and a pair is dropped as
soon as its overlap and all that its smaller rest could add stay below what the two sizes ask for. The
components are those of all links.

Null and empty texts have no set and link with nothing. A text shorter than an n-gram is one n-gram
by itself. Rows without doc_id get no component. Rows that repeat a doc_id share a component if
their texts link. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import Membership, hot_join, require, stored, text_or_empty, words_of
from fieldloom.llm.components import components

#: Counters of the sketch, whatever the input.
SKETCH, BLOCK = 1 << 22, 1 << 16
#: Blocks of columns that the product is summed over; documents of an n-gram that meet in one task at most, about.
BLOCKS, DEALT = 2, 512
#: Documents that a block's others are paired with; rounds that pair with a block's main component, and with
#: how many of its documents; bits of a signature; documents from which on, about, a block is dealt into parts. Only speed depends on these.
PIVOTS, ROUNDS, SLOTS, SIGN_BITS, PART = 5, 1, 32, 2048, 100_000
_HASH = xxhash.xxh3_64_intdigest
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def ngrams(text: str, width: int) -> np.ndarray:
    """The distinct n-grams as sorted hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([_HASH(b"\n".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_HASH, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = h[:n]
    for k in range(1, width):
        s = s * _M1
        s ^= s >> np.uint64(29)
        s = s + h[k : k + n]
    s = s * _M2
    s ^= s >> np.uint64(32)
    return np.unique(s)


def slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(42)).astype(np.int64)  # the upper 22 bits


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds few sets at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def surveyed(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds, in one pass: doc_id, n, set_key of each document; block, part, counts of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int32)
        names, part = ["doc_id", "n", "set_key", "block", "part", "counts"], TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        for batch in small(batches):
            sets = [ngrams(t, width) for t in batch.column("text").to_pylist()]
            if sets:
                sketch += np.bincount(slot(np.concatenate(sets)), minlength=SKETCH).astype(np.int32)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            nothing = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *(nothing.cast(k) for k in kinds[3:])], names)
        for b in range(0, SKETCH, BLOCK):
            counts = sketch[b : b + BLOCK]
            if counts.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1).cast(k) for k in kinds[:3]), pa.array([b // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, block int, part int, counts binary")


def summed(sketches: DataFrame, fan: int = 64) -> np.ndarray:
    """The sketch of all tasks. Sums at most `fan` of them at a time, in as many rounds as it takes."""
    parts = (sketches.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // fan)

        def add(key: tuple, group: pa.Table) -> pa.Table:
            total = np.zeros(BLOCK, np.int32)
            for c in group.column("counts"):
                total += np.frombuffer(c.as_py(), np.int32)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

        sketches = stored(sketches.select("block", F.pmod("part", F.lit(parts)).alias("part"), "counts").groupBy("block", "part").applyInArrow(add, "block int, part int, counts binary"), "sketch")
    out = np.zeros(SKETCH, np.int32)
    for r in sketches.select("block", "counts").collect():  # SKETCH numbers in all
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int32)
    return out


def first_columns(docs: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, set_key, sign (see signature), grams: of each set the rarest n-grams, as many as a partner must share one of, in order.

    parts: into how many parts an n-gram's documents are dealt, by its count; mostly one."""
    broadcast, most = docs.sparkSession.sparkContext.broadcast(sketch), PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = broadcast.value
        for batch in small(batches):
            out, parts, keys, sizes, signs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = ngrams(text, width)
                n = len(s)
                order = np.lexsort((s, counts[slot(s)]))[: n + percent * n // -100 + 1] if n else []
                out.append(s[order].astype(np.int64) if n else s.astype(np.int64))
                parts.append(counts[slot(s[order])] // most + 1 if n else np.zeros(0, np.int32))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                sizes.append(n)
                signs.append(signature(s))
            ends = np.cumsum([0, *map(len, out)])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((out, pa.int64()), (parts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), *lists], ["doc_id", "n", "set_key", "sign", "grams", "parts"])

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, sign binary, grams array<long>, parts array<int>")


def column_blocks(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, grams_0, grams_1 ... : the rows of the incidence matrix for the documents in `nodes`, each packed and cut into BLOCKS blocks of columns; some others too, where the filter lets them pass."""
    wanted = Membership(nodes.select(F.xxhash64("node").alias("at")).distinct(), "at")
    names = ["node", *(f"grams_{k}" for k in range(BLOCKS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            chosen = batch.filter(pa.array(wanted.of(batch.column("at").to_numpy())))
            sets = [cut_by_block(ngrams(t, width)) for t in chosen.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chosen.column("node"), *(pa.array([s[k].tobytes() for s in sets], pa.binary()) for k in range(BLOCKS))], names)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text", F.xxhash64("doc_id").alias("at"))
    return rows.mapInArrow(run, "node long, " + ", ".join(f"{n} binary" for n in names[1:]))


def cut_by_block(s: np.ndarray) -> list[np.ndarray]:
    """A sorted set in BLOCKS blocks: the columns are cut at even places of the range of hashes."""
    return np.split(s, np.searchsorted(s, [np.uint64(k * ((1 << 64) // BLOCKS)) for k in range(1, BLOCKS)]))


def signature(s: np.ndarray) -> bytes:
    """SIGN_BITS parities: each n-gram turns one bit. Two sets differ in at least as many n-grams as their signatures in bits."""
    odd = np.bincount((s & np.uint64(SIGN_BITS - 1)).astype(np.int64), minlength=SIGN_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def linked(pairs: DataFrame, signs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs a, b those whose overlap reaches the threshold: entries of the product of the incidence matrix with its transpose, at these places only.

    Sizes and signatures (node, n, sign) rule most others out; only for the rest are rows of the matrix made from the texts, and moved."""
    of = lambda x, *c: signs.select(F.col("node").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in c))
    near = pairs.join(of("a", "n", "sign"), "a").join(of("b", "n", "sign"), "b")
    near = near.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "n_a", "n_b", "sign_a", "sign_b")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sign_a", "sign_b"))
                both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                apart = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
                yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * both))

    close = stored(near.mapInArrow(possible, "a long, b long, n_a long, n_b long"), "close")
    matrix = stored(column_blocks(docs, close.select(F.explode(F.array("a", "b")).alias("node")), width), "blocks")
    # The product, block by block: overlap holds the columns so far, left_a and left_b what each set has in the blocks to come.
    product = close.select("a", "b", "n_a", "n_b", F.lit(0).cast("long").alias("overlap"), F.col("n_a").alias("left_a"), F.col("n_b").alias("left_b"))
    for k in range(BLOCKS):
        side = lambda x, k=k: matrix.select(F.col("node").alias(x), F.col(f"grams_{k}").alias(f"grams_{x}"))
        product = stored(product.join(side("a"), "a").join(side("b"), "b").mapInArrow(_accumulated(percent), product.schema), "product")
    return product.select("a", "b")


def _accumulated(percent: int):
    """Adds a block's overlap to each pair's; pairs that cannot reach the threshold with all that is left are dropped. After the last block, what remains are the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            both, size_a, size_b = [], [], []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                size_a.append(len(x))
                size_b.append(len(y))
            n = lambda c: batch.column(c).to_numpy()
            overlap = n("overlap") + np.array(both, np.int64)
            left_a, left_b = n("left_a") - np.array(size_a, np.int64), n("left_b") - np.array(size_b, np.int64)
            most = overlap + np.minimum(left_a, left_b)
            made = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(overlap), pa.array(left_a), pa.array(left_b)], ["a", "b", "n_a", "n_b", "overlap", "left_a", "left_b"])
            yield made.filter(pa.array(100 * most >= percent * (n("n_a") + n("n_b") - most)))

    return run


def _of_main(left: DataFrame, number: int) -> DataFrame:
    """Of each block up to SLOTS documents of its main component, others in every round: gram, node_y, component_y, n_y, pos_y."""
    slot_of = F.pmod(F.xxhash64("node", "gram", F.lit(number)), F.lit(SLOTS))
    size_pos = F.min_by(F.col("n") * (1 << 31) + F.col("pos"), "node")
    chosen = left.where("component = main").groupBy("gram", "main", "parts", slot_of.alias("slot")).agg(F.min("node").alias("node_y"), size_pos.alias("size_pos"))
    return chosen.select("gram", "parts", "node_y", F.col("main").alias("component_y"), F.shiftright("size_pos", 31).alias("n_y"), (F.col("size_pos") % (1 << 31)).alias("pos_y"))


def join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row doc_id, n_shingles, component_id: the smallest doc_id reachable by links with 100 * overlap >= percent * union."""
    require(docs, ("doc_id", "text"), "the n-gram join")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    survey = stored(surveyed(texts, width), "survey")
    rows = survey.where("block IS NULL").select("doc_id", "n", "set_key")
    sketch = summed(survey.where("block IS NOT NULL").select("block", "part", "counts"))

    classes = stored(rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    chosen = first_columns(texts, width, percent, sketch).where("set_key IS NOT NULL")
    columns = stored(chosen.join(classes.hint("shuffle_hash"), (F.col("doc_id") == F.col("node")) & (chosen["set_key"] == classes["set_key"]), "left_semi").select(F.col("doc_id").alias("node"), "n", "sign", "grams", "parts"), "columns")

    # A block is an n-gram's documents. An n-gram with very many is dealt into parts, other ones for each n-gram, so that parts meet elsewhere.
    entries = columns.select("node", "n", F.posexplode(F.arrays_zip("grams", "parts")).alias("pos", "g")).select("node", "n", "pos", F.col("g.grams").alias("gram"), F.col("g.parts").alias("parts"))
    entries = entries.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "gram"), "parts").cast("int")).otherwise(-1))
    entries = entries.select("gram", "part", "node", (F.col("n") * (1 << 31) + F.col("pos")).alias("size_pos")).repartition("gram", "part")
    block = Window.partitionBy("gram", "part")
    # Some documents of each block, recovered from the smallest values of id xor a number. The numbers are the same in
    # every block, so that blocks with nearly the same documents, as a family of near copies makes, mostly agree on theirs.
    masks = [F.xxhash64(F.lit(k)) for k in range(PIVOTS)]
    least = [F.min(F.col("node").bitwiseXOR(m)).over(block).bitwiseXOR(m) for m in masks]
    met = entries.select("gram", "node", F.shiftright("size_pos", 31).alias("n"), (F.col("size_pos") % (1 << 31)).alias("pos"), "part", F.count(F.lit(1)).over(block).alias("members"), F.array(*least).alias("pivots"))
    shared = stored(met.where("members > 1 OR part >= 0").select("gram", "node", "n", "pos", F.when(F.col("members") > 1, F.when(F.col("members") == 2, F.array(F.col("pivots")[0])).otherwise(F.array_distinct("pivots"))).alias("pivots")), "shared")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = stored(shared.select("node", F.explode("pivots").alias("pivot")).where("node <> pivot").select(*ordered("node", "pivot")).distinct(), "pairs")
    signs = columns.select("node", "n", "sign")
    links = stored(linked(first, signs, texts, width, percent), "links")

    left, tried = shared.drop("pivots"), first
    for number in range(ROUNDS + 1):
        placed = stored(left.select("gram", "node", "n", "pos").join(components(links), "node", "left").select("gram", "node", "n", "pos", F.coalesce("component", "node").alias("component")), "placed")
        counted = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("members"))
        parts = F.ceil(F.sum("members") / DEALT).cast("int").alias("parts")
        mixed = stored(counted.groupBy("gram").agg(F.max_by("component", "members").alias("main"), F.count(F.lit(1)).alias("several"), parts).where("several > 1").select("gram", "main", "parts"), "mixed")
        left = stored(hot_join(placed, mixed, ["gram"], ["node"]), "left")
        # A block of more than DEALT documents is dealt into parts: x stays in its part, y goes to all, or, where both are many, each pair of parts is one key.
        part, every = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        last = number == ROUNDS
        side = lambda rows, x: rows.toDF("gram", *(c if c in ("one", "two") else f"{c}_{x}" for c in rows.columns[1:]))
        x_side = side(left.withColumn("one", part).withColumn("two", every if last else F.lit(0)), "x")
        y = side(left.withColumn("two", part).withColumn("one", every), "y") if last else _of_main(left, number).withColumn("one", every).withColumn("two", F.lit(0))
        other = "component_x <> component_y" if number < ROUNDS else "component_x > component_y"
        needed = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent) - 1e-9)
        possible = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= needed)
        met = x_side.join(y, ["gram", "one", "two"]).where(other).where(possible).select(*ordered("node_x", "node_y")).distinct()
        pairs = stored(met.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.union(stored(linked(pairs, signs, texts, width, percent), "links"))
        tried = tried.union(pairs)
    final = components(links)

    by_node = classes.join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = rows.join(by_node, "set_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that lead their component, and those in none, with all their columns. Rows with the leading doc_id all stay."""
    placed = join(docs, width, percent)
    stay = placed.where("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
