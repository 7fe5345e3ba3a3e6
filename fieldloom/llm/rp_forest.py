"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors again and again: each node has a random direction of its own and is cut at the
median of its members' projections; a vector that lies within the spill margin of a cut goes both
ways. Vectors are compared only within a leaf, and pairs with cosine >= threshold are links. A pair
that shares leaves of several trees counts once, in the first of them.

The trees grow in rounds of up to LEVELS levels. In a round, a bounded sample of each node that is still too large
(SAMPLE vectors or about) gives the directions and cuts below it; then every vector walks down all trees at once, in one pass
that moves no vector: it only notes its nodes. A table of 100,000 vectors takes one round, a thousand times as many two or three. A node
stops when it has about `leaf` vectors, or when its members are so near each other that every cut would
part links. The spill margin is a fixed part of the distance of a pair at the threshold, and the
deeper the trees, the more there are. Vectors are then moved once for each leaf they are in. Leaves of more than 2 `leaf`
vectors are compared in blocks of rows, each pair of blocks one task; leaves of several trees with the same members are compared once.

Vectors with equal components are one before all this; copies link with each other and share all
links. Null, empty, zero and non-finite vectors link with nothing; so do vectors of different
lengths with each other. Rows without vec_id are left out. Repeated rows are copies of each other.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hot_join, require, stored
from fieldloom.llm.components import components

#: Levels grown in a round, and the sample of a node that they are made from, about; below LEAST vectors of it nothing is cut. Place of the tree's number in a node's.
LEVELS, SAMPLE, LEAST, TREE = 7, 8192, 64, 40
#: Half of the spill zone, in distances of a pair at the threshold. On a direction, a pair at distance r differs by r times a normal variate.
SPILL = 0.4
#: A node whose mean squared distance from its centre is at most DENSE * (1 - threshold) is not split; at 1, its mean pair is at the threshold.
DENSE = 2.0
#: The share of the links at the threshold that a level parts in one tree, the share of a node's rows that a child has, and the share of links that may be lost.
PARTED, CHILD, LOST = 0.07, 0.6, 0.01


def depth(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log(max(n, 1) / leaf) / -np.log(CHILD))))


def trees_for(n: int, leaf: int, least: int) -> int:
    """So many trees that a link at the threshold survives in one of them, whatever the depth."""
    survives = (1 - PARTED) ** depth(n, leaf)
    return least if survives >= 1 else max(least, int(np.ceil(np.log(LOST) / np.log(1 - survives))))


def direction(seed: int, dim: int, node: int) -> np.ndarray:
    """The direction of a node, by its number: tree << TREE, plus its place in the tree, which has the root at 1 and children at 2 k and 2 k + 1."""
    return np.random.default_rng([seed, dim, node]).standard_normal(dim)


def child(node: np.ndarray | int, right: int) -> np.ndarray | int:
    tree = node >> TREE
    return (tree << TREE) + 2 * (node - (tree << TREE)) + right


def cuts_below(x: np.ndarray, node: int, members: float, leaf: int, half: float, dense: float, seed: int) -> list[tuple[int, float]]:
    """Nodes and cuts of the levels below a node. x: a sample of its `members` unit vectors."""
    out, now = [], [(node, np.arange(len(x)), members)]
    for _ in range(LEVELS):
        below = []
        for n, rows, size in now:
            middle = x[rows].mean(0)
            if size <= leaf or len(rows) < LEAST or 1 - middle @ middle <= dense:
                continue
            p = x[rows] @ direction(seed, x.shape[1], n)
            cut = float(np.median(p))
            parts = [rows[p <= cut + half], rows[p > cut - half]]
            if max(map(len, parts)) > 0.95 * len(rows):
                continue
            out.append((n, cut))
            below += [(child(n, k), part, size * len(part) / len(rows)) for k, part in enumerate(parts)]
        now = below
    return out


def walked(paths: DataFrame, cuts: DataFrame, half: float, seed: int) -> DataFrame:
    """Every vector's nodes after a round. cuts: dim, node, cut; about one for every `leaf` vectors."""
    known: dict[int, dict[int, float]] = {}
    for r in cuts.collect():
        known.setdefault(r["dim"], {})[r["node"]] = r["cut"]
    given = paths.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim, found in given.value.items():
            nodes = np.array(sorted(found), np.int64)
            trees[dim] = nodes, np.array([found[n] for n in nodes.tolist()]), np.stack([direction(seed, dim, n) for n in nodes.tolist()])
        for batch in batches:
            units, lists = batch.column("unit"), batch.column("nodes")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row, node = np.repeat(np.arange(batch.num_rows), np.diff(at)), lists.flatten().to_numpy()
            length = np.diff(units.offsets.to_numpy())
            done_row, done_node = [], []
            for dim in np.unique(length):
                mine = length[row] == dim
                r, n = row[mine], node[mine]
                if dim not in trees:
                    done_row.append(r)
                    done_node.append(n)
                    continue
                nodes, cut, d = trees[dim]
                which = np.flatnonzero(length == dim)
                x = np.stack([np.asarray(units[k].values) for k in which.tolist()])
                place = np.zeros(batch.num_rows, np.int64)
                place[which] = np.arange(len(which))
                while len(n):
                    k = np.minimum(np.searchsorted(nodes, n), len(nodes) - 1)
                    inner = nodes[k] == n
                    done_row.append(r[~inner])
                    done_node.append(n[~inner])
                    r, n, k = r[inner], n[inner], k[inner]
                    p = np.einsum("ij,ij->i", x[place[r]], d[k]) - cut[k]
                    r, n = np.concatenate([r[p <= half], r[p > -half]]), np.concatenate([child(n[p <= half], 0), child(n[p > -half], 1)])
            r, n = np.concatenate([*done_row, np.zeros(0, np.int64)]), np.concatenate([*done_node, np.zeros(0, np.int64)])
            order = np.lexsort((n, r))
            ends = np.searchsorted(r[order], np.arange(batch.num_rows + 1))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("unit"), made], ["rep", "copies", "unit", "nodes"])

    return paths.mapInArrow(run, paths.schema)


def grown(classes: DataFrame, trees: int, leaf: int, threshold: float, seed: int) -> DataFrame:
    """rep, copies, unit, nodes: every vector with the leaves it is in."""
    half, dense = SPILL * max(0.0, 2 - 2 * threshold) ** 0.5, DENSE * (1 - threshold)
    paths = classes.select("rep", "copies", "unit", F.array(*(F.lit((t << TREE) + 1).cast("long") for t in range(trees))).alias("nodes"))
    whole, limit = None, leaf

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        x = np.stack([np.asarray(v.values) for v in group.column("unit")])
        found = cuts_below(x, key[1].as_py(), group.column("members")[0].as_py(), leaf, half, dense, seed)
        return pa.table({"dim": pa.array([key[0].as_py()] * len(found), pa.int32()), "node": pa.array([n for n, _ in found], pa.int64()), "cut": pa.array([c for _, c in found], pa.float64())})

    while True:
        at = paths.select("rep", "unit", F.size("unit").alias("dim"), F.explode("nodes").alias("node"))
        large = at.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > limit)
        large = stored(large if whole is None else large.join(whole, ["dim", "node"], "left_anti"), "large")  # about one for every `leaf` vectors
        if large.isEmpty():
            return paths
        share = F.pmod(F.xxhash64("rep", "node"), F.lit(1 << 30)) < F.ceil(F.lit(float(SAMPLE << 30)) / F.col("members"))
        sample = at.join(large, ["dim", "node"]).where(share)
        cuts = stored(sample.groupBy("dim", "node").applyInArrow(fitted, "dim int, node long, cut double"), "cuts")
        uncut = large.select("dim", "node").join(cuts, ["dim", "node"], "left_anti")
        whole = uncut if whole is None else whole.unionByName(uncut)
        paths, limit = stored(walked(paths, cuts, half, seed), "paths"), 2 * leaf


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The smallest member of each vector's group, after the links `close` of vectors a and b are added: each round joins every group with another it links to."""
    while True:
        apart = close & (root[a][:, None] != root[b][None, :])
        rows = np.flatnonzero(apart.any(1))
        if not len(rows):
            return root
        lead = np.arange(len(root))
        pairs = np.unique(np.column_stack([root[a[rows]], root[b[apart[rows].argmax(1)]]]), axis=0)
        for p, q in pairs.tolist():
            while lead[p] != p:
                p = lead[p]
            while lead[q] != q:
                q = lead[q]
            lead[max(p, q)] = min(p, q)
        while (lead[lead] != lead).any():
            lead = lead[lead]
        root = lead[root]


def met_before(a: list[np.ndarray], b: list[np.ndarray], here: int, columns: int = 1024) -> np.ndarray:
    """Which pairs share a leaf with a smaller id than `here`. a, b: each vector's leaves."""
    sides = []
    for side in (a, b):
        ids, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(v) for v in side])
        sides.append((ids[ids < here], row[ids < here]))
    both = np.intersect1d(sides[0][0], sides[1][0])
    shared = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(both), columns):
        part, held = both[at : at + columns], []
        for (ids, row), n in zip(sides, (len(a), len(b)), strict=True):
            k = np.minimum(np.searchsorted(part, ids), len(part) - 1)
            fits = part[k] == ids
            held.append(np.zeros((n, len(part)), np.float32))
            held[-1][row[fits], k[fits]] = 1
        shared |= held[0] @ held[1].T > 0
    return shared


def compare(members: DataFrame, threshold: float) -> DataFrame:
    """Within each block pair of a leaf: per vector its links that no earlier leaf holds, weighted by copies, and a spanning forest of the links.

    Rows: rep, links (or null), up (or null: the vector it hangs on)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "rep"])
        rep, size = group["rep"].to_numpy(), group["copies"].to_numpy().astype(float)
        x = np.stack(group["unit"].to_list()).astype(float)
        leaves = [np.asarray(v) for v in group["leaves"]]
        side, here, same = group["side"].to_numpy(), key[0], group["same"].iloc[0]
        first, second = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, root = np.zeros(len(rep)), np.arange(len(rep))
        for start in range(0, len(first), 512):
            a = first[start : start + 512]
            close = x[a] @ x[second].T >= threshold
            if same:
                close &= a[:, None] < second[None, :]
            rows, columns = close.any(1), close.any(0)
            if not rows.any():
                continue
            a, b, close = a[rows], second[columns], close[np.ix_(rows, columns)]
            root = merged(root, a, b, close)
            close &= ~met_before([leaves[p] for p in a], [leaves[q] for q in b], here)
            links[a] += close @ size[b]
            links[b] += size[a] @ close
        hanging = np.flatnonzero(root != np.arange(len(rep)))
        return pd.DataFrame({"rep": [*rep, *rep[hanging]], "links": pd.array([*links.astype(np.int64), *[None] * len(hanging)], "Int64"), "up": pd.array([*[None] * len(rep), *rep[root[hanging]]], "Int64")})

    return members.groupBy("leaf_id", "one", "two").applyInPandas(run, "rep long, links long, up long")


def near_duplicates(df: DataFrame, threshold: float = 0.9, trees: int = 4, leaf: int = 2000, seed: int = 5) -> DataFrame:
    """Per vec_id: n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included), kept."""
    require(df, ("vec_id", "embedding"), "the projection forest")
    rows = df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.array_max(F.transform("v", F.abs))
    # Scaled by the largest component first, so that squares neither vanish nor overflow; -0 counts as 0. Equal vectors are told by a digest of their components.
    v = F.transform("v", lambda c: c + F.lit(0.0))
    rows = stored(rows.withColumn("top", F.when(fine, top)).withColumn("key", F.when(fine, F.sha2(F.concat_ws(",", F.transform(v, lambda c: c.cast("string"))), 256))), "vectors")
    scaled = F.transform("v", lambda c: c / F.col("top") + F.lit(0.0))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, c: t + c * c))
    one = rows.where("top > 0").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("v", "top")).alias("f")).select("key", "rep", "copies", "f.v", "f.top").withColumn("s", scaled)
    classes = stored(one.select("key", "rep", "copies", F.transform("s", lambda c: c / length).alias("unit")), "classes")
    n = classes.count()
    paths = grown(classes.drop("key"), trees_for(n, leaf, trees), leaf, threshold, seed)
    paths = stored(paths.withColumn("nodes", F.array_sort(F.transform("nodes", lambda k: F.xxhash64(F.size("unit"), k)))), "leaves")
    every = paths.select("rep", F.explode("nodes").alias("leaf_id"))
    whole = every.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("mix")).where("members > 1")
    sizes = stored(whole.groupBy("members", "sum", "mix").agg(F.min("leaf_id").alias("leaf_id")).select("leaf_id", F.ceil(F.col("members") / (2 * leaf)).cast("int").alias("blocks")), "sizes")
    # A leaf in k blocks gives k (k + 1) / 2 pairs of blocks; nearly every leaf has one. The leaves of a vector are a few for each tree.
    leaves = stored(hot_join(stored(every, "every"), sizes, ["leaf_id"], ["rep"]), "placed")
    of = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("leaf_id")).alias("leaves"))
    block = F.pmod(F.xxhash64("rep", "leaf_id"), F.col("blocks")).cast("int")
    placed = leaves.select("leaf_id", "rep", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = placed.select("leaf_id", "rep", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"))
    members = pairs.join(of, "rep").join(paths.select("rep", "copies", "unit"), "rep")
    found = stored(compare(members, threshold), "found")
    component = components(found.where("up IS NOT NULL").select(F.col("up").alias("a"), F.col("rep").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = hot_join(rows.select("vec_id", "key"), result, ["key"], ["vec_id"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))
