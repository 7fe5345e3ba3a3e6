"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces of at most the largest length; a full-length piece is a bin of its
own. The other pieces are packed longest first. Each goes where it fits best: into the open bin
with the least room left. If it fits nowhere, a bin is opened: of all permitted lengths that hold
the piece, the one whose expected cost per token is least, where a bin's cost is its length plus a
fixed `overhead`, and the share of it that will be filled is estimated from the pieces still
to come (those no longer than the room that is left, in order of length). At the end each bin
becomes the shortest permitted length that holds its contents.

Pieces are dealt to shards by hash, each with about `shard_tokens` tokens, and each shard is packed
on its own: no bin crosses shards, so that shards are of one size whatever the input and no
task grows with it. A source or text with a third of all rows is spread like any other.

Null and empty texts have no tokens and yield no piece. Repeated rows, and rows with equal
doc_ids, each yield their own pieces. An empty table gives an empty result. Ties: among bins with
equal room the one opened first; among pieces of equal length the smaller doc_id.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import WORDS, require, stored, text_or_empty

LENGTHS = (512, 1024, 2048, 4096)


class Packer:
    """Packs lengths (longest first) into bins of the permitted lengths."""

    def __init__(self, lengths: tuple[int, ...], overhead: float):
        self.lengths, self.overhead = sorted(lengths), overhead

    def pack(self, sizes: list[int]) -> list[tuple[int, int, int]]:
        """sizes, in falling order: for each its bin, its offset in the bin and the bin's final length."""
        rooms: list[tuple[int, int]] = []  # (room, bin), sorted
        used: list[int] = []
        out: list[tuple[int, int]] = []
        rest = sorted(sizes)  # what is still to come, shortest first
        sums = [0]
        for s in rest:
            sums.append(sums[-1] + s)
        for k, size in enumerate(sizes):
            to_come = len(sizes) - k - 1
            at = bisect.bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, number = rooms.pop(at)
            else:
                number, room = len(used), self._opened(size, rest, sums, to_come)
                used.append(0)
            out.append((number, used[number]))
            used[number] += size
            if room - size:
                bisect.insort(rooms, (room - size, number))
        final = [self.lengths[bisect.bisect_left(self.lengths, u)] for u in used]
        return [(number, offset, final[number]) for number, offset in out]

    def _opened(self, size: int, rest: list[int], sums: list[int], to_come: int) -> int:
        """The permitted length of least expected cost for each token in the bin."""
        best = None
        for length in self.lengths[bisect.bisect_left(self.lengths, size) :]:
            room = length - size
            fitting = min(bisect.bisect_right(rest, room), to_come)
            # The fill is made of whole pieces: about half the mean piece stays empty, or all that no piece fits into.
            mean = sums[fitting] / fitting if fitting else 0
            fill = min(sums[fitting], max(room - mean / 2, 0)) if fitting else 0
            cost = (length + self.overhead) / (size + fill)
            if best is None or cost < best[0]:
                best = cost, length
        return best[1]


def pieces(docs: DataFrame, longest: int, tokens: str = "n_tokens") -> DataFrame:
    """doc_id, piece (number in its document), start, size: each document cut at multiples of `longest`."""
    whole = docs.where(F.col(tokens) > 0)
    cut = F.explode(F.sequence(F.lit(0), ((F.col(tokens) - 1) / longest).cast("int"))).alias("piece")
    found = whole.select("doc_id", F.col(tokens).cast("long").alias("n"), cut)
    start = F.col("piece").cast("long") * longest
    return found.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("n") - start).cast("long").alias("size"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = 16.0, shard_tokens: int = 1_000_000, tokens: str | None = None) -> DataFrame:
    """Per piece doc_id, piece, start, size, bin (unique), offset in the bin, bin_length, bin_used.

    Sizes count whitespace-separated words, or come from the column `tokens`."""
    require(docs, ("doc_id", tokens or "text"), "packing")
    longest = max(lengths)
    counted = F.col(tokens) if tokens else F.regexp_count(text_or_empty(), F.lit(WORDS))
    cut = stored(pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), counted.alias("n_tokens")), longest), "pieces")
    total = cut.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    packer = Packer(lengths, overhead)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = packer.pack(group["size"].tolist())
        group["bin"] = [int(key[0]) * (1 << 32) + b for b, _, _ in placed]
        group["offset"] = [o for _, o, _ in placed]
        group["bin_length"] = [n for _, _, n in placed]
        group["bin_used"] = group.groupby("bin")["size"].transform("sum")
        return group[["doc_id", "piece", "start", "size", "bin", "offset", "bin_length", "bin_used"]]

    # Equal rows must not meet in one shard: a row's own number spreads them.
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    return cut.select("*", shard).groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, size long, bin long, offset long, bin_length int, bin_used long")
