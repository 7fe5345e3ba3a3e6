"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that a merge-by-rank encoding of this
prefix ends with. The table of these last tokens, filled from left to right, holds the
encodings of all prefixes: appending bytes only adds entries, and after an edit only the
entries near it change.

A token may follow the last token of a shorter prefix if merging the two tokens' bytes alone
gives these two tokens again; this pairwise test is enough for whole encodings.

Null texts count as empty; an empty text has no tokens. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldloom.llm.common import require, small, text_or_empty

#: Distinct pieces in each of the two generations that a Python worker remembers.
REMEMBERED = 300_000


assert array("I").itemsize == 4 and sys.byteorder == "little"


class Vocabulary:
    """Byte tokens by rank, with the test whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.halves = {rank: self._halves(token, rank) for token, rank in ranks.items()}
        #: Tokens that their own bytes really encode to; any other can never end a prefix.
        self.reachable = {r for r, h in self.halves.items() if h is not None}
        self.merges = {h: r for r, h in self.halves.items() if h}
        self.enders = {token: rank for token, rank in ranks.items() if rank in self.reachable}
        self._fits: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def _halves(self, token: bytes, rank: int) -> tuple[int, ...] | None:
        """The two tokens that the last merge joins into this one; () for a single byte; None if merging doesn't reach it."""
        if len(token) == 1:
            return ()
        parts = merged(token, self.ranks, rank)
        return tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives exactly these two."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undoes the merges inside both tokens, latest first: they stay apart if never two neighbours
        across the border could have merged earlier than the merge undone last."""
        bound = len(self.tokens)
        inner = True
        while inner:
            joined = self.merges.get((left, right))
            # An equal rank merges from left to right, so it counts as earlier only on the left side.
            if joined is not None and joined < bound:
                return False
            inner = False
            first, second = (self.halves[left] if left > right or not self.halves[right] else ()), self.halves[right]
            if first and left >= right:
                bound, left, inner = left, first[1], True
            elif second:
                bound, right, inner = right + 1, second[0], True
            elif self.halves[left]:
                bound, left, inner = left, self.halves[left][1], True
        return True


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging by lowest rank, leftmost first; only ranks under `below`. The definition that the table must meet."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def fill(v: Vocabulary, piece: bytes, last: list[int], stop: int) -> None:
    """Adds to `last` the last tokens of the longer prefixes, up to `stop` bytes.

    Only one token can end a prefix, so the candidates may be tried in any order: first the one
    that begins where the token before begins, then all from the longest to the shortest."""
    get, known, longest, tokens = v.enders.get, v._fits.get, v.longest, v.tokens
    begin = len(last) - len(tokens[last[-1]]) if last else 0
    for end in range(len(last) + 1, stop + 1):
        token = get(piece[begin:end])
        if token is not None:
            if not begin:
                last.append(token)
                continue
            left = last[begin - 1]
            fits = known(left << 32 | token)
            if fits or fits is None and v.fits(left, token):
                last.append(token)
                continue
        for start in range(end - longest if end > longest else 0, end):
            token = get(piece[start:end])
            if token is not None:
                if not start:
                    break
                left = last[start - 1]
                fits = known(left << 32 | token)
                if fits or fits is None and v.fits(left, token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte of this text")
        begin = start
        last.append(token)


def path(v: Vocabulary, last: list[int]) -> list[int]:
    """The tokens of the whole, read from its end."""
    found, end, tokens = [], len(last), v.tokens
    while end:
        token = last[end - 1]
        found.append(token)
        end -= len(tokens[token])
    return found[::-1]


class PrefixTable:
    """The last token of every prefix of a piece; supports exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        fill(self.vocabulary, self.piece, self.last, len(self.piece))

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Puts `by` in place of piece[start:stop]; gives the number of entries computed anew.

        Behind the edit the old entries hold again once as many in a row as the longest token
        has bytes are unchanged, since an entry depends on no more than these."""
        old, shift = self.last, len(by) - (stop - start)
        self.piece = self.piece[:start] + by + self.piece[stop:]
        self.last = old[:start]
        same = done = 0
        for end in range(start + 1, len(self.piece) + 1):
            fill(self.vocabulary, self.piece, self.last, end)
            done += 1
            then = end - shift
            same = same + 1 if then > stop and old[then - 1] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[then:]
                break
        return done

    def ids(self) -> list[int]:
        return path(self.vocabulary, self.last)


class Encoder:
    """Encodes texts piece by piece and remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        last: list[int] = []
        fill(self.vocabulary, raw, last, len(raw))
        return array("I", path(self.vocabulary, last)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        if len(known) > REMEMBERED:
            # What was not used since the last time goes.
            self.older, self.known = known, {}
            known = self.known
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self.older.get(piece) or self.packed(piece)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.read(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns `keep`, ids array<long>: the whole text's tokens. Repeated rows give repeated rows."""
    return _mapped(df, path, pattern, text, keep, "ids array<long>", lambda e, ids: np.frombuffer(ids, "<u4").astype("i8").tolist())


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes every whole text: `keep`, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex)."""
    return _mapped(
        df, path, pattern, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda e, ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()),
    )


def _mapped(df: DataFrame, path: str, pattern: str, text: str, keep: tuple[str, ...], columns: str, of) -> DataFrame:
    require(df, (text, *keep), "byte-level BPE")
    chosen = df.select(*keep, text_or_empty(text).alias("__text"))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    several = "," in columns
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in small(batches):
            rows = [of(e, e.encode(t)) for t in batch.column("__text").to_pylist()]
            made = [pa.array(x) for x in zip(*rows, strict=True)] if several and rows else [pa.array(rows, pa.list_(pa.int64()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *names])

    return chosen.mapInArrow(run, f"{kept}, {columns}")
