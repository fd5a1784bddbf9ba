"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so the packing is planned over counts:
lengths in descending order, and for each the open bins with the tightest
sufficient room, found by a segment tree over remaining capacities. The plan is
the one that placing piece after piece gives, but its size depends on the
capacity alone. Which piece takes which place follows from its rank among the
pieces of its length.

Null texts are empty; every document ends with the end token, so none has no
piece. Repeated rows are packed as often as they occur. Pieces of one length that
tie may swap places; the number of sequences is the same. An empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .common import batch_of, texts_of
from .vocabularies import byte_vocabulary, vocabulary_path

CAPACITY = 1_024
END_TOKEN = 2

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("rank", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long"


class CapacityTree:
    """Which remaining capacities have open bins; tightest(n) in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def put(self, room: int, has_bins: bool) -> None:
        at = self.size + room
        change = int(has_bins) - self.count[at]
        while change and at:
            self.count[at] += change
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that has open bins."""
        at = self.size + least
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first bin, pieces in each bin, offset), by length and rank.

    Ranks r, r+1, ... of a run fill its consecutive bins, so many pieces in each,
    from the offset on. Bins of equal room are taken in the order they got it.
    """
    tree, rooms = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    runs, bins = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = rooms[room].popleft()
                tree.put(room, bool(rooms[room]))
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                give(room - each * length, first, full)
            if full < n:
                if left:
                    runs.append((length, rank, first + full, each, capacity - room))
                    give(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                if full < n:  # untouched bins go back to the front
                    rooms[room].appendleft((first + full, n - full))
                    tree.put(room, True)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_token: int = END_TOKEN, json_path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """A row for each piece, with its block (a task) and its rank among the block's pieces of its length."""
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches):
        vocabulary, block, seen = byte_vocabulary(json_path, ranks_path, added), TaskContext.get().partitionId(), {}
        for batch in batches:
            out = {name: [] for name in PIECES.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.append(vocabulary.ids(text), end_token).astype("<u4")
                start = piece = 0
                while start < len(ids):
                    length = (len(ids) - start) % capacity or capacity  # only the first piece can be shorter
                    rank = seen[length] = seen.get(length, -1) + 1
                    row = (doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), block, rank)
                    for name, value in zip(PIECES.names, row, strict=True):
                        out[name].append(value)
                    start, piece = start + length, piece + 1
            yield batch_of(PIECES, **out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES_DDL)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to token_pieces()."""
    pieces = cut(pieces)
    by_block = cut(pieces.groupBy("block", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_block.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keys = runs[:, 0] * -1  # lengths descend
    schema = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank")) + np.asarray(batch.column("base"))
            # the last run of this length whose first rank is not above the piece's
            order = np.lexsort((rank, -length))
            lo, hi = np.searchsorted(keys, -length[order]), np.searchsorted(keys, -length[order], "right")
            at = np.empty(len(order), np.int64)
            for a, b in dict.fromkeys(zip(lo.tolist(), hi.tolist(), strict=True)):
                some = slice(*np.searchsorted(lo, (a, a + 1)))
                at[some] = a + np.searchsorted(runs[a:b, 1], rank[order][some], "right") - 1
            run = np.empty(len(order), np.int64)
            run[order] = at
            k = rank - runs[run, 1]
            each = runs[run, 3]
            yield batch_of(schema, **{c: batch.column(c) for c in PIECES.names[:5]}, sequence_id=pa.array(runs[run, 2] + k // each), offset=pa.array(runs[run, 4] + k % each * length))

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(bases, ["block", "length"]).select(*PIECES.names, "base").mapInArrow(place, ddl)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, capacity, **options), capacity)
