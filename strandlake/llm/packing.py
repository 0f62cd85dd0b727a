"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Documents longer than a window are cut into full windows first; what remains is packed by best fit decreasing. The
decision needs only how many pieces there are of each length, so the driver holds a histogram of at most ``window``
counts whatever the corpus size. A segment tree indexed by remaining capacity finds the tightest open window; runs of
equal pieces and runs of windows in equal state are placed together, which gives the same windows as placing pieces
one by one. Pieces then find their window by their rank among pieces of their length.

Defined cases: null or empty text is the end id alone; an empty table packs to an empty result; repeated rows are
packed each; a text of any length is cut into full windows and a remainder; pieces of equal length, ties of the decision,
are ranked by id and place, and equal rows are interchangeable; a null id is an id like others; only the id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

WINDOW = 2048
#: Pieces of one length that are ranked together, about; a length with more has more groups, so that none is one task.
RANK_ROWS = 1 << 10


class CapacityTree:
    """A segment tree over capacities 0..top that answers: the least capacity at or above a need that is in use."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(histogram: Mapping[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first window, pieces per window, offset in the window).

    Piece ``first rank + i`` goes to window ``first window + i // per`` at ``offset + (i % per) * length``.
    """
    tree, open_at, made, fresh = CapacityTree(window), {}, [], 0

    def keep(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_at.setdefault(capacity, []).append((first, n))
            tree.change(capacity, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, fresh, -(-left // (window // length))
                fresh += n
            else:
                first, n = open_at[capacity].pop()
                tree.change(capacity, -n)
            per = min(capacity // length, left)
            used = min(n, left // per)
            made.append((length, rank, used * per, first, per, window - capacity))
            keep(capacity - per * length, first, used)
            rank, left = rank + used * per, left - used * per
            if capacity < window:
                keep(capacity, first + used, n - used)
            elif used < n:  # the last new window gets what is left
                made.append((length, rank, left, first + used, left, 0))
                keep(window - left * length, first + used, 1)
                left = 0
    return made


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: full windows from the front of a document, then its remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import library_encoder

        encoder = library_encoder(vocabulary, "blank")
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``; ``cut`` is read more than once, so pass a written table."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    # One row per length, of which there are at most ``window``, so it can be sent to all executors.
    groups = spark.createDataFrame([(length, 1 + n // RANK_ROWS) for length, n in histogram.items()], "length long, groups long")
    counted = cut.join(F.broadcast(groups), "length").withColumn("grp", F.pmod(F.xxhash64("doc_id", "start"), "groups"))
    sizes = counted.groupBy("length", "grp").count()
    plan = np.array(sorted(best_fit_decreasing(histogram, window)), dtype=np.int64).reshape(-1, 6)
    before = sizes.select("length", "grp", (F.sum("count").over(Window.partitionBy("length").orderBy("grp")) - F.col("count")).alias("before"))
    own = Window.partitionBy("length", "grp").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = counted.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "grp"]).withColumn("rank", F.col("own") + F.col("before"))

    names = cut.columns

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(plan[:, 1].max(initial=0)) + 1
        keys = plan[:, 0] * step + plan[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
                row = plan[np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1]
                i = rank - row[:, 1]
                found = [pa.array(row[:, 3] + i // row[:, 4]), pa.array(row[:, 5] + i % row[:, 4] * length)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *found], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])
    return ranked.select(*names, "rank").mapInArrow(seat, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Tokenise, cut and pack ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    return place(materialize(pieces(docs, vocabulary, end_id, window), "pieces"), window)
