"""Token ids on disk in the fewest bits that hold the vocabulary, with block offsets for random access.

A file holds ids of many documents in order: a header, blocks of bit-packed ids, then tables of block offsets, document
ids and document starts. A group of eight ids fills ``width`` whole bytes, so packing and unpacking are a few numpy
steps over all groups of a block, and any range of ids needs only the blocks it touches.

Defined cases: null and empty texts have the end id alone; an empty table writes no documents; rows with equal ids, which
are ties of the order, stay neighbours, in the order of their texts; null ids come first; a text of any length goes over
as many blocks as it needs; only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices

MAGIC = b"SLTOKEN1"
_HEADER = struct.Struct("<8sIIQQQ")  # magic, width, ids per block, documents, ids, offset of the tables
BLOCK_IDS = 1 << 16
#: A file gets no further document beyond so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
#: Ids of a file that one task reads back, about.
SPLIT_IDS = 1 << 22


def width_of(vocabulary_size: int) -> int:
    """The fewest bits for ids below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Little-endian fixed-width packing, filled up to a multiple of eight ids."""
    groups = -(-len(ids) // 8)
    full = np.zeros(groups * 8, dtype=np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(groups, 8)
    out = np.zeros((groups, width), dtype=np.uint8)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        value = full[:, k] << np.uint64(shift)
        for b in range((width + shift + 7) // 8):
            out[:, at + b] |= (value >> np.uint64(8 * b)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack_bits`` made."""
    groups = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.empty((len(groups), 8), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        value = np.zeros(len(groups), dtype=np.uint64)
        for b in range((width + shift + 7) // 8):
            value |= groups[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


class TokenFileWriter:
    """Streams documents to ``sink``; it holds one block of ids and the tables."""

    def __init__(self, sink, width: int, block_ids: int = BLOCK_IDS):
        self.sink, self.width, self.block = sink, width, block_ids
        self.docs: list[int | None] = []
        self.starts = [0]
        self.offsets: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.at = _HEADER.size
        sink.write(b"\0" * _HEADER.size)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held - self.n_held % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        for a in range(0, n, self.block):
            packed = pack_bits(ids[a : min(a + self.block, n)], self.width)
            self.offsets.append(self.at)
            self.sink.write(packed)
            self.at += len(packed)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> bytes:
        """Writes the tables; returns the trailer, which repeats the header, as sinks may not seek."""
        self._flush(self.n_held)
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        self.sink.write(np.array(self.offsets, dtype="<i8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes() + known.tobytes())
        self.sink.write(np.array(self.starts, dtype="<i8").tobytes())
        trailer = _HEADER.pack(MAGIC, self.width, self.block, len(self.docs), self.starts[-1], self.at)
        self.sink.write(trailer)
        return trailer


class TokenFile:
    """Random access to a written file through ``read_at(offset, length)``."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        magic, self.width, self.block, self.n_docs, self.n_ids, tables = _HEADER.unpack(read_at(size - _HEADER.size, _HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        blocks = -(-self.n_ids // self.block)
        raw = read_at(tables, 8 * blocks + 9 * self.n_docs + 8 * (self.n_docs + 1))
        self.offsets = np.append(np.frombuffer(raw, "<i8", blocks), tables)
        self.docs = np.frombuffer(raw, "<i8", self.n_docs, 8 * blocks)
        self.known = np.frombuffer(raw, np.uint8, self.n_docs, 8 * (blocks + self.n_docs)).astype(bool)
        self.starts = np.frombuffer(raw, "<i8", self.n_docs + 1, 8 * blocks + 9 * self.n_docs)

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenFile:
        return cls(lambda at, n: data[at : at + n], len(data))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        raw = self.read_at(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(raw[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])], self.width, n))
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, vocabulary_size: int, end_id: int, partitions: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS
) -> DataFrame:
    """Encode, append ``end_id`` and write files in ascending order of ids: a range of ids to each task, bounded files to each range.

    Returns the manifest (part, number, path, n_docs, n_ids, bytes), one row per file. A file's name is new in every
    attempt, so a task that runs twice leaves files that no manifest row names.
    """
    width = width_of(vocabulary_size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import library_encoder

        encoder = library_encoder(vocabulary, "spaced")
        part, number = TaskContext.get().partitionId(), 0
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        sink = writer = path = None

        def close() -> pa.RecordBatch:
            writer.close()
            size = sink.tell()
            sink.close()
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]], "bytes": [size]})

        for batch in batches:
            for view in slices(batch):
                for doc, ids in zip(view.column(0).to_pylist(), encoder.encode(view.column(1)), strict=True):
                    if writer is None:
                        path = f"{base}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
                        sink = fs.open_output_stream(path, compression=None)
                        writer = TokenFileWriter(sink, width)
                    writer.add(doc, np.append(ids, np.uint32(end_id)))
                    if writer.starts[-1] >= file_ids or len(writer.docs) >= file_docs:
                        yield close()
                        number, writer = number + 1, None
        if writer is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part long, number long, path string, n_docs long, n_ids long, bytes long")


def read_token_files(manifest: DataFrame, folder: str, rows: int = 4096, split_ids: int = SPLIT_IDS) -> DataFrame:
    """One row per document of the files: doc_id, start over all files, n_tokens, ids_crc32.

    A task reads the documents that begin in one stretch of a file's ids. The sum over files runs over the manifest alone.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                with fs.open_input_file(entry["path"]) as source:

                    def read_at(at: int, n: int, source=source) -> bytes:
                        source.seek(at)
                        return source.read(n)

                    file = TokenFile(read_at, entry["bytes"])
                    border = np.array([entry["split"], entry["split"] + 1]) * split_ids
                    low, high = np.searchsorted(file.starts[:-1], border).tolist()
                    for a in range(low, high, rows):
                        b = min(a + rows, high)
                        starts = file.starts[a : b + 1]
                        crcs, upto = [], -1
                        for i in range(b - a):
                            if starts[i + 1] > upto:
                                first = int(starts[i])
                                upto = max(int(starts[i + 1]), min(first + 16 * file.block, int(starts[-1])))
                                ids = file.ids(first, upto).astype("<u4")
                            crcs.append(zlib.crc32(ids[int(starts[i]) - first : int(starts[i + 1]) - first].tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(file.docs[a:b], mask=~file.known[a:b]), pa.array(starts[:-1] + entry["base"]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    splits = placed.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / split_ids))))
    spread = splits.select("path", "bytes", "base", "split").repartition(max(1, placed.sparkSession.sparkContext.defaultParallelism * 4), "path", "split")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, vocabulary_size: int, end_id: int) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    folder = shared_dir(spark, "tokens")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = materialize(write_token_files(docs, folder, vocabulary, vocabulary_size, end_id, partitions), "manifest")
    return read_token_files(manifest, folder)


def to_bytes(documents: list[tuple[int, np.ndarray]], width: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A whole file in memory."""
    sink = io.BytesIO()
    writer = TokenFileWriter(sink, width, block_ids)
    for doc, ids in documents:
        writer.add(doc, ids)
    writer.close()
    return sink.getvalue()
