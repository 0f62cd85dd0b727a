"""BigWig files: a header, a tree of chromosomes, compressed sections of values and an R-tree over them.

Reading lists the sections of each file from its index, deals them to tasks and decodes each by one range read. Writing
streams sorted runs to one file per track, in sections of bounded size. Files are little-endian and have no zoom levels.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the format (fixed values): file, chromosome tree, section index.
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
#: Kinds of section (fixed values).
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3
_HEADER = struct.Struct("<IHHQQQHHQQIQ")
_TREE = struct.Struct("<IIIIQQ")
_INDEX = struct.Struct("<IIQIIIIQII")
_SECTION = struct.Struct("<IIIIIBBH")
_LEAF = struct.Struct("<IIIIQQ")
_INNER = struct.Struct("<IIIIQ")
_SUMMARY = struct.Struct("<Qdddd")
#: Values of a section, entries of a tree node.
SECTION_VALUES, NODE = 1024, 256

ReadAt = Callable[[int, int], bytes]


def _tree_leaves(read_at: ReadAt, at: int, key_size: int) -> Iterator[tuple[bytes, int, int]]:
    leaf, _, count = struct.unpack("<BBH", read_at(at, 4))
    raw = read_at(at + 4, count * (key_size + 8))
    for i in range(count):
        entry = raw[i * (key_size + 8) : (i + 1) * (key_size + 8)]
        if leaf:
            yield entry[:key_size].rstrip(b"\0"), *struct.unpack("<II", entry[key_size:])
        else:
            yield from _tree_leaves(read_at, struct.unpack("<Q", entry[key_size:])[0], key_size)


def _index_leaves(read_at: ReadAt, at: int) -> Iterator[tuple[int, int, int]]:
    leaf, _, count = struct.unpack("<BBH", read_at(at, 4))
    form = _LEAF if leaf else _INNER
    for entry in form.iter_unpack(read_at(at + 4, count * form.size)):
        if leaf:
            yield entry[0], entry[4], entry[5]
        else:
            yield from _index_leaves(read_at, entry[4])


def sections(read_at: ReadAt) -> Iterator[tuple[str, int, int, bool]]:
    """(chromosome, offset, size, compressed) of each section of a file."""
    head = _HEADER.unpack(read_at(0, _HEADER.size))
    if head[0] != MAGIC:
        raise ValueError("not a little-endian BigWig file")
    tree = _TREE.unpack(read_at(head[3], _TREE.size))
    if tree[0] != TREE_MAGIC or _INDEX.unpack(read_at(head[5], _INDEX.size))[0] != INDEX_MAGIC:
        raise ValueError("a damaged BigWig file")
    names = {number: key.decode() for key, number, _ in _tree_leaves(read_at, head[3] + _TREE.size, tree[2])}
    for number, offset, size in _index_leaves(read_at, head[5] + _INDEX.size):
        yield names[number], offset, size, head[10] > 0


def chromosomes(read_at: ReadAt) -> dict[str, int]:
    """Names and lengths of a file's chromosomes."""
    at = _HEADER.unpack(read_at(0, _HEADER.size))[3]
    return {key.decode(): size for key, _, size in _tree_leaves(read_at, at + _TREE.size, _TREE.unpack(read_at(at, _TREE.size))[2])}


def decode_section(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and values of an uncompressed section."""
    _, start, _, step, span, kind, _, count = _SECTION.unpack_from(raw)
    body = raw[_SECTION.size :]
    if kind == BEDGRAPH:
        items = np.frombuffer(body, [("s", "<u4"), ("e", "<u4"), ("v", "<f4")], count)
        return items["s"].astype(np.int64), items["e"].astype(np.int64), items["v"]
    if kind == VARIABLE:
        items = np.frombuffer(body, [("s", "<u4"), ("v", "<f4")], count)
        return items["s"].astype(np.int64), items["s"].astype(np.int64) + span, items["v"]
    if kind == FIXED:
        starts = start + step * np.arange(count, dtype=np.int64)
        return starts, starts + span, np.frombuffer(body, "<f4", count)
    raise ValueError(f"unknown kind of section {kind}")


def _opened(path: str):
    fs, name = pa.fs.FileSystem.from_uri(path)
    source = fs.open_input_file(name)

    def read_at(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return source, read_at


def read_bigwig(spark: SparkSession, paths: list[str], chroms: list[str] | None = None) -> DataFrame:
    """Signal tracks (track_index in the order of ``paths``, chrom, start, end, value); NaN counts as 0. Only sections of ``chroms`` are read."""
    listed = spark.createDataFrame(list(enumerate(paths)), "track_index int, path string")
    wanted = None if chroms is None else frozenset(chroms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, read_at = _opened(path)
                with source:
                    found = [(track, path, *s) for s in sections(read_at) if wanted is None or s[0] in wanted]
                if found:
                    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["track_index", "path", "chrom", "offset", "size", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, read_at = None, None, None
        for batch in batches:
            for track, path, chrom, offset, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    if source is not None:
                        source.close()
                    now, (source, read_at) = path, _opened(path)
                raw = read_at(offset, size)
                starts, ends, values = decode_section(zlib.decompress(raw) if packed else raw)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, track, np.int32)), pa.array([chrom] * n, pa.string()), pa.array(starts), pa.array(ends), pa.array(np.nan_to_num(values, nan=0.0))], names=["track_index", "chrom", "start", "end", "value"])
        if source is not None:
            source.close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = listed.repartition(min(len(paths), parts) or 1).mapInArrow(find, "track_index int, path string, chrom string, offset bigint, size bigint, packed boolean")
    spread = blocks.repartition(parts, "path", F.shiftright("offset", 22)).sortWithinPartitions("path", "offset")
    return spread.mapInArrow(read, "track_index int, chrom string, start bigint, end bigint, value float")


class BigWigWriter:
    """Streams sections of sorted values to ``sink`` and keeps one entry for each; a file is ``head()``, these sections and ``tail()``.

    ``sizes`` are all chromosomes in the order they come.
    """

    def __init__(self, sink, sizes: dict[str, int]):
        self.sink, self.sizes, self.numbers = sink, sizes, {c: i for i, c in enumerate(sizes)}
        self.at = 0
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.total = [0, float("inf"), float("-inf"), 0.0, 0.0]
        self.largest = 0
        key_size = max([len(c.encode()) for c in sizes] or [1])
        tree = self._chromosome_tree(key_size, _HEADER.size + _SUMMARY.size)
        self.head_size = _HEADER.size + _SUMMARY.size + len(tree)
        self.tree, self.at = tree, self.head_size + 8

    def _chromosome_tree(self, key_size: int, at: int) -> bytes:
        """All levels of the tree, the root first; a node has at most ``NODE`` entries."""
        leaves = [(c.encode().ljust(key_size, b"\0"), struct.pack("<II", self.numbers[c], size)) for c, size in sorted(self.sizes.items(), key=lambda x: x[0].encode())]
        head = _TREE.pack(TREE_MAGIC, NODE, key_size, 8, len(leaves), 0)
        levels = [[leaves[i : i + NODE] for i in range(0, len(leaves), NODE)] or [[]]]
        while len(levels[0]) > 1:
            above = [(node[0][0], None) for node in levels[0]]
            levels.insert(0, [above[i : i + NODE] for i in range(0, len(above), NODE)])
        node_bytes = 4 + NODE * (key_size + 8)
        out, first = [], at + len(head)
        for depth, level in enumerate(levels):
            below, child = first + node_bytes * len(level), 0
            for node in level:
                raw = struct.pack("<BBH", depth == len(levels) - 1, 0, len(node))
                for key, value in node:
                    if value is None:
                        value, child = struct.pack("<Q", below + node_bytes * child), child + 1
                    raw += key + value
                out.append(raw.ljust(node_bytes, b"\0"))
            first = below
        return head + b"".join(out)

    def add(self, chrom: str, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, step: int | None = None) -> None:
        """Up to ``SECTION_VALUES`` sorted values of one chromosome; with ``step`` they follow each other at that distance."""
        number = self.numbers[chrom]
        if step is not None:
            body, kind, span = values.astype("<f4").tobytes(), FIXED, step
        else:
            items = np.empty(len(starts), [("s", "<u4"), ("e", "<u4"), ("v", "<f4")])
            items["s"], items["e"], items["v"] = starts, ends, values
            body, kind, span = items.tobytes(), BEDGRAPH, 0
        raw = _SECTION.pack(number, int(starts[0]), int(ends[-1]), step or 0, span, kind, 0, len(starts)) + body
        packed = zlib.compress(raw)
        self.entries.append((number, int(starts[0]), int(ends[-1]), self.at, len(packed)))
        self.sink.write(packed)
        self.at += len(packed)
        self.largest = max(self.largest, len(raw))
        width, finite = (ends - starts).astype(np.float64), np.nan_to_num(values.astype(np.float64), nan=0.0)
        self.total[0] += int(width.sum())
        self.total[1], self.total[2] = min(self.total[1], float(finite.min())), max(self.total[2], float(finite.max()))
        self.total[3] += float((finite * width).sum())
        self.total[4] += float((finite * finite * width).sum())

    def head(self) -> bytes:
        """What comes before the sections; where the index lies is known only after the last one."""
        low, high = (self.total[1], self.total[2]) if self.entries else (0.0, 0.0)
        header = _HEADER.pack(MAGIC, 4, 0, _HEADER.size + _SUMMARY.size, self.head_size, self.at, 0, 0, 0, _HEADER.size, max(self.largest, 1), 0)
        return header + _SUMMARY.pack(self.total[0], low, high, self.total[3], self.total[4]) + self.tree + struct.pack("<Q", len(self.entries))

    def tail(self) -> bytes:
        return self._index(self.at) + struct.pack("<I", MAGIC)

    def _index(self, at: int) -> bytes:
        """The R-tree, the root first."""
        first = (self.entries[0][0], self.entries[0][1]) if self.entries else (0, 0)
        last = (self.entries[-1][0], self.entries[-1][2]) if self.entries else (0, 0)
        head = _INDEX.pack(INDEX_MAGIC, NODE, len(self.entries), *first, *last, at, 1, 0)
        leaves = [(n, s, n, e, offset, size) for n, s, e, offset, size in self.entries]
        levels = [[leaves[i : i + NODE] for i in range(0, len(leaves), NODE)] or [[]]]
        while len(levels[0]) > 1:
            above = [(node[0][0], node[0][1], max(x[2:4] for x in node)[0], max(x[2:4] for x in node)[1]) for node in levels[0]]
            levels.insert(0, [above[i : i + NODE] for i in range(0, len(above), NODE)])
        out, start = [], at + len(head)
        for depth, level in enumerate(levels):
            is_leaf = depth == len(levels) - 1
            node_bytes = 4 + NODE * (_LEAF if is_leaf else _INNER).size
            below_bytes = 4 + NODE * (_LEAF if depth + 1 == len(levels) - 1 else _INNER).size
            below, child = start + node_bytes * len(level), 0
            for node in level:
                raw = struct.pack("<BBH", is_leaf, 0, len(node))
                for entry in node:
                    if is_leaf:
                        raw += _LEAF.pack(*entry)
                    else:
                        raw, child = raw + _INNER.pack(*entry, below + below_bytes * child), child + 1
                out.append(raw.ljust(node_bytes, b"\0"))
            start = below
        return head + b"".join(out)


def write_bigwig(signal: DataFrame, sizes: dict[str, int], folder: str, resolution: int | None = None) -> DataFrame:
    """One file per track from (track, chrom, start, end, value); returns track and path, as a written manifest should hold.

    With ``resolution`` rows are (track, chrom, bin, value), and runs of neighbouring bins become fixed-step sections. Ranges
    of one track must not overlap; chromosomes that ``sizes`` lacks fail. A track is one file, so one task writes it; it
    holds an entry per section, while the sections wait in a file beside it. A file's name is new in every attempt.
    """
    order = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: c.encode()))}
    rank = F.coalesce(*(F.when(F.col("chrom") == c, i) for c, i in order.items()), F.raise_error(F.concat(F.lit("no size of chromosome "), F.col("chrom"))).cast("int"))
    if resolution is not None:
        signal = signal.withColumns({"start": F.col("bin") * resolution, "end": F.col("bin") * resolution + resolution})
    rows = signal.select(F.col("track").cast("bigint"), rank.alias("rank"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.col("value").cast("float"))
    names = list(order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        now, writer, path, sink = None, None, None, None
        out: list[tuple[int, str]] = []

        def close() -> None:
            if writer is None:
                return
            sink.close()
            with fs.open_output_stream(path, compression=None) as whole, fs.open_input_stream(f"{path}.data", compression=None) as data:
                whole.write(writer.head())
                while part := data.read(1 << 20):
                    whole.write(part)
                whole.write(writer.tail())
            fs.delete_file(f"{path}.data")
            out.append((now, path))

        for batch in batches:
            track, chrom, start, end, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = (track[1:] != track[:-1]) | (chrom[1:] != chrom[:-1])
            if resolution is not None:
                cuts |= start[1:] != end[:-1]
            edges = np.concatenate([[0], np.flatnonzero(cuts) + 1, [len(track)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if int(track[a]) != now:
                    close()
                    now, path = int(track[a]), f"{base}/track-{int(track[a])}-{uuid.uuid4().hex}.bw"
                    sink = fs.open_output_stream(f"{path}.data", compression=None)
                    writer = BigWigWriter(sink, {c: sizes[c] for c in names})
                for i in range(a, b, SECTION_VALUES):
                    j = min(b, i + SECTION_VALUES)
                    writer.add(names[int(chrom[a])], start[i:j], end[i:j], value[i:j], resolution)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([f"{folder.rstrip('/')}/{p.rsplit('/', 1)[1]}" for _, p in out], pa.string())], names=["track", "path"])

    parts = max(1, int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "track").sortWithinPartitions("track", "rank", "start").mapInArrow(write, "track bigint, path string")
