"""Exact encoding of whole texts by way of chunks that stand alone.

A text is cut only where its tokenizer always has a token border and looks at nothing beyond it, so each chunk can be
encoded by itself. Ids of chunks met before come from a table in numpy arrays, which compares the chunks' bytes; new
chunks go through the tokenizer. The table is bounded and starts afresh when full, so results never depend on what
it holds.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import words
from .common import utf8_rows

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The chunks that a worker's table holds at most, and their bytes.
MAX_CHUNKS, MAX_BYTES = 1 << 20, 1 << 25
#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20

_SPACE = 0x20
#: Bytes that surely begin a character which is not blank in any tokenizer's eyes.
_SOLID = np.ones(256, dtype=bool)
_SOLID[:0x21] = False
_SOLID[0x7F] = False
_SOLID[0x80:0xC0] = False
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def blank_cuts(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between ASCII blanks, for tokenizers that drop white space. ``borders`` are the texts' offsets."""
    inside = np.concatenate([~words._BLANK[data], [False]]) if len(data) else np.zeros(1, dtype=bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[borders] |= inside[borders]
    starts = np.flatnonzero(first)
    after = ~inside
    after[borders] = True
    stops = np.flatnonzero(after)
    return starts, stops[np.searchsorted(stops, starts, side="right")]


def _cover(cut: np.ndarray, size: int, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut[borders[borders < size]] = True
    starts = np.flatnonzero(cut)
    return starts, np.concatenate([starts[1:], [size]])[: len(starts)]


def spaced_cuts(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that begin at each space before a non-blank character.

    Byte-level patterns of the form ``" ?letters| ?digits| ?others|blanks(?!nonblank)|blanks`` have a border there:
    a run of blanks leaves its last space to what follows, and nothing before that space looks further.
    """
    cut = np.zeros(len(data), dtype=bool)
    cut[:-1] = (data[:-1] == _SPACE) & _SOLID[data[1:]]
    return _cover(cut, len(data), borders)


def piece_cuts(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that begin at a space after an ASCII character other than a space.

    Holds for vocabularies without pieces that have a space mark behind another character.
    """
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (data[1:] == _SPACE) & (data[:-1] != _SPACE) & ((data[:-1] < 0x80) | (data[:-1] != 0x81))
    return _cover(cut, len(data), borders)


class ChunkTable:
    """Ids of chunks. Those of up to ``words.LONGEST`` bytes are kept in a table that compares their bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], most: int = MAX_CHUNKS):
        self.encode, self.table = encode, words.SpanTable(most, MAX_BYTES)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.used = 0
        self.offset = np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)

    def add(self, chunks: list[bytes]) -> None:
        """Distinct chunks that the table has not."""
        ids = self.encode(chunks)
        n, need = self.table.n, self.table.n + len(chunks) + 1
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        if need > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros(max(need, len(self.offset)), dtype=np.int64)])
        if self.used + int(size.sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(int(size.sum()), len(self.ids)), dtype=np.uint32)])
        self.offset[n + 1 : need] = self.used + np.cumsum(size)
        self.ids[self.used : self.offset[need - 1]] = np.concatenate(ids)
        self.used = int(self.offset[need - 1])
        self.table.add(chunks)

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order, and where each chunk's begin (one more offset than chunks)."""
        entry = np.full(len(starts), -1, dtype=np.int32)
        short = np.flatnonzero(ends - starts <= words.LONGEST)
        entry[short] = self.table.find(data, starts[short], ends[short])
        lost = short[entry[short] < 0]
        raw = data.tobytes() if len(lost) or len(short) < len(starts) else b""

        def bytes_of(at: np.ndarray) -> list[bytes]:
            return [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        if len(lost):
            held = bytes_of(lost)
            new = list(dict.fromkeys(held))
            if self.table.full(len(new)):
                self.clear()
                lost, held = short, bytes_of(short)
                entry[:] = -1
                new = list(dict.fromkeys(held))
            if not self.table.full(len(new)):
                number = {chunk: k for k, chunk in enumerate(new, self.table.n)}
                self.add(new)
                entry[lost] = [number[chunk] for chunk in held]
        known = entry >= 0
        alone = np.flatnonzero(~known)  # long chunks, and all of a batch that the table cannot hold
        apart = self.encode(bytes_of(alone)) if len(alone) else []
        size = np.where(known, self.offset[entry + 1] - self.offset[entry], 0)
        size[alone] = [len(x) for x in apart]
        border = np.zeros(len(entry) + 1, dtype=np.int64)
        np.cumsum(size, out=border[1:])
        from_ = np.repeat(np.where(known, self.offset[entry], 0) - border[:-1], size) + np.arange(border[-1])
        out = self.ids[np.minimum(from_, len(self.ids) - 1)]
        for at, x in zip(alone.tolist(), apart, strict=True):
            out[border[at] : border[at + 1]] = x
        return out, border


class TextEncoder:
    """Encodes whole texts: ``cut`` finds the chunks, ``lead`` is put before each non-empty text."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], cut: Callable, lead: bytes = b""):
        self.table, self.cut, self.lead = ChunkTable(encode), cut, lead

    def _together(self, views: list) -> list[np.ndarray]:
        parts = [self.lead + bytes(v) if len(v) else b"" for v in views]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        borders = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=borders[1:])
        starts, ends = self.cut(data, borders) if len(data) else (borders[:0], borders[:0])
        if not len(starts):
            return [np.zeros(0, dtype=np.uint32)] * len(views)
        ids, border = self.table.ids_of(data, starts, ends)
        at = border[np.searchsorted(starts, borders)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row; none for null or empty rows."""
        out: list[np.ndarray] = []
        views, held = [], 0
        for v in utf8_rows(column):
            views.append(v)
            held += len(v)
            if held >= BATCH_BYTES:
                out += self._together(views)
                views, held = [], 0
        return out + self._together(views) if views else out


@lru_cache(maxsize=4)
def library_encoder(path: str, style: str) -> TextEncoder:
    """An encoder per worker process for a file of the tokenizers library. style: ``blank`` or ``spaced``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(chunks: list[bytes]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(chunks), 4096):
            texts = [c.decode("utf-8") for c in chunks[at : at + 4096]]
            out += [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    return TextEncoder(encode, {"blank": blank_cuts, "spaced": spaced_cuts}[style])
