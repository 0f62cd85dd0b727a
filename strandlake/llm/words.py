"""Words of UTF-8 texts with numpy: maximal runs of bytes that are not blank (0x20, 0x09 to 0x0D).

Equal words have equal values, and different words different ones but for an accident of 64 bits. Values depend on a key;
under one that the texts' authors do not know, no words or shingles can be made that have the same value. Tables find
strings by a hash that is seeded anew in every process and compare their bytes, so they answer by the bytes alone.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The bytes of a string that a lane of eight holds, by how many are left.
_HELD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SEED = np.frombuffer(os.urandom(16), dtype=np.uint64)
#: A key for values that do not leave the process.
OWN_KEY = int(_SEED[0])
_STEP, _TURN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Longer strings are not kept in tables.
LONGEST = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of each word."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on, as little-endian numbers; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


class SpanTable:
    """Numbers 0, 1, ... of byte strings of up to ``LONGEST`` bytes, with open addressing in numpy arrays."""

    def __init__(self, most: int, most_bytes: int):
        self.most, self.most_bytes = most, most_bytes
        self.slots = np.zeros(1 << (2 * most - 1).bit_length(), dtype=np.int32)
        self.mask = np.uint64(len(self.slots) - 1)
        self.clear()

    def clear(self) -> None:
        self.slots[:] = -1
        self.n = self.used = 0
        self.head = np.zeros(1 << 12, dtype=np.uint64)
        self.size = np.zeros(1 << 12, dtype=np.int64)
        self.at = np.zeros(1 << 12, dtype=np.int64)
        self.bytes = np.zeros(1 << 14, dtype=np.uint8)

    def full(self, strings: int) -> bool:
        return self.n + strings > self.most or self.used + strings * LONGEST > self.most_bytes

    def _slots_of(self, lanes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first eight bytes of each string, and the slot where it is looked for first."""
        head = lanes[starts] & _HELD[np.minimum(size, 8)]
        key = mix((head ^ _SEED[0]) + size.astype(np.uint64) * _TURN)
        for k in range(8, int(size.max(initial=0)), 8):
            more = np.flatnonzero(size > k)
            key[more] = mix((key[more] ^ _SEED[1]) * _STEP + (lanes[starts[more] + k] & _HELD[np.minimum(size[more] - k, 8)]))
        return head, key & self.mask

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each string, -1 where it has none."""
        out = np.full(len(starts), -1, dtype=np.int32)
        if not len(starts) or not self.n:
            return out
        lanes, kept, size = _lanes(data), np.ndarray(len(self.bytes) - 7, dtype="<u8", buffer=self.bytes, strides=(1,)), ends - starts
        head, slot = self._slots_of(lanes, starts, size)
        row = np.arange(len(starts))
        while len(row):
            have = self.slots[slot]
            used = have >= 0
            same = used & (self.head[have] == head[row]) & (self.size[have] == size[row])
            for k in range(8, int(size[row].max(initial=0)), 8):
                more = np.flatnonzero(same & (size[row] > k))
                held = _HELD[np.minimum(size[row[more]] - k, 8)]
                same[more] = (lanes[starts[row[more]] + k] & held) == (kept[self.at[have[more]] + k] & held)
            out[row[same]] = have[same]
            go = used & ~same
            row, slot = row[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def add(self, strings: list[bytes]) -> None:
        """Distinct strings without a number get the next ones."""
        raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
        size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        starts = np.cumsum(size) - size
        while self.n + len(strings) > len(self.head):
            self.head, self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.head, self.size, self.at))
        while self.used + len(raw) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        new = slice(self.n, self.n + len(strings))
        self.bytes[self.used : self.used + len(raw)] = raw
        self.size[new], self.at[new] = size, starts + self.used
        self.head[new], slot = self._slots_of(_lanes(raw), starts, size)
        number = np.arange(new.start, new.stop, dtype=np.int32)
        self.n, self.used = new.stop, self.used + len(raw)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several for one slot the last stays
            lost = self.slots[slot] != number
            number, slot = number[lost], (slot[lost] + np.uint64(1)) & self.mask


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit value of each word, whose lanes of eight bytes are mixed in turn.

    Bytes of 0xFF, which UTF-8 has not, fill up the last lane, so no two words of up to eight bytes have one value.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lanes, size = _lanes(data), ends - starts
    out = mix((lanes[starts] | ~_HELD[np.minimum(size, 8)]) ^ np.uint64(key))
    for k in range(8, min(int(size.max()), LONGEST), 8):
        more = np.flatnonzero(size > k)
        out[more] = mix(out[more] * _STEP + (lanes[starts[more] + k] | ~_HELD[np.minimum(size[more] - k, 8)]))
    for i in np.flatnonzero(size > LONGEST).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


def lowered(view: memoryview) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[np.frombuffer(view, dtype=np.uint8)]


def runs_of(word: np.ndarray, width: int, key: int = 0) -> np.ndarray:
    """A 64-bit value of each run of ``width`` words; there are at least that many."""
    rows = len(word) - width + 1
    value = np.full(rows, np.uint64(width) ^ np.uint64(key), dtype=np.uint64)
    for k in range(width):
        value = mix(value * _STEP + word[k : k + rows])
    return value


def shingle_set(view: memoryview, size: int, key: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit values of a text's word shingles; a shorter non-empty text is one shingle."""
    data = lowered(view)
    word = word_values(data, *spans(data), key)
    return np.unique(runs_of(word, min(size, len(word)), key)) if len(word) else word
