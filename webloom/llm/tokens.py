"""Words and their 64-bit hashes from Arrow text columns, a few megabytes at a time.

Helpers for ``mapInArrow`` tasks. A task sees whole texts; the slices keep the
temporary arrays of a Python worker small. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUE = salts(256, 11)
PLACE = np.uint64(0xD6E8FEB86659FD93)
_places = np.ones(1, np.uint64)


def places(n: int) -> np.ndarray:
    """Powers of the odd base of the word hash, at least ``n`` of them."""
    global _places
    if len(_places) < n:
        powers = np.full(max(n, 1024), PLACE)
        powers[0] = 1
        _places = np.multiply.accumulate(powers)
    return _places


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its values."""
    column = column.cast(pa.string()).fill_null("")
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, most_rows: int = 4096
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``most`` bytes of text and ``most_rows`` rows: rows, bytes, offsets."""
    data, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, first + most_rows, batch.num_rows)
        part = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
        first = last


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice, in order; A-Z in lower case unless ``lower`` is false."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.docs = len(offsets) - 1
        solid = ~IS_SPACE[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        starts, ends = offsets[:-1], offsets[1:] - 1
        starts, ends = starts[starts < len(data)], ends[ends >= 0]
        first[starts] = solid[starts]
        last[ends] = solid[ends]
        self.solid = solid
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.docs)

    def __len__(self) -> int:
        return len(self.starts)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the words without the spaces between them, and n + 1 offsets."""
        return self.data[self.solid], np.concatenate(([0], np.cumsum(self.ends - self.starts)))

    def strings(self) -> pa.Array:
        data, offsets = self.packed()
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        data, offsets = self.packed()
        lengths = np.diff(offsets)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
        values = BYTE_VALUE[data] * places(int(lengths.max()))[place]
        return mix(np.add.reduceat(values, offsets[:-1]) + lengths.astype(np.uint64))


def hash_strings(column: pa.Array) -> np.ndarray:
    """The hash that ``Words.hashes`` gives for each of these words."""
    data, offsets = utf8(column)
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    values = BYTE_VALUE[data] * places(int(lengths.max(initial=0)) + 1)[place]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + lengths.astype(np.uint64))


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)
