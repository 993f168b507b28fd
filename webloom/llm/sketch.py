"""Similarity sketches of hashed sets, and exact overlap of sets, in numpy.

The sketch is filled in rounds (fast similarity sketching): in round i every
element is hashed to one of T bins with a value, and a bin that earlier rounds
left empty takes the least value of the round. After T such rounds, round T + b
puts all elements into bin b, so every coordinate is filled whatever the size of
the set. Two sets agree on a coordinate with the probability of their Jaccard
similarity, and the number of agreements is as concentrated as for independent
coordinates. Large sets need one or two rounds, so the work is linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from webloom.llm.tokens import mix, salts

BINS = 128
BAND = 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
ROUND_SALTS = salts(2 * BINS, 23)
BAND_SALTS = salts(BINS, 29)

SKETCH_SCHEMA = [("node", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))]


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each part, and its offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        values[a:b].sort()
    part = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (part[1:] != part[:-1])
    return values[fresh], np.concatenate(([0], np.cumsum(np.bincount(part[fresh], minlength=len(offsets) - 1))))


def sketches(values: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` coordinates, a power of two up to BINS, for each part; rows of empty parts stay EMPTY."""
    parts = len(offsets) - 1
    out = np.full(parts * bins, EMPTY)
    part = np.repeat(np.arange(parts), np.diff(offsets))
    for i in range(bins):
        if not len(values):
            return out.reshape(parts, bins)
        x = mix(values ^ ROUND_SALTS[i])
        slot = part * bins + (x & np.uint64(bins - 1)).astype(np.int64)
        np.minimum.at(out, slot, np.uint64(i << 56) | (x >> np.uint64(8)))
        unfilled = (out.reshape(parts, bins) == EMPTY).any(1)
        more = unfilled[part]
        values, part = values[more], part[more]
    for b in range(bins):
        x = mix(values ^ ROUND_SALTS[bins + b])
        lacking = out[part * bins + b] == EMPTY
        np.minimum.at(out, part[lacking] * bins + b, np.uint64((bins + b) << 56) | (x[lacking] >> np.uint64(8)))
    return out.reshape(parts, bins)


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits for each non-empty part that depend on its members only."""
    n = np.diff(offsets).astype(np.uint64)
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ salt), dtype=np.uint64))) for salt in salts(2, 31)]
    return np.stack([mix((s[offsets[1:]] - s[offsets[:-1]]) ^ n) for s in sums], axis=1)


def described(values: np.ndarray, offsets: np.ndarray, bins: int = BINS, band: int = BAND) -> list[pa.Array]:
    """The columns of SKETCH_SCHEMA for distinct values; an empty set has no bands and a null node.

    Every ``band`` coordinates make a band.
    """
    count = bins // band
    n = np.diff(offsets)
    full = n > 0
    coords = sketches(values, offsets, bins)[:, : count * band]
    low = np.zeros((len(n), count), np.uint64)
    for j in range(band):
        low += mix(coords[:, j::band] ^ BAND_SALTS[j]) * np.uint64(2 * j + 1)
    keys = mix(low ^ BAND_SALTS[None, :count]).view(np.int64)
    nodes = np.ascontiguousarray(set_keys(values, offsets)).view(np.uint8).reshape(len(n), 16)
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * count))).astype(np.int32)), pa.array(keys[full].ravel()))
    return [
        pa.array([x.tobytes() if f else None for x, f in zip(nodes, full, strict=True)], pa.binary()),
        pa.array(n.astype(np.int64)),
        bands,
    ]


def difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Members of one of two sorted sets of distinct values only, sorted."""
    both = np.concatenate((x, y))
    both.sort(kind="mergesort")
    twin = np.zeros(len(both), bool)
    twin[1:] = both[1:] == both[:-1]
    twin[:-1] |= twin[1:]
    return both[~twin]


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of ``right``, by products of blocks of columns."""
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(v) for v in (*left, *right)])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    new = np.cumsum(count > 1) - 1
    row, column = row[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(left) + len(right), width), np.float32)
        block[row[a:b], column[a:b] - first] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)
