"""Vectorised word kernels over Arrow text columns: spans, 64-bit word hashes, n-gram hashes.

Hashes are fixed functions of the bytes, equal in every task. A word hash sums a random 64-bit value per byte
times an odd power per place and is then mixed; n-gram hashes combine word hashes by place and are mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64


def _stream(seed: int, n: int) -> np.ndarray:
    """n values of the splitmix64 stream of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SOLID = ~_WHITE
_BYTES = _stream(0x5EED1, 256)
_BYTES[_WHITE] = 0
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_PLACES = _stream(0x5EED2, 1 << 16) | U(1)
_GRAM = _stream(0x5EED3, 64) | U(1)


@dataclass
class Words:
    """Words of the rows of a chunk: byte spans, hashes, and where each row's words begin."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # row i has words first[i]:first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and 64-bit offsets of a text column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches whose texts hold about ``most`` bytes, one row at least; whole texts always."""
    for batch in batches:
        data, offs = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def tokenize(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row; with ``lower``, A-Z hash like a-z. A word never spans rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U), np.zeros(len(offs), np.int64))
    solid = _SOLID[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    begin[edges] = solid[edges]
    starts = np.flatnonzero(begin)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U), np.zeros(len(offs), np.int64))
    of = np.cumsum(begin, dtype=np.int32) - 1
    of[: starts[0]] = 0
    place = (np.arange(len(data), dtype=np.int64) - starts[of]) & 0xFFFF
    with np.errstate(over="ignore"):
        value = (_LOWER if lower else _BYTES)[data] * _PLACES[place]
        lengths = np.add.reduceat(solid.astype(np.int64), starts)
        hashes = mix(np.add.reduceat(value, starts) + lengths.astype(U) * U(0x9E3779B97F4A7C15))
    return Words(data, starts, lengths, hashes, np.searchsorted(starts, offs))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each place; the caller masks those that leave a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _GRAM[0]
        for j in range(1, k):
            total += hashes[j : j + n] * _GRAM[j]
    return mix(total)


def long_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``grams``, by doubling: for long windows in O(log k) steps."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    level, span, at, out = hashes, 1, 0, None
    while True:
        if k & span:
            part = level[at : at + n]
            out = part if out is None else _pair(out, part)
            at += span
        if 2 * span > k:
            return out
        level = _pair(level[: len(level) - span], level[span:])
        span *= 2


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U(0xD6E8FEB86659FD93) + b * U(0xA0761D6478BD642F) + U(0x2545F4914F6CDD1D))


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    span = 1
    n = len(x) - w + 1
    while 2 * span <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U)


class Bloom:
    """A blocked-free Bloom filter of fixed size over mixed 64-bit keys; three probes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.mask = U((1 << bits) - 1)
        self.data = np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    def _spots(self, keys: np.ndarray):
        with np.errstate(over="ignore"):
            again = mix(keys + U(0xA5A5A5A5A5A5A5A5))
            for j in range(3):
                yield (keys + U(j) * (again | U(1))) & self.mask

    def add(self, keys: np.ndarray) -> None:
        for s in self._spots(keys):
            np.bitwise_or.at(self.data, (s >> U(3)).astype(np.int64), (1 << (s & U(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for s in self._spots(keys):
            found &= (self.data[(s >> U(3)).astype(np.int64)] >> (s & U(7)).astype(np.uint8)) & 1 == 1
        return found
