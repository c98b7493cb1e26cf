"""Words of many documents at once, on the Arrow buffers: positions, 64-bit hashes and window hashes.

A word is a run of bytes other than space and 0x09-0x0D, so UTF-8 text needs no decoding. Batches are cut into
tiles of bounded bytes (one longer document is a tile of its own); all arrays of a tile are numpy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa

TILE_BYTES = 2 << 20
HASH_BLOCK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift, multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@lru_cache(8)
def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=_U)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the longest n so far."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), _U)
        have[0] = 1
        done = 1
        while done < len(have):
            step = min(done, len(have) - done)
            have[done : done + step] = have[:step] * _U(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of ``values[start:end]`` (of ``table[values]`` if given) for each span, the same wherever it stands.

    Goes through the spans in blocks of nearby ones, so the working arrays stay small.
    """
    if len(start) > 1 and (start[1:] < start[:-1]).any():
        order = np.argsort(start, kind="stable")
        out = np.empty(len(start), _U)
        out[order] = spans_hash(values, start[order], end[order], table)
        return out
    out, i = np.empty(len(start), _U), 0
    while i < len(start):
        low = int(start[i])
        j = int(np.searchsorted(start, low + HASH_BLOCK))
        a, b = start[i:j] - low, end[i:j] - low
        part = values[low : low + int(b.max())]
        part = part if table is None else table[part]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * _powers(_BASE, len(part)), out=sums[1:])
        inverse = _powers(pow(_BASE, -1, 1 << 64), len(part) + 1)
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


@dataclass
class Tile:
    """Documents ``rows`` of a batch: their bytes, and the words' byte ranges; ``first[d]:first[d+1]`` are words of d."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hash(self, seed: int = 1, data: np.ndarray | None = None) -> np.ndarray:
        return spans_hash(self.data if data is None else data, self.start, self.end, byte_values(seed))

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words that lie in one document, and the windows' hashes."""
        n = np.maximum(self.n_words - k + 1, 0)
        at = np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, spans_hash(hashes, at, at + k)

    def text(self, d: int) -> str:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes().decode("utf-8", "replace")


def _text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def tile(batch: pa.RecordBatch, column: str = "text", sep: np.ndarray = SEP) -> Tile:
    """Words are the runs of bytes that are not marked in ``sep``."""
    raw, off = _text_buffers(batch.column(column))
    data, off = raw[off[0] : off[-1]], off - off[0]
    inside = ~sep[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[(off > 0) & (off < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Tile(batch, data, off, start, end, np.searchsorted(start, off))


def cuts(batch: pa.RecordBatch, column: str = "text", limit: int = TILE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` text bytes, or one document."""
    if not batch.num_rows:
        return
    _, off = _text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def tiles(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TILE_BYTES, sep: np.ndarray = SEP) -> Iterator[Tile]:
    for batch in batches:
        for part in cuts(batch, column, limit):
            yield tile(part, column, sep)
