"""Word kernels over UTF-8 bytes.

Both word classes used by the operators are separated by ASCII bytes only, so words can be cut and
hashed on the raw Arrow string buffer, for a whole chunk of documents at once. Every function here
is a small helper inside a Spark task; chunks are bounded in bytes (one document at least), so the
memory of a task is set by ``CHUNK`` and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SEED = 20_240_131
_U = np.uint64

#: ``[^\x20\x09-\x0D]+``
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case
MARK_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

SPACE_WORD = r"[^\x20\x09-\x0D]+"
MARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), in place on a fresh array."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@cache
def _odd(k: int) -> tuple[int, int]:
    """An odd multiplier of 64 bits, and its inverse modulo 2^64."""
    p = int(np.random.default_rng(SEED + k).integers(1 << 62, 1 << 63)) | 1
    return p, pow(p, -1, 1 << 64)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(k: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of multiplier k (or of its inverse), modulo 2^64."""
    own = _POWERS.get((k, inverse))
    if own is None or len(own) < n:
        m = max(n, 1 << 16)
        base = np.full(m, _odd(k)[inverse], _U)
        base[0] = 1
        own = np.multiply.accumulate(base)
        if m <= 4 * CHUNK:
            _POWERS[k, inverse] = own
    return own[:n]


@cache
def _tables(mark: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: does it belong to a word, and its 64-bit value (A-Z as a-z for mark words)."""
    cut = np.zeros(256, bool)
    cut[list(MARK_BYTES if mark else SPACE_BYTES)] = True
    if mark:
        cut[ord("A") : ord("Z") + 1] = False
    value = np.random.default_rng(SEED).integers(1, 1 << 63, 256).astype(_U)
    if mark:
        value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    return ~cut, value


@cache
def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@dataclass
class Words:
    """The words of a chunk of documents, in order."""

    first: int
    data: np.ndarray  # the bytes of the chunk (lower-cased for mark words when asked)
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray  # 64-bit hash of each word
    offset: np.ndarray  # word offsets of the documents: document i has words offset[i]:offset[i + 1]

    @property
    def n_docs(self) -> int:
        return len(self.offset) - 1

    def doc(self) -> np.ndarray:
        """For each word, the document's place in the chunk."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.offset))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def windows(self, n: int, multiplier: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index) and 64-bit hash of each n-word window inside one document."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        own = window_hashes(self.hash, n, multiplier)
        counts = np.maximum(np.diff(self.offset) - n + 1, 0)
        at = ranges(self.offset[:-1], counts)
        return at, own[at]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them), for each i in turn."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - (ends - count), count)


def window_hashes(hashes: np.ndarray, n: int, multiplier: int = 1) -> np.ndarray:
    """Hash of hashes[i : i + n] for each i: a polynomial of the word hashes, then mixed."""
    total = len(hashes)
    with np.errstate(over="ignore"):
        sums = np.zeros(total + 1, _U)
        np.cumsum(hashes * powers(multiplier, total), out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * powers(multiplier, total - n + 1, inverse=True))


def cut(data: np.ndarray, bounds: np.ndarray, mark: bool = False, first: int = 0) -> Words:
    """Cut and hash the words of documents data[bounds[i]:bounds[i + 1]]."""
    inside, value = _tables(mark)
    n, docs = len(data), len(bounds) - 1
    bounds = bounds.astype(np.int64)
    # a separator is put between documents, so that no word crosses their border
    flags = np.zeros(n + docs + 1, bool)
    at = np.arange(n, dtype=np.int64)
    lengths = np.diff(bounds)
    at += np.repeat(np.arange(docs, dtype=np.int64), lengths)
    flags[at] = inside[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if flags[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[0::2], edges[1::2]
    padded_end = bounds[1:] + np.arange(docs)  # of document i in the padded text
    offset = np.concatenate([[0], np.searchsorted(start, padded_end, side="left")]).astype(np.int64)
    shift = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offset))
    start, end = start - shift, end - shift
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(value[data] * powers(0, n), out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * powers(0, n, inverse=True)[start]) if len(start) else np.zeros(0, _U)
    return Words(first, data, start, end, hashes, offset)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _lower_table()[data]


def chunks(column: pa.Array, mark: bool = False, size: int = CHUNK, lowered: bool = False) -> Iterator[Words]:
    """The words of a text column, some megabytes of whole documents at a time; mark words are lower case."""
    offsets, data = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        own = data[offsets[i] : offsets[j]]
        yield cut(lower(own) if mark or lowered else own, offsets[i : j + 1] - offsets[i], mark, i)
        i = j


def number(column: pa.Array, mark: bool = False) -> int:
    """How many words a text column has."""
    offsets, data = buffers(column)
    inside = _tables(mark)[0][data[offsets[0] : offsets[-1]]]
    # the byte before is of the same word, unless a text begins here
    again = inside[1:] & inside[:-1]
    begin = offsets[:-1] - offsets[0] - 1
    again[begin[(begin >= 0) & (begin < len(again))]] = False
    return int(np.count_nonzero(inside) - np.count_nonzero(again))
