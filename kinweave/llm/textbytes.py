"""Words of UTF-8 text as numpy arrays, without an object for each word.

A batch of texts is one uint8 array and the offsets of its documents. All functions look at whole
texts; words never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the polynomial word hash, and the two of the bit mixer.
_BASE, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: everything but space and \x09-\x0D; and letters, digits and non-ASCII only.
BLANK = np.ones(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks() if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, most: int = 4 << 20):
    """Slices (first, last) of documents with about ``most`` bytes each; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray = BLANK):
    """(starts, ends, first): byte spans of all words, and the index of each document's first word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = alphabet[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    lens = ends - starts
    power = powers(int(lens.max()) if len(lens) else 0)
    total = np.concatenate([[0], np.cumsum(lens)])
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        begin, size = total[first:last] - total[first], lens[first:last]
        place = np.arange(total[last] - total[first]) - np.repeat(begin, size)
        at = place + np.repeat(starts[first:last], size)
        out[first:last] = np.add.reduceat((data[at].astype(U64) + U64(1)) * power[place], begin)
        first = last
    return mix(out ^ (lens.astype(U64) * _MIX2))


def combine(*parts: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit hash of several 64-bit hashes."""
    out = mix(parts[0] + _BASE)
    for part in parts[1:]:
        out = mix(out * _BASE + part)
    return out


def hash_text(word: bytes) -> int:
    """word_hashes of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def spread(first: np.ndarray, n: int) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(np.append(first[:-1], n)))
