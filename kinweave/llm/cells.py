"""Content-defined cells of text: runs of fixed-length strings that share their minimizer.

Every string of ``size`` bytes has an anchor, its first least-hashed ``K``-gram. Strings that follow each
other and have the same anchor place form a cell. Equal strings have equal anchors at equal places in them,
so equal strings lie in cells whose anchors have equal text.
"""

from __future__ import annotations

import numpy as np

from kinweave.llm.textbytes import blocks, mix

U64 = np.uint64
K = 24
#: Positions hashed at once; the anchor's place within them must fit its bits.
PIECE = 1 << 16
_PLACE = U64((1 << 17) - 1)
#: Odd multipliers, and a random word for each byte, from one generator.
_ODD = np.random.default_rng(20240607).integers(0, 1 << 63, 24, dtype=np.uint64) * U64(2) + U64(1)
_BYTE = np.random.default_rng(20240608).integers(0, 1 << 63, 256, dtype=np.uint64)


def _doubled(part: np.ndarray) -> np.ndarray:
    """A hash of each 16 consecutive bytes."""
    held = _BYTE[part]
    for level in range(4):
        width = 1 << level
        held = held[:-width] * _ODD[level] + held[width:]
    return held


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` consecutive values."""
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == window else np.minimum(values[: len(values) - (window - width)], values[window - width :])


def cells(data: np.ndarray, offsets: np.ndarray, size: int):
    """Arrays (start, count, anchor hash, cell hash, document) of the cells of all documents.

    ``start`` is the place of a cell's first string, ``count`` their number. The cell hash covers all bytes
    of its strings. A document's cells don't depend on the other documents.
    """
    if not 2 * K >= size - 2 >= K or size < 34:
        raise ValueError(f"size is from 34 to {2 * K + 2}")
    out = [[np.empty(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64)]
    for a, b in blocks(offsets, PIECE):
        end = int(offsets[b])
        for lo in range(int(offsets[a]), end - size + 1, PIECE if b == a + 1 else end + 1):
            hi = min(end, lo + PIECE + size - 1) if b == a + 1 else end
            for held, new in zip(out, _piece(data[lo:hi], offsets[a : b + 1] - lo, size)):
                held.append(new)
            out[0][-1] += lo
            out[4][-1] += a
    return tuple(np.concatenate(x) for x in out)


def _piece(part: np.ndarray, offsets: np.ndarray, size: int):
    n, window = len(part) - size + 1, size - K + 1
    held = _doubled(part)
    grams = held[: len(part) - K + 1] * _ODD[5] + held[K - 16 :][: len(part) - K + 1]
    grams ^= grams >> U64(29)
    grams *= _ODD[6]
    anchor = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window) & _PLACE
    edge = np.ones(n + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=edge[1:n])
    if len(offsets) > 2:
        edge[offsets[1:-1][offsets[1:-1] < n]] = True
        edge[np.clip(offsets[1:-1] - size + 1, 0, n)] = True
    bounds = np.flatnonzero(edge)
    first, last = bounds[:-1], bounds[1:] - 1
    doc = np.clip(np.searchsorted(offsets, first, "right") - 1, 0, len(offsets) - 2)
    if len(offsets) > 2:
        whole_strings = first + size <= offsets[doc + 1]
        first, last, doc = first[whole_strings], last[whole_strings], doc[whole_strings]
    a = anchor[first].astype(np.int64)
    whole = (a - first).astype(np.uint64) * _ODD[7] + (last - first).astype(np.uint64)
    for j, (at, add) in enumerate(((first, 0), (first, 16), (first, size - 16), (last, size - 32), (last, size - 16))):
        whole = mix(whole * _ODD[8 + j] + held[at + add])
    return first, last - first + 1, mix(grams[a]), whole, doc


def string_hashes(data: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``size`` bytes at each place."""
    one, two = np.zeros(len(places), np.uint64), np.ones(len(places), np.uint64)
    for lo in range(0, len(places), PIECE):
        at = slice(lo, lo + PIECE)
        words = np.zeros((len(places[at]), -(-size // 8) * 8), np.uint8)
        words[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[places[at]]
        for j, column in enumerate(words.view(np.uint64).T):
            one[at] = mix(one[at] * _ODD[14] + column)
            two[at] = mix(two[at] * _ODD[15] + (column ^ _ODD[16 + j % 8]))
    return one, two


def repeated_starts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Those ``places`` whose string of ``size`` bytes occurs again and whose occurrences aren't all preceded by one and the same string.

    ``places`` have all strings that may occur again, in order. Strings are told apart by 64-bit hashes. Either all
    occurrences of a string are among the result or none is: where each follows one and the same string, every repeat that
    begins there can be extended to the left. Equal counts of both strings wouldn't tell, as both may also occur apart.
    """
    if not len(places):
        return places
    hashes = string_hashes(data, places, size)[0]
    follows = np.zeros(len(places), bool)
    follows[1:] = places[1:] == places[:-1] + 1
    follows &= ~np.isin(places, offsets)
    before = np.zeros(len(places), U64)
    before[1:] = hashes[:-1]
    order = np.argsort(hashes)
    hashes, before, follows = hashes[order], before[order], follows[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    counts = np.diff(np.append(first, len(hashes)))
    extends = np.logical_and.reduceat(follows, first) & (np.minimum.reduceat(before, first) == np.maximum.reduceat(before, first))
    begin = np.empty(len(places), bool)
    begin[order] = np.repeat((counts > 1) & ~extends, counts)
    return places[begin]
