"""Elias-Fano codes of non-decreasing integers, with select and successor search on the code itself.

n values up to ``top`` take about n * (2 + log2(top / n)) bits: the low bits of each value side by side, and
the high bits as a bit string with a one for each value after as many zeros as its high part. Stored with the code are
the number of ones before every ``_BLOCK``-th byte of the high bits, as 32-bit numbers: an eighth of a bit a value. They
serve select of ones (value i) and of zeros (the run of values with a high part); both then look at one block.
Nothing is expanded: a query of q values holds some hundred bytes for each of at most ``_MOST`` of them at a time.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes of high bits for each stored count, and rows packed at once (multiples of 8).
_BLOCK = 64
_ROWS = 1 << 14
#: So that the low bits and a shift fit 64 bits.
_MOST_LOW = 56
#: Values that a query looks up at once.
_MOST = 1 << 13
#: The place of the k-th one in each byte.
_IN_BYTE = np.array([[[*(b for b in range(8) if x >> b & 1), *[0] * 8][k] for k in range(8)] for x in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence; its arrays may be views of a memory-mapped file."""

    def __init__(self, n: int, low_bits: int, runs: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.runs, self.low, self.high, self.before = n, low_bits, runs, low, high, before

    def __len__(self) -> int:
        return self.n

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = min(_MOST_LOW, max(0, (top // max(n, 1)).bit_length() - 1))
        mask, places = U64((1 << low_bits) - 1), np.arange(low_bits, dtype=U64)
        low = [np.packbits((((values[a : a + _ROWS] & mask)[:, None] >> places) & U64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, _ROWS)]
        runs = (top >> low_bits) + 1
        flags = np.zeros(-(-(runs + n) // (8 * _BLOCK)) * 8 * _BLOCK, np.uint8)
        flags[(values >> U64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little")
        before = np.cumsum(np.bitwise_count(high).reshape(-1, _BLOCK).sum(1)) - np.bitwise_count(high).reshape(-1, _BLOCK).sum(1)
        return cls(n, low_bits, runs, np.concatenate([*low, np.zeros(8 + -sum(map(len, low)) % 8, np.uint8)]), high, before.astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, self.runs, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.before.tobytes()

    @classmethod
    def from_buffer(cls, raw, at: int = 0) -> EliasFano:
        """The code that begins at byte ``at``; its arrays are views of ``raw``."""
        raw = np.frombuffer(raw, np.uint8) if not isinstance(raw, np.ndarray) else raw
        n, low_bits, runs, n_low, n_high = np.frombuffer(raw[at : at + 40].tobytes(), "<u8").tolist()
        a, b = at + 40 + n_low, at + 40 + n_low + n_high
        return cls(n, low_bits, runs, raw[at + 40 : a], raw[a:b], raw[b : b + 4 * (n_high // _BLOCK)].view("<u4"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of values i."""
        bit = i * self.low_bits
        held = np.ascontiguousarray(self.low[(bit >> 3)[:, None] + np.arange(8)]).view("<u8").ravel()
        return (held >> (bit & 7).astype(U64)) & U64((1 << self.low_bits) - 1)

    def _place(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The places of the k-th ones, or zeros, in the high bits: by the counts to a block, by its words' to a word, by its bytes' to the bit."""
        before = self.before if ones else np.arange(len(self.before), dtype=np.uint32) * np.uint32(8 * _BLOCK) - self.before
        block = np.searchsorted(before, k.astype(np.uint32), "right") - 1
        k = k - before[block]
        row, word = np.arange(len(k)), np.zeros(len(k), np.int64)
        held = self.high.view("<u8")[(block * (_BLOCK // 8))[:, None] + np.arange(_BLOCK // 8)]
        for _ in range(2):  # words of the block, then bytes of the word
            upto = np.cumsum(np.bitwise_count(held if ones else ~held), axis=1, dtype=np.int16)
            at = (upto <= k[:, None]).sum(1)
            k = k - np.where(at > 0, upto[row, at - 1], 0)
            word = 8 * word + at
            held = np.ascontiguousarray(held[row, at]).view(np.uint8).reshape(len(k), -1)[:, :8]
        byte = self.high[block * _BLOCK + word]
        return (block * _BLOCK + word) * 8 + _IN_BYTE[byte if ones else ~byte, k]

    def select(self, i):
        """Value i, or those of an array of places."""
        if np.ndim(i) == 0:
            return int(self.select(np.array([i]))[0])
        out = np.empty(len(i), U64)
        for a in range(0, len(i), _MOST):
            at = np.asarray(i[a : a + _MOST], np.int64)
            out[a : a + _MOST] = ((self._place(at, True) - at).astype(U64) << U64(self.low_bits)) | self._lows(at)
        return out

    def find(self, values: np.ndarray, first=None, last=None) -> np.ndarray:
        """The index of each value within its range [first, last), or -1: two selects of zeros give the run of its high part, whose low bits are searched by halves."""
        values = np.asarray(values, U64)
        out = np.full(len(values), -1, np.int64)
        for a in range(0, len(values) if self.n else 0, _MOST):
            part = slice(a, a + _MOST)
            out[part] = self._find(values[part], 0 if first is None else first[part], self.n if last is None else last[part])
        return out

    def _find(self, values: np.ndarray, first, last) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        high = (values >> U64(self.low_bits)).astype(np.int64)
        low = values & U64((1 << self.low_bits) - 1)
        inside = high < self.runs
        high = np.where(inside, high, 0)
        both = self._place(np.concatenate([np.maximum(high - 1, 0), high]), False)
        at = np.maximum(np.where(high > 0, both[: len(high)] - (high - 1), 0), first)
        stop = np.minimum(both[len(high) :] - high, last)
        todo = np.flatnonzero(inside & (at < stop))
        end = stop.copy()
        while len(todo):
            middle = (at[todo] + stop[todo]) >> 1
            less = self._lows(middle) < low[todo]
            at[todo[less]] = middle[less] + 1
            stop[todo[~less]] = middle[~less]
            todo = todo[at[todo] < stop[todo]]
        known = np.flatnonzero(inside & (at < end))
        known = known[self._lows(at[known]) == low[known]]
        out[known] = at[known]
        return out
