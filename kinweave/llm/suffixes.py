"""Enhanced suffix arrays over chosen suffixes of a text, and their common-prefix interval tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes compared at once (a multiple of 8); sixteen times as many once at most ``_FEW`` suffixes are tied.
_STEP, _FEW = 48, 128


def enhanced_suffix_array(data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): indices of the suffixes data[starts[i]:limits[i]] in order, and the common prefix of each with the one before.

    Suffixes are sorted by blocks of bytes; only those still tied take part in the next round. Equal
    suffixes keep the order of their indices.
    """
    n = len(starts)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    active, depth = np.arange(n), 0
    data = np.concatenate([data, np.zeros(16 * _STEP, np.uint8)])
    while len(active) > 1:
        rows = order[active]
        step = _STEP if len(rows) > _FEW else 16 * _STEP
        at = starts[rows] + depth
        left = np.minimum(limits[rows] - at, step)
        held = np.lib.stride_tricks.sliding_window_view(data, step)[at]
        # Bytes beyond the limit are zeros; of texts equal with these the shorter comes first.
        short = np.flatnonzero(left < step)
        held[short] *= np.arange(step) < left[short, None]
        words = held.view(">u8").astype(np.uint64)
        by = np.lexsort((rows, left, *words.T[::-1], group[active]))
        rows, held, left, own = rows[by], held[by], left[by], group[active][by]
        order[active] = rows
        same = np.flatnonzero(own[1:] == own[:-1])
        unlike = held[same + 1] != held[same]
        common = np.minimum(np.where(unlike.any(1), unlike.argmax(1), step), np.minimum(left[same + 1], left[same]))
        lcp[active[same + 1]] = depth + common
        tied = np.zeros(len(rows), bool)
        tied[same[common == step] + 1] = True
        member = tied.copy()
        member[:-1] |= tied[1:]
        label = np.cumsum(~tied)
        active, label = active[member], label[member]
        group = np.zeros(n, np.int64)
        group[active] = label
        depth += step
    return order, lcp


@dataclass(frozen=True)
class Interval:
    """Rows first to last (exclusive) of a suffix array share exactly ``depth`` bytes; ``parent`` is the depth of the interval around it."""

    depth: int
    first: int
    last: int
    parent: int


def interval_tree(lcp: np.ndarray, floor: int) -> np.ndarray:
    """Rows (depth, first, last, parent) of the intervals of depth ``floor`` or more, inner ones first, by a scan with a stack.

    ``parent`` is the row of the interval around it, which comes later, or -1.
    """
    out, stack = [], []
    for i, depth in enumerate([*lcp.tolist(), 0]):
        depth = depth if i and depth >= floor else 0
        first, inside = i - 1, []
        while stack and stack[-1][0] > depth:
            top, first, children = stack.pop()
            for child in inside + children:
                out[child][3] = len(out)
            inside = [len(out)]
            out.append([top, first, i, -1])
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first, inside))
        elif depth:
            stack[-1][2].extend(inside)
    return np.array(out, np.int64).reshape(-1, 4)


def common_prefix_intervals(lcp: np.ndarray, floor: int) -> list[Interval]:
    """Intervals of depth ``floor`` or more, inner ones first."""
    tree = interval_tree(lcp, floor)
    depths = np.append(tree[:, 0], 0)
    return [Interval(d, a, b, int(depths[p])) for d, a, b, p in tree.tolist()]


def left_diverse(left: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each range of ``left`` (the byte before each suffix, -1 at the begin of its document) whether it holds different bytes or a begin."""
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]) if len(left) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(left < 0)])
    return (change[last - 1] > change[first]) | (begin[last] > begin[first])


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first:last] for each range."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp((last - first).astype(float))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(values[first[at]], values[last[at] - (1 << k)])
        values = np.minimum(values[: -(1 << k)], values[1 << k :]) if len(values) > 1 << k else values
    return out


class RepeatTree:
    """The common-prefix interval tree of the suffixes data[starts[i]:limits[i]], whose documents begin at begins[i]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray, begins: np.ndarray, floor: int):
        self.starts = starts
        self.order, lcp = enhanced_suffix_array(data, starts, limits)
        self.depth, self.first, self.last, self.parent = interval_tree(lcp, floor).T
        at = starts[self.order]
        left = np.where(at > begins[self.order], data[at - 1].astype(np.int64), -1) if len(at) else at
        self.diverse = left_diverse(left, self.first, self.last)

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places) of each repeat that can be extended neither right nor left, with all its places."""
        for node in np.flatnonzero(self.diverse).tolist():
            yield int(self.depth[node]), np.sort(self.starts[self.order[self.first[node] : self.last[node]]])

    def covered(self, ranks: np.ndarray) -> np.ndarray:
        """For each suffix the length of the longest maximal repeat at its place that a suffix of lower rank shares."""
        out = np.zeros(len(ranks), np.int64)
        if not len(self.depth):
            return out
        held = ranks[self.order]
        least = _range_minima(held, self.first, self.last)
        #: The nearest maximal repeat from each node up, and the depth of the next one above with a lower rank.
        own, above = np.full(len(self.depth), -1), np.zeros(len(self.depth), np.int64)
        node = np.full(len(ranks), -1)
        for k in range(len(self.depth) - 1, -1, -1):
            up = self.parent[k]
            if self.diverse[k]:
                own[k] = k
                if up >= 0:
                    above[k] = self.depth[up] if least[up] < least[k] else above[up]
            elif up >= 0:
                own[k] = own[up]
            node[self.first[k] : self.last[k]] = own[k]
        at = np.flatnonzero(node >= 0)
        mine = node[at]
        out[self.order[at]] = np.where(least[mine] < held[at], self.depth[mine], above[mine])
        return out


def maximal_repeats(data: np.ndarray, starts: np.ndarray, limits: np.ndarray, begins: np.ndarray, floor: int) -> list[tuple[int, np.ndarray]]:
    """(length, places) of each repeat of ``floor`` bytes or more that can be extended neither left nor right, with all its places.

    ``begins`` has the first byte of each suffix's document.
    """
    return list(RepeatTree(data, starts, limits, begins, floor).groups())
