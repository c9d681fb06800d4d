"""Runs on arrays that tests hold the loops of joins against; moves without conflicts are made one after the other."""

from __future__ import annotations

import numpy as np

from kinweave.functions import GAIN_DIGITS
from kinweave.operators import louvain
from kinweave.operators.kernels import Graph


def conflict_free(graph: Graph, own: np.ndarray, threshold: float, max_rounds: int, early: bool = False):
    """The moves that come first by gain and id at both communities that they touch are made, one after the other."""
    own, before, previous = own.copy(), own.copy(), -1.0
    still = np.zeros(graph.n, int)
    for round in range(max_rounds):
        now = graph.modularity(own)
        if round and now - previous < threshold:
            return (own, now, round) if now > previous else (before, previous, round)
        previous, before = now, own.copy()
        totals = np.bincount(own, graph.degree, graph.n)
        asked = []
        for v in range(graph.n) if graph.total > 0 else []:
            if early and round > 2 and still[v] >= 2:
                continue
            a, b = graph.first[v], graph.first[v + 1]
            near, at = np.unique(own[graph.dst[a:b]], return_inverse=True)
            e = np.bincount(at, graph.weight[a:b], len(near))
            mine = own[v]
            inside = e[near == mine].sum() - graph.loop[v]
            gain = 2 * (e - inside) - 2 * graph.degree[v] * (totals[near] - (totals[mine] - graph.degree[v])) / graph.total
            gain = np.round(np.where(near == mine, 0, gain), GAIN_DIGITS)
            if len(gain) and gain.max() > 0:
                asked.append((-gain.max(), v, int(near[int(gain.argmax())])))
        still += 1
        still[[v for _, v, _ in asked]] = 0
        touched, first = {}, sorted(asked)
        for rank in first:
            for c in (own[rank[1]], rank[2]):
                touched.setdefault(int(c), rank)
        for rank in first:
            if touched[int(before[rank[1]])] is rank and touched[rank[2]] is rank:
                own[rank[1]] = rank[2]
    return before, previous, max_rounds


def run(src, dst, weight, options, start=None):
    """(ids, communities, modularity) as ``louvain`` finds them."""
    phase = louvain._local_phase

    def one(graph, own, options, threshold, colored, names):
        if options.sync in (1, 4):
            return conflict_free(graph, own, threshold, options.max_rounds, early=options.sync == 4)[:2]
        return phase(graph, own, options, threshold, colored, names)

    louvain._local_phase = one
    try:
        return louvain.run_local(src, dst, weight, options, start)
    finally:
        louvain._local_phase = phase
