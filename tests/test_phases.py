"""Whole phases in one task, against loops and versions on arrays."""

import numpy as np
import pytest

from kinweave import queries
from kinweave.operators import coloring, graph, kernels, louvain
from tests.test_graph import frame, random_graph, solved, vertices_of

FOUR = {"louvain_colored": dict(min_graph_size=0), **{f"louvain_sync{k}": dict(coloring=0, sync=k) for k in (1, 2, 4)}}


@pytest.mark.parametrize("options", FOUR.values())
@pytest.mark.parametrize("seed", [7, 8])
def test_phases_over_local_edges_run_in_one_task(spark, options, seed, monkeypatch):
    edges, ids = random_graph(spark, seed, 60, 150)
    options = louvain.Options(**options, local_edges=0, task_edges=2 * edges.count())
    for name in ("_turns", "_conflict_free", "_few_asking", "_local"):
        monkeypatch.setattr(louvain, name, None)
    rows = {r["v"]: r for r in louvain.louvain(vertices_of(spark, [*ids, 999]), edges, options).collect()}
    assert rows.pop(999)["community"] == -1
    want, quality = solved(edges, options)
    assert {v: r["community"] for v, r in rows.items()} == want
    assert all(r["modularity"] == pytest.approx(quality) for r in rows.values())


@pytest.mark.parametrize("name", FOUR)
def test_queries_run_phases_in_one_task(spark, name, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "edge_table", lambda s, d: None)
    monkeypatch.setattr(louvain, "louvain", lambda v, e, options: made.append(options) or v.selectExpr("v", "0.0D AS modularity"))
    queries.queries()[name](spark, "/root/testdata/sf0.001")
    # The links of 615,384 rows.
    assert made[0].task_edges >= 20 * 615_384 > made[0].local_edges


def test_colours_of_a_dense_graph(spark):
    """A clique takes a round for each vertex, more than the 200 that the joins did."""
    n = 202
    rows = [(i, j, 1.0) for i in range(n) for j in range(i + 1, n)]
    src, dst = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    ranks = kernels.row_hash(np.arange(n), 1)
    colors = kernels.color_greedy(kernels.Graph(src, dst, np.ones(n * n), n), ranks)
    assert (colors[np.argsort(-ranks)] == np.arange(n)).all()
    found = coloring.color_distance_one(vertices_of(spark, range(n)), graph.build_graph(frame(spark, rows)))
    assert {r["v"]: r["color"] for r in found.collect()} == dict(enumerate(colors.tolist()))
