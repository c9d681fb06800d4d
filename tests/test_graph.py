"""Golden graphs, invariants, and loops of joins against versions on arrays."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave import loops, queries
from kinweave.operators import coloring, graph, kernels, knn, links, louvain, metrics, ordering
from kinweave.operators.components import connected_components
from kinweave.plans.cluster import fast_cluster
from tests import arrays

SF = "/root/testdata/sf0.001"


def cliques(n, size, offset=1):
    """n cliques in a ring, each joined to the next by one link."""
    rows = []
    for c in range(n):
        base = offset + c * size
        rows += [(base + i, base + j, 1.0) for i in range(size) for j in range(i + 1, size)]
        if n > 1 and (c + 1 < n or n > 2):
            rows.append((base, offset + (c + 1) % n * size + 1, 1.0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def vertices_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "v long")


def random_graph(spark, seed, n, links):
    """Symmetric edges with weights, self-loops and leaves, and their vertices."""
    rng = np.random.default_rng(seed)
    held = {(min(a, b), max(a, b)): round(float(w), 3) for a, b, w in zip(rng.integers(1, n, links).tolist(), rng.integers(1, n, links).tolist(), rng.random(links) + 0.1)}
    rows = [(*pair, w) for pair, w in held.items()] + [(1, n + 5, 1.0), (2, n + 6, 0.5)]
    return graph.build_graph(frame(spark, rows)), sorted({x for r in rows for x in r[:2]})


def assignment(df):
    return {r["v"]: r["community"] for r in df.collect()}


ALL = [dict(), dict(coloring=0), dict(coloring=0, sync=1)]


@pytest.mark.parametrize("options", ALL)
def test_two_cliques(spark, options):
    edges = graph.build_graph(frame(spark, cliques(2, 5)))
    found = louvain.louvain(vertices_of(spark, range(1, 12)), edges, louvain.Options(**options))
    got = assignment(found)
    assert got.pop(11) == -1
    assert got == {i: 1 if i <= 5 else 6 for i in range(1, 11)}
    q = 2 * (20 / 42 - (21 / 42) ** 2)
    assert all(r["modularity"] == pytest.approx(q) for r in found.where("community > 0").collect())


def solved(edges, options, start=None):
    """The same run on arrays."""
    src, dst, weight = (np.array(x) for x in zip(*(tuple(r) for r in edges.select("src", "dst", "weight").collect())))
    ids, label, quality = arrays.run(src, dst, weight, options, start)
    return dict(zip(ids.tolist(), label.tolist())), quality


SAME = [dict(), *(dict(coloring=0, sync=k) for k in (1, 2, 3, 4)), dict(coloring=0, directed=True), dict(coloring=0, percent=60, redraw=True)]


@pytest.mark.parametrize("options", SAME)
def test_loops_of_joins_match_arrays(spark, options):
    edges, ids = random_graph(spark, 7, 12, 16)
    options = louvain.Options(**options, local_edges=0)
    found = louvain.louvain(vertices_of(spark, [*ids, 999]), edges, options)
    rows = {r["v"]: r for r in found.collect()}
    assert rows.pop(999)["community"] == -1
    want, quality = solved(edges, options)
    assert {v: r["community"] for v, r in rows.items()} == want
    assert all(r["modularity"] == pytest.approx(quality) for r in rows.values())


@pytest.mark.parametrize("options", [dict(min_graph_size=0), dict(coloring=0, sync=2)])
def test_turns_on_joins_end_with_the_large_phases(spark, options, monkeypatch):
    edges, ids = random_graph(spark, 7, 40, 90)
    options = louvain.Options(**options, follow=False, local_edges=edges.count() - 1)
    read, turns = [], louvain._turns
    monkeypatch.setattr(louvain, "_turns", lambda e, *a: read.append(e.count()) or turns(e, *a))
    rows = louvain.louvain(vertices_of(spark, ids), edges, options).collect()
    want, quality = solved(edges, options)
    assert read == [edges.count()]
    assert {r["v"]: r["community"] for r in rows} == want and all(r["modularity"] == pytest.approx(quality) for r in rows)


@pytest.mark.parametrize("sync, share", [(1, 1.0), (4, 1.0), (1, 0.6)])
def test_rounds_of_few_moves_leave_the_joins(spark, sync, share, monkeypatch):
    edges, ids = random_graph(spark, 7, 60, 80)
    options = louvain.Options(coloring=0, sync=sync, local_edges=int(share * edges.count()))
    monkeypatch.setattr(louvain, "FRONTIER", 1.1)
    rounds, judged = [], louvain._judged
    monkeypatch.setattr(louvain, "_judged", lambda *a, **k: rounds.append(1) or judged(*a, **k))
    made, few = [], louvain._few_asking
    monkeypatch.setattr(louvain, "_few_asking", lambda *a: made.append(few(*a)) or made[-1])
    rows = louvain.louvain(vertices_of(spark, ids), edges, options).collect()
    want, quality = solved(edges, options)
    assert {r["v"]: r["community"] for r in rows} == want and all(r["modularity"] == pytest.approx(quality) for r in rows)
    # A part that has the whole graph is left for the last round alone.
    counts = [m[1] for m in made if m]
    assert sum(counts) > 3 and (share < 1 or len(rounds) <= 2 * sum(c > 0 for c in counts) + 4)


@pytest.mark.parametrize("merged", [True, False])
def test_merged_sweeps_send_no_broadcasts(spark, merged):
    edges, ids = random_graph(spark, 7, 12, 16)
    weights = louvain.vertex_weights(edges)
    state = weights.select(F.col("d_v").alias("v"), F.col("d_v").alias("own"), "degree", "loop")
    m2 = edges.agg(F.sum("weight")).first()[0]
    swept = louvain._judged(edges, state, m2, merged=merged)
    got = {r["v"]: r["target"] for r in swept.collect()}
    assert ("Broadcast" in swept._jdf.queryExecution().executedPlan().toString()) != merged
    assert got == {r["v"]: r["community"] for r in louvain.best_move(edges, louvain.singletons(state)).collect()}


def test_warm_start(spark):
    edges, ids = random_graph(spark, 8, 30, 50)
    given = {i: 100 + i % 4 for i in ids}
    options = louvain.Options(coloring=0)
    found = louvain.louvain(vertices_of(spark, ids), edges, options, spark.createDataFrame(list(given.items()), "v long, community long"))
    assert assignment(found) == solved(edges, options, given)[0]


def test_sweeps_over_affected_vertices_change_nothing(spark, monkeypatch):
    """Sweeps that read only the edges of vertices that moves can affect find the same targets."""
    edges, ids = random_graph(spark, 9, 60, 90)
    options = louvain.Options(coloring=0, follow=False)
    want = solved(edges, options)[0]
    read = []
    affected = louvain._affected
    monkeypatch.setattr(louvain, "_affected", lambda *a: read.append(affected(*a)) or read[-1])
    monkeypatch.setattr(louvain, "FRONTIER", 1.0)
    assert assignment(louvain.louvain(vertices_of(spark, ids), edges, options)) == want and len(read) > 2


def test_directed_doubles_the_constant(spark):
    """On a path of three the doubled null model keeps apart what the plain one joins."""
    arcs = frame(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)])
    options = dict(coloring=0, follow=False)
    plain = assignment(louvain.louvain(vertices_of(spark, range(1, 4)), arcs, louvain.Options(**options)))
    doubled = assignment(louvain.louvain(vertices_of(spark, range(1, 4)), arcs, louvain.Options(**options, directed=True)))
    assert set(plain.values()) == {1} and doubled == {1: 1, 2: 2, 3: 3}


def test_sweep_matches_arrays(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), round(float(w), 3)) for a, b, w in zip(rng.integers(1, 40, 120), rng.integers(1, 40, 120), rng.random(120)) if w > 0]
    edges = graph.build_graph(frame(spark, rows))
    ids = sorted({x for r in rows for x in r[:2]})
    src, dst, weight = (np.array(x) for x in zip(*[tuple(r) for r in edges.collect()]))
    g = kernels.Graph(np.searchsorted(ids, src), np.searchsorted(ids, dst), weight, len(ids))
    own = np.arange(len(ids))
    for _ in range(4):
        assign = spark.createDataFrame([(ids[i], ids[c]) for i, c in enumerate(own.tolist())], "v long, community long")
        assert metrics.modularity(edges, assign).first()[0] == pytest.approx(g.modularity(own))
        own = g.best_moves(own)
        assert assignment(louvain.best_move(edges, assign)) == {ids[i]: ids[c] for i, c in enumerate(own.tolist())}


def test_regression(spark):
    """Simultaneous sweeps on the unscaled embeddings reach the known modularity."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select((F.col("vec_id") + 1).alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    edges = graph.build_graph(links.dedup_links(links.jaccard_links(knn.knn_exact(rows, 10))))
    found = louvain.louvain(rows.select(F.col("id").alias("v")), edges, louvain.Options(coloring=0, follow=False)).collect()
    assert found[0]["modularity"] == pytest.approx(0.734556, abs=2e-3)
    assert len({r["community"] for r in found}) == pytest.approx(34, abs=3)


def test_coarsen_keeps_degrees(spark):
    edges = graph.build_graph(frame(spark, [*cliques(3, 4), (1, 1, 0.5)]))
    assign = spark.createDataFrame([(i, (i - 1) // 4 * 4 + 1) for i in range(1, 13)], "v long, community long")
    before = edges.agg(F.sum("weight")).first()[0]
    coarse = graph.coarsen(edges, assign)
    assert coarse.agg(F.sum("weight")).first()[0] == pytest.approx(before)
    own = coarse.select(F.col("src").alias("v")).distinct().withColumn("community", F.col("v"))
    assert metrics.modularity(coarse, own).first()[0] == pytest.approx(metrics.modularity(edges, assign).first()[0])


def test_vertex_following(spark):
    star = [(1, i, 0.25) for i in range(2, 8)] + [(20, 21, 0.5), (30, 30, 0.5)]
    got = assignment(graph.vertex_following(vertices_of(spark, [*range(1, 8), 20, 21, 30, 40]), graph.build_graph(frame(spark, star))))
    assert got == {**{i: 1 for i in range(1, 8)}, 20: 20, 21: 20, 30: 30, 40: -1}


def test_dedup_first_wins(spark):
    rows = [(0, 0, 0.0, 0), (1, 2, 0.3, 1), (2, 1, 0.2, 2), (3, 3, 0.5, 3), (3, 4, 0.0, 4), (4, 3, 0.1, 5)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double, ord int")
    assert sorted(tuple(r) for r in links.dedup_links(df, "ord").collect()) == [(1, 2, 0.3), (3, 3, 0.5), (3, 4, 0.1)]


def test_missing_neighbours(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (3, 3), (3, None)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["weight"] for r in links.jaccard_links(df).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 0.5, (2, 2): 0.5, (2, 1): 0.5, (3, 3): 0.5}


def test_colorings(spark):
    edges = graph.build_graph(frame(spark, cliques(5, 5)))
    nodes = vertices_of(spark, range(1, 27))
    plain = coloring.color_distance_one(nodes, edges)
    assert metrics.color_conflicts(edges, plain).first()[0] == 0 and plain.where("color < 0").count() == 0
    even = coloring.color_balanced(nodes, edges)
    assert metrics.color_conflicts(edges, even).first()[0] == 0
    assert metrics.color_stats(even).first()["variance"] <= metrics.color_stats(plain).first()["variance"]
    few = coloring.color_max_min(nodes, edges, 8)
    assert few.agg(F.max("color")).first()[0] <= 8


def test_colorings_match_arrays(spark):
    rng = np.random.default_rng(3)
    edges = graph.build_graph(frame(spark, cliques(5, 5) + [(int(a), int(b), 1.0) for a, b in rng.integers(1, 60, (40, 2)) if a != b]))
    rows = lambda df: sorted((r["v"], r["color"]) for r in df.collect())
    ids = np.array([r["v"] for r in edges.select(F.col("src").alias("v")).distinct().orderBy("v").collect()])
    src, dst, weight = (np.array(x) for x in zip(*(tuple(r) for r in edges.collect())))
    small = kernels.Graph(np.searchsorted(ids, src), np.searchsorted(ids, dst), weight, len(ids))
    own = spark.createDataFrame([(int(i),) for i in ids], "v long")
    plain = kernels.color_greedy(small, kernels.row_hash(ids, 1))
    for got, want in (
        (coloring.color_distance_one(own, edges), plain),
        (coloring.color_balanced(own, edges), kernels.balance(small, plain, ids)),
        (coloring.color_balanced(own, edges, least_used=True), kernels.balance(small, plain, ids, least_used=True)),
        (coloring.color_max_min(own, edges, 8), kernels.color_max_min(small, ids, 8)),
    ):
        assert rows(got) == list(zip(ids.tolist(), want.tolist()))
    hashes = spark.range(-3, 4).select("id", F.xxhash64("id", F.lit(1), F.lit(7)).alias("h")).collect()
    assert kernels.row_hash(np.array([r["id"] for r in hashes]), 1, 7).tolist() == [r["h"] for r in hashes]


def test_star_and_clique_stay_in_small_tasks(spark):
    """A hub of a star that meets a clique: few wedges, chunks of bounded size, and the same answers as by definition."""
    rows = [(0, k, 1.0) for k in range(1, 2001)] + [(a, b, 1.0) for a in range(1, 21) for b in range(a + 1, 21)]
    edges = graph.build_graph(frame(spark, rows))
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {(r["src"], r["dst"]): r["similarity"] for r in metrics.edge_similarity(edges).collect()}
    assert got == {p: pytest.approx(len(near[p[0]] & near[p[1]]) / len(near[p[0]] | near[p[1]])) for a, b, _ in rows for p in ((a, b), (b, a))}
    up = metrics._oriented(edges)
    assert up.groupBy("lo").count().agg(F.max("count")).first()[0] <= 20 and metrics.triangles(edges).count() == 20 * 19 * 18 // 6 + 20 * 19 // 2
    chunks = graph.adjacency_chunks(edges, 100).collect()
    assert max(r["n"] for r in chunks) == 100 and [x for r in sorted((r["chunk"], r["neighbours"]) for r in chunks if r["v"] == 0) for x in r[1]] == list(range(1, 2001))
    kept = graph.sparsify(graph.remove_edges(edges), metrics.edge_similarity(edges)).collect()
    assert sum(r["src"] == 0 for r in kept) == round(2000**0.5)


def test_rcm_raises_rather_than_losing_vertices(spark):
    edges = graph.build_graph(frame(spark, [(i, i + 1, 1.0) for i in range(1, 12)]))
    with pytest.raises(RuntimeError):
        ordering.reverse_cuthill_mckee(vertices_of(spark, range(1, 13)), edges, max_levels=5)


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_rcm(spark):
    edges = graph.build_graph(frame(spark, [(i, i + 1, 1.0) for i in range(1, 9)]))
    rows = ordering.reverse_cuthill_mckee(vertices_of(spark, [*range(1, 10), 50]), edges).collect()
    place = {r["v"]: r["place"] for r in rows}
    assert sorted(place.values()) == list(range(10))
    assert all(abs(place[i] - place[i + 1]) == 1 for i in range(1, 9))


@pytest.mark.parametrize("metric", knn.METRICS)
def test_knn_blocks(spark, metric):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    one = sorted(map(tuple, knn.knn_exact(rows, 5, metric).collect()))
    assert sorted(map(tuple, knn.knn_exact(rows, 5, metric, block_rows=20).collect())) == one
    assert sorted(map(tuple, knn.knn_lists(rows, 5, metric, n_lists=6, probes=6, block_rows=7).collect())) == one
    assert not any(r["src"] == r["dst"] for r in knn.knn_exact(rows, 5, metric, include_self=False).collect())


def test_knn_lists_recall(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 16)) * 4
    x = centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    want = {(r["src"], r["dst"]) for r in knn.knn_exact(rows, 10).collect()}
    got = {(r["src"], r["dst"]) for r in knn.knn_lists(rows, 10).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_pipeline_recovers_clusters(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 10)) * 20
    truth = rng.integers(0, 6, 300)
    rows = spark.createDataFrame([(i + 1, (centers[t] + rng.normal(size=10)).tolist()) for i, t in enumerate(truth)], "id long, features array<double>")
    found = fast_cluster(rows, k=15, distance="euclidian")
    both = found.join(spark.createDataFrame([(i + 1, int(t)) for i, t in enumerate(truth)], "id long, truth int"), "id")
    assert metrics.pair_fscore(both, "truth", "community").first()["precision"] > 0.99
    assert found.count() == 300


def test_empty(spark):
    edges, nodes = frame(spark, []), vertices_of(spark, [1])
    assert assignment(louvain.louvain(nodes, edges)) == {1: -1}
    assert metrics.modularity(edges, spark.createDataFrame([], "v long, community long")).first()[0] is None
    assert knn.knn_exact(spark.createDataFrame([], "id long, features array<double>"), 3).count() == 0


@pytest.mark.parametrize("name, method", [("louvain", "greedy"), ("louvain_balanced", "balanced"), ("louvain_maxmin", "max_min"), ("cluster_pipeline", "greedy")])
def test_queries_colour_the_first_phase_alone(monkeypatch, name, method):
    """As their SQL does, also if more than 1,000 vertices are left after it."""
    held = {}
    monkeypatch.setattr(queries, "_rounded", lambda df, *_: df)
    monkeypatch.setattr(queries.louvain, "louvain", lambda v, e, options: held.update(options=options))
    monkeypatch.setattr(queries, "fast_cluster", lambda data, k, **options: held.update(options=louvain.Options(**options)))
    for part in ("vertices", "edge_table", "features"):
        monkeypatch.setattr(queries, part, lambda *_: None)
    queries.queries()[name](None, None)
    rng = np.random.default_rng(12)
    links = {(min(a, b), max(a, b)): 1.0 for a, b in zip(rng.integers(1, 3600, 3300).tolist(), rng.integers(1, 3600, 3300).tolist()) if a != b}
    rows = [(*pair, w) for a, b in links for pair, w in (((a, b), 1.0), ((b, a), 1.0))]
    ids, label, quality = louvain.run_local(*(np.array(x) for x in zip(*rows)), held["options"])
    con = duckdb.connect()
    arcs = pa.table(dict(zip(("src", "dst", "weight"), map(pa.array, zip(*rows)))))  # noqa: F841
    found = con.execute(f"WITH RECURSIVE edges AS (SELECT * FROM arcs), {loops.louvain(method)} SELECT v, community, modularity FROM found").fetchall()
    assert {v: c for v, c, _ in found} == dict(zip(ids.tolist(), label.tolist()))
    assert all(q == pytest.approx(quality) for *_, q in found)
