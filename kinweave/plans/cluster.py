"""The whole pipeline: features to communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.operators.descent import knn_descent
from kinweave.operators.graph import build_graph
from kinweave.operators.knn import knn_exact, knn_lists
from kinweave.operators.links import dedup_links, jaccard_links
from kinweave.operators.louvain import Options, louvain
from kinweave.plans.scratch import materialize


def fast_cluster(
    data: DataFrame,
    k: int = 30,
    num_threads: int = 1,
    distance: str = "l2",
    M: int = 16,
    ef_construction: int = 200,
    ef: int | None = None,
    verbose: bool = False,
    progress: str | None = "bar",
    grain_size: int = 1,
    coloring: int = 1,
    min_graph_size: int = 1000,
    num_colors: int = 16,
    c_thresh: float = 1e-6,
    threshold: float = 1e-9,
    sync_type: int = 0,
    basic_opt: int = 1,
    neighbors: str = "exact",
) -> DataFrame:
    """id, community and modularity from rows of id (from 1) and features.

    Neighbours are exact at every size unless ``neighbors`` is "descent" (``knn_descent``, whose lists are ``ef`` long) or
    "lists": then ``ef`` (at least k, at most the rows) sets how many lists a row searches and ``ef_construction`` how many rows there are to a list, and their recall has to be measured
    (``knn_exact`` on a sample of queries); ``M`` is accepted for compatibility, as are
    ``num_threads``, ``grain_size``, ``verbose``, ``progress`` and ``basic_opt``: Spark's own settings decide.
    """
    rows = materialize(data.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")), "features")
    n = rows.count()
    ef_construction, ef = min(max(k, ef_construction), n), min(max(k, ef or k), n)
    if neighbors not in ("exact", "lists", "descent"):
        raise ValueError("neighbors is 'exact', 'lists' or 'descent'")
    if neighbors == "exact":
        near = knn_exact(rows, min(k, max(n, 1)), distance)
    elif neighbors == "descent":
        near = knn_descent(rows, k, distance, width=max(ef, k + k // 2, 24))
    else:
        near = knn_lists(rows, k, distance, n_lists=max(1, n // max(1, ef_construction)), probes=max(4, ef // 4))
    links = dedup_links(jaccard_links(near))
    edges = build_graph(links)
    options = Options(coloring=coloring, sync=sync_type if coloring == 0 else 0, min_graph_size=min_graph_size, num_colors=num_colors, c_threshold=c_thresh, threshold=threshold)
    found = louvain(rows.select(F.col("id").alias("v")), edges, options)
    return found.select(F.col("v").alias("id"), "community", "modularity")
