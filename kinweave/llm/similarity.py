"""SimHash near-duplicates at a similarity: texts link if the Jaccard similarity of their sets of word shingles reaches it.

Fingerprints only propose: two sets are candidates if at most ``TAU`` of 128 fingerprint bits differ, which the
generalised pigeonhole search of ``simhash`` finds without loss. Every link is then verified on the sets. Of pairs at a
similarity of 0.8 or more the fingerprints propose about 99 in 100 (the README has figures); what they propose grows with
the radius and not with the similarity, so a radius for other similarities has to be measured.

Work is on distinct sets, so copies never meet. Sets that candidates connect are compared in one task up to
``block_shingles`` shingles; more are dealt into blocks and each pair of blocks is its own task. A task returns
edges with the components of its links, fewer than it has sets. The text of sets without a candidate isn't read again.

Texts without words have the empty set and are alike; null counts as empty. An id of -2**63 counts as null. Rows of equal
id and text are one. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from kinweave.llm import textbytes as tb
from kinweave.llm.rows import whole_row
from kinweave.llm.simhash import BUCKET_ROWS, _runs, link_edges, majority, shingle_hashes
from kinweave.operators.components import connected_components
from kinweave.plans.scratch import materialize

#: Stands for a null id where one is joined on.
NO_ID = -(1 << 63)
#: Bits of 128 in which candidates may differ.
TAU = 26
BLOCK_SHINGLES = 1 << 19


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def set_prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two fingerprint words of each set of shingle hashes."""
    counts, hashes = np.array([len(s) for s in sets]), np.concatenate([np.empty(0, np.uint64), *sets])
    return majority(hashes, counts), majority(tb.mix(hashes + np.uint64(1)), counts)


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that link, with the same components as all such pairs."""
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    mark, left = np.zeros(len(names), bool), np.ones(len(sets), bool)
    live, live_owner = ids, owner
    empty = np.empty(0, np.int64)
    out = [(empty, empty)]
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            x = queue.pop()
            own = ids[bounds[x] : bounds[x + 1]]
            mark[own] = True
            common = np.bincount(live_owner[mark[live]], minlength=len(sets))
            mark[own] = False
            found = np.flatnonzero(left & (common >= similarity * (sizes[x] + sizes - common) - 1e-9))
            left[found] = False
            queue += found.tolist()
            out.append((np.full(len(found), x), found))
            if 2 * sizes[left].sum() < len(live):
                keep = left[live_owner]
                live, live_owner = live[keep], live_owner[keep]
    return tuple(np.concatenate(x) for x in zip(*out))


def row_key(id: Column, text: Column) -> list[Column]:
    """r_id, r_one and r_two: equal for rows of equal id and text, null or not."""
    return [F.coalesce(id.cast("long"), F.lit(NO_ID)).alias("r_id"), F.xxhash64(text).alias("r_one"), F.xxhash64(F.lit(1), text).alias("r_two")]


ROW_KEY = ["r_id", "r_one", "r_two"]


def _prints(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, the row key, node (a hash of the set), its size and its fingerprint words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingle_set(t.as_py() or b"", shingle) for t in part.column(4).cast(pa.large_binary())]
                nodes = np.array([xxh64_intdigest(s.astype("<u8").tobytes(), 7) for s in sets], np.uint64)
                words = [pa.array(x.view(np.int64)) for x in (nodes, *set_prints(sets))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(4)), words[0], pa.array([len(s) for s in sets], pa.int64()), *words[1:]], ["doc_id", *ROW_KEY, "node", "size", "fp", "fp2"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), *row_key(F.col(id), F.col(text)), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, r_id long, r_one long, r_two long, node long, size long, fp long, fp2 long")


def _verified(docs: DataFrame, candidates: DataFrame, id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) of the links among candidates of an equal group."""
    rows = docs.select(*row_key(F.col(id), F.col(text)), F.col(text).alias("text"))
    order = ["group", "bi", "bj"]
    dealt = rows.join(candidates, ROW_KEY).select(*order, "node", "text").repartition(*order).sortWithinPartitions(*order, "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in range(4)], axis=1)
            texts = batch.column(4).cast(pa.large_binary())
            edges = _runs(keys[:, :3])
            for a, b in zip(edges[:-1], edges[1:]):
                if tuple(keys[a, :3]) != last:
                    if len(sets) > 1:
                        yield found(nodes, sets)
                    last, nodes, sets = tuple(keys[a, :3]), [], []
                for i in range(a, b):
                    if not nodes or nodes[-1] != keys[i, 3]:
                        nodes.append(keys[i, 3])
                        sets.append(shingle_set(texts[i].as_py() or b"", shingle))
        if len(sets) > 1:
            yield found(nodes, sets)

    def found(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        u, v = similar_links(sets, similarity)
        held = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(held[u]), pa.array(held[v])], ["u", "v"])

    return dealt.mapInArrow(link, "u long, v long")


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, tau: int = TAU, block_shingles: int = BLOCK_SHINGLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each document: doc_id, the row key, root (of its component) and component_id (its component's least doc_id)."""
    prints = materialize(_prints(docs, id, text, shingle), "prints")
    first = F.min(F.struct(*ROW_KEY)).alias("row")
    distinct = materialize(prints.groupBy("node").agg(first, F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("fp2").alias("fp2"), F.min("doc_id").alias("least_id")), "distinct")
    near = connected_components(materialize(link_edges(distinct, distinct.count(), tau, True, bucket_rows), "candidates"))
    members = near.select("v", "component").union(near.select(F.col("component").alias("v"), "component").distinct())
    members = materialize(distinct.join(members, F.col("node") == F.col("v")).select("node", "row.*", "size", F.col("component").alias("group")), "members")
    blocks = members.groupBy(F.col("group").alias("b_group")).agg(F.ceil(F.sum("size") / block_shingles).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    members = members.join(blocks, F.col("group") == F.col("b_group")).select("node", *ROW_KEY, "group", "n_blocks", block.alias("block"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).where("n_blocks = 1 OR block <> other")
    members = members.select("node", *ROW_KEY, "group", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    links = materialize(_verified(docs, materialize(members, "dealt"), id, text, shingle, similarity), "links")
    reached = connected_components(links)
    classes = distinct.join(reached, F.col("node") == F.col("v"), "left").select("node", "least_id", F.coalesce("component", "node").alias("root"))
    names = classes.groupBy(F.col("root").alias("n_root")).agg(F.min("least_id").alias("component_id"))
    named = classes.join(names, F.col("root") == F.col("n_root")).select(F.col("node").alias("c_node"), "root", "component_id")
    return prints.join(named, F.col("node") == F.col("c_node")).select("doc_id", *ROW_KEY, "root", "component_id")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component of ``similar_documents`` with these options, with all columns: that of the least id; of rows sharing it, the least text.

    In a component whose ids are all null the least text stays. Components are told apart by their root, so neither a
    null id nor a repeated one joins them.
    """
    classes = similar_documents(docs, id, text, **options).where("doc_id <=> component_id")
    firsts = materialize(classes.select("root", *ROW_KEY).distinct(), "firsts")
    roots = firsts.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(*ROW_KEY)).alias("key"))
    several = roots.where("n > 1").select(F.col("root").alias("s_root"))
    tied = materialize(firsts.join(several, F.col("root") == F.col("s_root"), "left_semi"), "tied")
    texts = docs.select(*row_key(F.col(id), F.col(text)), F.col(text).alias("text")).join(tied, ROW_KEY)
    least = texts.groupBy("root").agg(F.min(F.struct(F.col("text").isNull().alias("empty"), "text", *ROW_KEY)).alias("key"))
    chosen = materialize(roots.where("n = 1").select(*(f"key.{c}" for c in ROW_KEY)).union(least.select(*(f"key.{c}" for c in ROW_KEY))), "chosen")
    names = docs.columns
    rows = docs.select(*row_key(F.col(id), F.col(text)), whole_row(docs).alias("row")).join(chosen, ROW_KEY)
    one = rows.groupBy(*ROW_KEY).agg(F.first("row").alias("row"))
    return one.select(*(F.col("row")[name].alias(name) for name in names))
