"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit for each of 64 positions that is set in over half of the XXH64 hashes of its
word shingles. Two fingerprints link if at most ``tau`` bits differ; a component is what links reach.

The 64 bits are dealt into m partitions, correlated bits together, and partition i gets a threshold t_i
(-1 leaves it out) with sum(t_i + 1) = tau + 1: then any two fingerprints within tau differ in at most t_i
bits of some partition i. A bounded sample of fingerprints gives the share of pairs within each distance
in a partition; dynamic programming over these estimates chooses the thresholds with the least cost, for each
m, and the cheapest m wins. The plan only changes the cost: every choice finds all links.

A wide fingerprint has 64 further bits from a second hash of each shingle; all 128 are partitioned alike. The number of
probes and comparisons grows with ``tau``: the work is linear for a few bits and nears all pairs for a fifth of them.

Work is on distinct fingerprints, so exact copies never meet. Each is sent to the bucket of its own value
in each partition, and to those within t_i that are smaller, as a probe. A bucket's members are compared in
one task up to ``bucket_rows`` of them; a larger one is dealt into blocks and each pair of blocks is its
own task. A task returns the links of small buckets, and for larger ones an edge from each member to the
least one that it is linked with through the bucket: never all pairs.

Texts without words have fingerprint zero and link like any other; null counts as empty. Repeated rows and
ids share a component. A null id never names a component that has another id. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from kinweave.llm import textbytes as tb
from kinweave.operators.components import connected_components
from kinweave.plans.scratch import materialize

SAMPLE_PRINTS = 2000
BUCKET_ROWS = 16384
#: Measured costs of a row sent to a bucket (made, shuffled, sorted and read) and of a comparison, in microseconds.
_SEND, _COMPARE = 5.0, 0.003
_SMALL = 16
_LOWER = bytes(tb._LOWER)


def shingle_hashes(text: bytes, size: int = 4) -> list[int]:
    """XXH64 of every run of ``size`` words; of all words if there are fewer; nothing without words."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, 42)] if words else []
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    return list(map(xxh64_intdigest, [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :])], repeat(42)))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.uint32)
        out[full] = np.packbits(2 * sums > counts[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, more: bool = False) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and fp2, its 64 further bits (0 without ``more``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 128):
                held = [shingle_hashes(t.as_py() or b"", shingle) for t in texts[at : at + 128]]
                counts = np.array([len(h) for h in held])
                hashes = np.array([x for h in held for x in h], np.uint64)
                prints = majority(hashes, counts)
                second = majority(tb.mix(hashes + np.uint64(1)), counts) if more else np.zeros(len(counts), np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 128), pa.array(prints.view(np.int64)), pa.array(second.view(np.int64))], ["doc_id", "fp", "fp2"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, "doc_id long, fp long, fp2 long")


def packed(prints: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The bits of ``part`` of each row of words, side by side."""
    out = np.zeros(len(prints), np.uint64)
    for k, bit in enumerate(part.tolist()):
        out |= ((prints[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)) << np.uint64(k)
    return out


class Plan:
    """Partitions (arrays of bit positions) and their thresholds."""

    def __init__(self, parts: list[np.ndarray], thresholds: list[int]):
        used = [(p, t) for p, t in zip(parts, thresholds) if t >= 0]
        self.parts, self.thresholds = [p for p, _ in used], [t for _, t in used]

    def values(self, prints: np.ndarray, i: int) -> np.ndarray:
        """The bits of partition i of fingerprints (rows of words), packed."""
        return packed(prints, self.parts[i])

    def masks(self, i: int) -> np.ndarray:
        """Nonzero differences within the threshold."""
        bits = range(len(self.parts[i]))
        return np.array([sum(1 << b for b in c) for t in range(1, self.thresholds[i] + 1) for c in combinations(bits, t)], np.uint64)


def group_bits(prints: np.ndarray, m: int) -> list[np.ndarray]:
    """m partitions of nearly equal width; each grows by the bit most correlated with those it has."""
    bits = ((prints[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    n_bits = 64 * bits.shape[1]
    bits = bits.reshape(len(bits), n_bits)
    bits -= bits.mean(0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(0)) + 1e-9
    related = np.abs(bits.T @ bits) / norm[:, None] / norm
    np.fill_diagonal(related, 0)
    free, parts = set(range(n_bits)), []
    for i in range(m):
        width = (n_bits - sum(map(len, parts))) // (m - i)
        own = [max(sorted(free), key=lambda b: related[b, sorted(free)].max())]
        free.discard(own[0])
        while len(own) < width:
            own.append(max(sorted(free), key=lambda b: related[b, own].mean()))
            free.discard(own[-1])
        parts.append(np.array(sorted(own)))
    return parts


def pair_shares(prints: np.ndarray, part: np.ndarray, most: int) -> list[float]:
    """The share of pairs that differ in at most t bits of ``part``, for t up to ``most``: the larger of the sample's and a uniform one's."""
    width = len(part)
    uniform = [sum(math.comb(width, d) for d in range(t + 1)) / 2**width for t in range(most + 1)]
    if len(prints) < 2:
        return uniform
    held = packed(prints, part)
    counts = np.zeros(65, np.int64)
    for i in range(len(held) - 1):
        counts += np.bincount(np.bitwise_count(held[i + 1 :] ^ held[i]), minlength=65)
    share = np.cumsum(counts) / counts.sum()
    return [max(float(share[t]), uniform[t]) for t in range(most + 1)]


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 and the least sum of costs[i][t_i + 1], by dynamic programming."""
    best = {0: (0.0, [])}
    for cost in costs:
        best = {s: min((v + cost[k], [*t, k - 1]) for u, (v, t) in best.items() if 0 <= (k := s - u) < len(cost)) for s in range(tau + 2) if any(0 <= s - u < len(cost) for u in best)}
    return best[tau + 1]


def make_plan(prints: np.ndarray, n: int, tau: int, most_threshold: int = 2, bucket_rows: int = BUCKET_ROWS) -> Plan:
    """The cheapest plan for n distinct fingerprints of which ``prints`` is a sample; rows of split buckets are sent once for each block."""
    found = []
    fewest = -(-(tau + 1) // (most_threshold + 1))
    for m in sorted({min(tau + 1, fewest + more) for more in (0, 1, 2, 4, 8)}):
        parts, costs = group_bits(prints, m), []
        for part in parts:
            shares = pair_shares(prints, part, most_threshold)
            probes = [1 + sum(math.comb(len(part), d) for d in range(1, t + 1)) / 2 for t in range(most_threshold + 1)]
            blocks = [math.ceil(n * p / 2 ** len(part) / bucket_rows) for p in probes]
            costs.append([0.0] + [_SEND * n * p * b + _COMPARE * n * n / 2 * s for p, b, s in zip(probes, blocks, shares)])
        cost, thresholds = allocate(costs, tau)
        found.append((cost, m, Plan(parts, thresholds)))
    return min(found, key=lambda x: x[:2])[2]


def _runs(keys: np.ndarray) -> np.ndarray:
    """First rows of runs of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


def _linked(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Whether fingerprints (words along the last axis) link."""
    differ = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for word in range(1, a.shape[-1]):
        differ += np.bitwise_count(a[..., word] ^ b[..., word])
    return differ <= tau


def _classes(prints: np.ndarray, own: np.ndarray, side: np.ndarray | None, tau: int) -> np.ndarray:
    """The least row that each row reaches by links with a member in ``own``; with ``side`` only links between sides count."""
    label = np.arange(len(prints))
    members = np.flatnonzero(own)
    step = max(1, (1 << 20) // max(1, len(prints)))
    for at in range(0, len(members), step):
        rows = members[at : at + step]
        near = _linked(prints[rows][:, None], prints[None], tau)
        if side is not None:
            near &= side[rows][:, None] != side[None]
        near[np.arange(len(rows)), rows] = False
        for i in np.flatnonzero(near.any(1)):
            found = np.unique(label[np.append(np.flatnonzero(near[i]), rows[i])])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    return label


def bucket_links(keys: np.ndarray, prints: np.ndarray, own: np.ndarray, block: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link, or of a row and the least that it reaches, within runs of equal keys (partition, value, block i, block j).

    ``own`` marks rows whose own value is the bucket's; if blocks i and j differ only links between them count.
    """
    edges = _runs(keys)
    sizes = np.diff(edges)
    run = np.repeat(np.arange(len(sizes)), sizes)
    cross = keys[:, 2] != keys[:, 3]
    small = (sizes <= _SMALL)[run]
    empty = np.empty(0, np.int64)
    out = [(empty, empty)]
    for lag in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero((run[:-lag] == run[lag:]) & small[:-lag])
        if not len(i):
            break
        ok = _linked(prints[i], prints[i + lag], tau) & (~cross[i] | (block[i] != block[i + lag]))
        out.append((i[ok], i[ok] + lag))
    for r in np.flatnonzero(sizes > _SMALL):
        a, b = edges[r], edges[r + 1]
        label = _classes(prints[a:b], own[a:b], block[a:b] if cross[a] else None, tau)
        moved = np.flatnonzero(label != np.arange(b - a))
        out.append((a + label[moved], a + moved))
    return tuple(np.concatenate(x) for x in zip(*out))


def link_edges(prints: DataFrame, n: int, tau: int = 4, wide: bool = False, bucket_rows: int = BUCKET_ROWS, sample_prints: int = SAMPLE_PRINTS) -> DataFrame:
    """Edges (u, v) between nodes of distinct (node, fp, fp2) whose components are those of all links; fp2 counts if ``wide``."""
    spark, n_words = prints.sparkSession, 2 if wide else 1
    picked = prints.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // sample_prints))) == 0).limit(2 * sample_prints).collect()
    plan = make_plan(np.array([(r["fp"], r["fp2"])[:n_words] for r in picked], np.int64).reshape(-1, n_words).view(np.uint64), n, tau, bucket_rows=bucket_rows)
    held = spark.sparkContext.broadcast(plan)
    names = ["node", "fp", "fp2"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = [batch.column(c).slice(at, 1024).to_numpy(zero_copy_only=False) for c in range(3)]
                words = np.stack(rows[1 : 1 + n_words], 1).view(np.uint64)
                for i in range(len(plan.parts)):
                    values = plan.values(words, i)
                    masks = np.concatenate([np.zeros(1, np.uint64), plan.masks(i)])
                    keys = values[:, None] ^ masks
                    keep = keys <= values[:, None]
                    who = np.nonzero(keep)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), i, np.int32)), pa.array(keys[keep].view(np.int64)), pa.array(keys[keep] == values[who]), *(pa.array(x[who]) for x in rows)], ["part", "value", "own", *names])

    sent = prints.select(*names).mapInArrow(send, "part int, value long, own boolean, node long, fp long, fp2 long")
    hot = sent.groupBy(F.col("part").alias("h_part"), F.col("value").alias("h_value")).agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_rows)
    hot = hot.select("h_part", "h_value", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("n_blocks"))
    placed = sent.join(hot, (F.col("part") == F.col("h_part")) & (F.col("value") == F.col("h_value")), "left")
    n_blocks = F.coalesce(F.col("n_blocks"), F.lit(1))
    block = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    placed = placed.select("part", "value", "own", *names, block.alias("block"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    placed = placed.select("part", "value", "own", *names, "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    order = ["part", "value", "bi", "bj"]
    dealt = placed.repartition(*order).sortWithinPartitions(*order, "node").select(*order, "block", "own", *names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in range(9)], axis=1)
            rows = rows if kept is None else np.concatenate([kept, rows])
            last = _runs(rows[:, :4])[-2] if len(rows) else 0
            kept, rows = rows[last:], rows[:last]
            if len(rows):
                yield found(rows)
        if kept is not None and len(kept):
            yield found(kept)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        u, v = bucket_links(rows[:, :4], np.ascontiguousarray(rows[:, 7 : 7 + n_words]).view(np.uint64), rows[:, 5] == 1, rows[:, 4], tau)
        return pa.RecordBatch.from_arrays([pa.array(rows[u, 6]), pa.array(rows[v, 6])], ["u", "v"])

    return dealt.mapInArrow(link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, tau: int = 4, wide: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id (its component's least doc_id)."""
    prints = fingerprints(docs, id, text, shingle, wide)
    node = F.xxhash64("fp", "fp2") if wide else F.col("fp")
    prints = materialize(prints.withColumn("node", node), "prints")
    distinct = materialize(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("doc_id").alias("least_id")), "distinct")
    edges = materialize(link_edges(distinct, distinct.count(), tau, wide, bucket_rows), "links")
    reached = connected_components(edges)
    classes = distinct.join(reached, F.col("node") == F.col("v"), "left").select("node", "least_id", F.coalesce("component", "node").alias("root"))
    names = classes.groupBy(F.col("root").alias("n_root")).agg(F.min("least_id").alias("component_id"))
    named = classes.join(names, F.col("root") == F.col("n_root")).select(F.col("node").alias("c_node"), "component_id")
    return prints.join(named, F.col("node") == F.col("c_node")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
