"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified on hits.

Texts are reduced to lower-case words of letters, digits and non-ASCII bytes. Every run of ``n``
consecutive words of a benchmark item is a window; an item of fewer words, but not none, is one window.
A scan of the documents looks the hashes of its word windows up in the set, compares the words of each
hit, and marks the words inside verified windows.

The set is broadcast only while the index's own size is at most ``broadcast_bytes``. A larger benchmark
is dealt by hash into blocks below that bound; the documents are then marked by one block after the
other, each pass written to the shared folder, so that memory stays bounded at any size. Marks are on the whole texts, so
the blocks don't change a result.

Null text has no words. Items with a null id mark words but aren't listed; repeated item ids count once.
Repeated documents are marked each on its own. Other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kinweave.llm import textbytes as tb
from kinweave.llm.rows import numbered
from kinweave.plans.scratch import materialize

BROADCAST_BYTES = 64 << 20
#: Memory of an index for each word, and windows whose bytes are compared at once.
_WORD_BYTES, _VERIFY = 64, 4096


class WindowIndex:
    """All windows of some items, by length: distinct windows by hash, with the place of one occurrence and the items of all."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        data, offsets = tb.text_bytes(pa.array([text for _, text in items], pa.string()))
        self.data = tb.lower(data)
        self.starts, self.ends, first = tb.word_spans(self.data, offsets, tb.ALNUM)
        self.names = [item for item, _ in items]
        hashes = tb.word_hashes(self.data, self.starts, self.ends)
        self.vocabulary = np.unique(hashes)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(items)), counts)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts, n)).tolist():
            if not size:
                continue
            fits = np.minimum(counts, n)[item] == size
            at = np.flatnonzero(fits & (np.arange(len(item)) + size <= first[1:][item]))
            one, two = tb.combine(*(hashes[at + j] for j in range(size))), tb.combine(*(~hashes[at + j] for j in range(size)))
            order = np.lexsort((item[at], two, one))
            at, one, two = at[order], one[order], two[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            begin = np.flatnonzero(new)
            self.by_size[size] = (one[begin], at[begin], np.append(begin, len(at)), item[at].astype(np.int32))

    def same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, here: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words at ``here`` of a text have the bytes of those at ``there`` of the items."""
        words = np.arange(size)
        a, b = here[:, None] + words, there[:, None] + words
        lengths = ends[a] - starts[a]
        ok = (lengths == self.ends[b] - self.starts[b]).all(1)
        for lo in range(0, len(here), _VERIFY):
            rows = lo + np.flatnonzero(ok[lo : lo + _VERIFY])
            if not len(rows):
                continue
            n = lengths[rows].ravel()
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            equal = data[np.repeat(starts[a[rows]].ravel(), n) + place] == self.data[np.repeat(self.starts[b[rows]].ravel(), n) + place]
            ok[rows] = np.logical_and.reduceat(equal, begin).reshape(-1, size).all(1)
        return ok


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def mark(data: np.ndarray, offsets: np.ndarray, index: WindowIndex):
    """For documents in ``data``: word spans, first words, a hit flag for each word, items found for each document."""
    data = tb.lower(data)
    starts, ends, first = tb.word_spans(data, offsets, tb.ALNUM)
    hit, items = np.zeros(len(starts), bool), [set() for _ in range(len(offsets) - 1)]
    hashes = tb.word_hashes(data, starts, ends)
    known = _among(hashes, index.vocabulary)
    doc = tb.spread(first, len(starts))
    for size, (table, places, bounds, owners) in index.by_size.items():
        if len(starts) < size:
            continue
        m = len(starts) - size + 1
        run = np.concatenate([[0], np.cumsum(known)])
        at = np.flatnonzero((run[size:] - run[:m] == size) & (doc[size - 1 :] == doc[:m]))
        if not len(at):
            continue
        keys = tb.combine(*(hashes[at + j] for j in range(size)))
        low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        # Windows of equal hash but other words are told apart by their bytes.
        window = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        at = np.repeat(at, high - low)
        ok = index.same(data, starts, ends, at, places[window], size)
        at, window = at[ok], window[ok]
        for j in range(size):
            hit[at + j] = True
        found = np.unique(doc[at] * np.int64(len(places)) + window)
        for d, w in zip((found // len(places)).tolist(), (found % len(places)).tolist()):
            items[d].update(owners[bounds[w] : bounds[w + 1]].tolist())
    return starts, ends, first, hit, [{index.names[i] for i in mine} - {None} for mine in items]


def _indexes(benchmark: DataFrame, item: str, text: str, n: int, bound: int) -> Iterator[tuple[bool, WindowIndex]]:
    """(whether it is the last, index) for each block of items; an index takes about ``_WORD_BYTES`` for each word beside the text.

    Items are dealt by hash of their texts; an item is never split, so one that is larger than the bound makes an index of its size.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    words = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    size = rows.select(F.sum(F.octet_length("t") + _WORD_BYTES * words)).first()[0] or 0
    n_blocks = max(1, math.ceil(2 * size / bound)) if size > bound else 1
    for b in range(n_blocks):
        block = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == b)
        yield b == n_blocks - 1, WindowIndex([(r["i"], r["t"]) for r in block.toLocalIterator()], n)


def find_hits(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items (sorted array), items_sha256, contaminated."""
    spark = docs.sparkSession
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = base.schema
    for k, (_, index) in enumerate(_indexes(benchmark, item, item_text, n, broadcast_bytes)):
        held = spark.sparkContext.broadcast(index)
        base = materialize(base, "hits") if k else base

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = tb.text_bytes(batch.column(1))
                for a, b in tb.blocks(offsets):
                    lo, hi = offsets[a], offsets[b]
                    _, _, first, hit, items = mark(data[lo:hi], offsets[a : b + 1] - lo, held.value)
                    packed = [np.packbits(hit[i:j]) for i, j in zip(first[:-1], first[1:])]
                    before = batch.slice(a, b - a)
                    old = before.column(2).to_pylist()
                    packed = [p.tobytes() if o is None else (p | np.frombuffer(o, np.uint8)).tobytes() for p, o in zip(packed, old)]
                    both = [sorted(x | set(y)) for x, y in zip(items, before.column(3).to_pylist())]
                    yield pa.RecordBatch.from_arrays([before.column(0), before.column(1), pa.array(packed, pa.binary()), pa.array(both, pa.list_(pa.string()))], ["doc_id", "text", "hits", "items"])

        base = base.mapInArrow(scan, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column(1))
            words = np.concatenate([np.diff(tb.word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tb.ALNUM)[2]) for a, b in tb.blocks(offsets)] or [np.empty(0, np.int64)])
            hits = [int(np.unpackbits(np.frombuffer(x or b"", np.uint8)).sum()) for x in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(map(len, items), pa.int64()), batch.column(3), pa.array(sha, pa.string()), pa.array([x > 0 for x in hits], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return base.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, mode: str = "document", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated rows (mode "document") or without the hit words (mode "span").

    All columns stay. In mode "span" the bytes from the first to the last word of each hit run go and
    the rest of the text stays as it is.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode is 'document' or 'span'")
    spark, at, plain = docs.sparkSession, docs.columns.index(text), numbered(docs)
    names, out = plain.columns, None
    for last, index in _indexes(benchmark, item, item_text, n, broadcast_bytes):
        held = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], held=held, last=last, before=out is not None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = tb.text_bytes(batch.column(at))
                for a, b in tb.blocks(offsets):
                    lo, hi = offsets[a], offsets[b]
                    starts, ends, first, hit, _ = mark(data[lo:hi], offsets[a : b + 1] - lo, held.value)
                    part = batch.slice(a, b - a)
                    if before:
                        for d, old in enumerate(part.column(len(names)).to_pylist()):
                            hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(old, np.uint8), count=first[d + 1] - first[d]).astype(bool)
                    columns = [part.column(i) for i in range(len(names))]
                    if not last:
                        packed = pa.array([np.packbits(hit[i:j]).tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
                        yield pa.RecordBatch.from_arrays([*columns, packed], [*names, "marks"])
                        continue
                    dirty = [bool(hit[i:j].any()) for i, j in zip(first[:-1], first[1:])]
                    if mode == "document":
                        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([not x for x in dirty], pa.bool_()))
                        continue
                    texts = columns[at].to_pylist()
                    for d in np.flatnonzero(dirty):
                        keep = np.ones(offsets[a + d + 1] - offsets[a + d], bool)
                        base, flags = offsets[a + d] - lo, hit[first[d] : first[d + 1]]
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                        for i, j in zip(edges[::2], edges[1::2]):
                            keep[starts[first[d] + i] - base : ends[first[d] + j - 1] - base] = False
                        texts[d] = data[lo + base : lo + base + len(keep)][keep].tobytes().decode()
                    columns[at] = pa.array(texts, columns[at].type)
                    yield pa.RecordBatch.from_arrays(columns, names)

        schema = plain.schema if last else StructType([*plain.schema.fields, StructField("marks", BinaryType())])
        out = (plain if out is None else materialize(out, "marks")).mapInArrow(clean, schema)
    return out.toDF(*docs.columns)
