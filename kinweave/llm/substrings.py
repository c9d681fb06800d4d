"""Substring dedup with suffix arrays: bytes of strings that a document with a smaller id also has.

A byte goes if a string of ``size`` bytes around it also starts in a document with a smaller id; strings
are judged on the input. Null text counts as empty, null ids come after all others, and equal ids never
remove each other's bytes. Other columns aren't read.

Documents are dealt to buckets by ranges of ids, so that a lower bucket means smaller ids (buckets that share an id count
as equal). A byte can go for either of two reasons.

1. A smaller id of its own bucket has the string. The bucket sorts the suffixes that may begin a maximal repeat, whole up to
   their documents' ends, into an enhanced suffix array and scans the common prefixes with a stack into the interval
   tree. Intervals of ``size`` bytes or more whose occurrences differ in the byte before them are the maximal repeat
   groups, with all their places; each place loses the longest group's bytes that has a smaller id.
2. A lower bucket has it. Strings are far more than documents, so a bucket cuts its texts into cells (see ``cells``) and
   sends each distinct one, as 96 bits, to the shard of its anchor, which tells it whether a lower bucket has the
   cell, and whether the anchor also occurs in other cells. Strings of such open cells are then sent themselves.

A cell or string is sent once by each bucket, however often it occurs there, so a hot one costs a shard at most one entry
for each bucket. An exchange has at most as many rows as entries. A document is held whole by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm import suffixes, textbytes as tb
from kinweave.llm.cells import cells, repeated_starts, string_hashes
from kinweave.llm.dealing import LAST, deal

SIZE = 50
#: Bytes of text for each bucket.
BUCKET_BYTES = 3 << 20
_SHARD_BITS = np.uint64(32)


class Request:
    """Distinct (anchor, rest) hashes of some items, in the order in which they are sent."""

    def __init__(self, key: np.ndarray, rest: np.ndarray, n_shards: int):
        key, rest = key >> np.uint64(16), rest >> np.uint64(16)
        self.order = np.argsort((key << np.uint64(16)) | (rest & np.uint64(0xFFFF)))
        key, rest = key[self.order], rest[self.order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.empty(len(key), np.int64)
        self.group[self.order] = np.cumsum(new) - 1
        self.key, self.rest = key[self.first], rest[self.first]
        shard = (((self.key >> np.uint64(16)) * np.uint64(n_shards)) >> _SHARD_BITS).astype(np.int64)
        self.bounds = np.searchsorted(shard, np.arange(n_shards + 1))

    def rows(self, bucket: int):
        """(shard, bucket, blob) for each shard that gets entries."""
        for shard in np.flatnonzero(np.diff(self.bounds)).tolist():
            at = slice(self.bounds[shard], self.bounds[shard + 1])
            yield shard, bucket, encode(self.key[at], self.rest[at])

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of the items' values for each distinct entry."""
        return np.minimum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]


def encode(key: np.ndarray, rest: np.ndarray) -> bytes:
    """48-bit keys in order as their differences, and 48 bits of rest."""
    steps = np.diff(key, prepend=np.uint64(0))
    width = 4 if int(steps[1:].max(initial=0)) < 1 << 32 else 8
    return np.array([len(key), width], "<u4").tobytes() + key[:1].tobytes() + steps[1:].astype(f"<u{width}").tobytes() + (rest & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (rest >> np.uint64(32)).astype("<u2").tobytes()


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(raw, "<u4", 2).tolist()
    at = 16 + width * (n - 1)
    key = np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 8), np.frombuffer(raw, f"<u{width}", n - 1, 16).astype(np.uint64)]), dtype=np.uint64)
    return key, np.frombuffer(raw, "<u4", n, at).astype(np.uint64) | (np.frombuffer(raw, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32))


def answer(blobs: list[tuple[int, bytes]], order_of: np.ndarray) -> list[tuple[int, bytes]]:
    """For each bucket's entries a byte each: bit 0 if a bucket of lower order has the entry, bit 1 if its key has other entries."""
    blobs = sorted(blobs)
    parts = [decode(raw) for _, raw in blobs]
    key, rest = (np.concatenate(x) for x in zip(*parts))
    sizes = [len(k) for k, _ in parts]
    bucket = np.repeat(order_of[[b for b, _ in blobs]], sizes)
    both = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + rest)
    order = np.argsort(both, kind="stable")
    k, r = key[order], rest[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    flags = np.empty(len(k), np.uint8)
    flags[order] = bucket[order] > np.minimum.reduceat(bucket[order], first)[group]
    owner = np.sort(k[first])
    shared = np.unique(owner[1:][owner[1:] == owner[:-1]])
    if len(shared):
        at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        flags |= (shared[at] == key).astype(np.uint8) << 1
    ends = np.cumsum(sizes)
    return [(b, flags[e - n : e].tobytes()) for (b, _), n, e in zip(blobs, sizes, ends)]


class Bucket:
    """The documents of one bucket, in order of id and text."""

    def __init__(self, table: pa.Table, size: int, n_shards: int):
        table = table.combine_chunks()
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").cast(pa.large_binary()).to_pylist()
        by = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.size, self.n_shards = size, n_shards
        self.ids = [ids[i] for i in by]
        self.rank = np.array([LAST if i is None else i for i in self.ids], np.int64)
        held = [texts[i] or b"" for i in by]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(held), np.uint8)
        self.start, self.count, anchor, whole, self.doc = cells(self.data, self.offsets, size)
        self.cells = Request(anchor, whole, n_shards)
        #: Equal strings lie in cells of equal anchors.
        keys = self.cells.key
        self.anchor_group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))[self.cells.group] if len(keys) else self.cells.group

    def open_strings(self, flags: np.ndarray):
        """(places, documents, request) of the strings in cells that no lower bucket has but whose anchor occurs in other cells. ``flags`` are the answers for distinct cells."""
        places, docs = self._strings(np.flatnonzero((flags[self.cells.group] & 3) == 2))
        return places, docs, Request(*string_hashes(self.data, places, self.size), self.n_shards)

    def _strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and documents of the strings in the chosen cells."""
        count = self.count[chosen]
        begin = np.cumsum(count) - count
        return np.repeat(self.start[chosen] - begin, count) + np.arange(int(count.sum())), np.repeat(self.doc[chosen], count)

    def repeats(self) -> tuple[suffixes.RepeatTree, np.ndarray]:
        """The interval tree of the suffixes that begin a repeat within the bucket, up to their documents' ends, and their documents."""
        again = np.bincount(self.anchor_group) > 1 if len(self.anchor_group) else np.zeros(0, bool)
        places, _ = self._strings(np.flatnonzero(again[self.anchor_group]))
        places = repeated_starts(self.data, self.offsets, places, self.size)
        docs = np.searchsorted(self.offsets, places, "right") - 1
        return suffixes.RepeatTree(self.data, places, self.offsets[docs + 1], self.offsets[docs], self.size), docs

    def removed(self, cell_flags: np.ndarray, group_flags: np.ndarray) -> np.ndarray:
        """True for each byte to remove."""
        change = np.zeros(len(self.data) + 1, np.int32)

        def cover(places: np.ndarray, lengths) -> None:
            np.add.at(change, places, 1)
            np.subtract.at(change, places + lengths, 1)

        tree, docs = self.repeats()
        cover(tree.starts, tree.covered(self.rank[docs]))
        del tree
        lower = (cell_flags[self.cells.group] & 1) > 0
        cover(self.start[lower], self.count[lower] + self.size - 1)
        places, _, request = self.open_strings(cell_flags)
        if len(places):
            cover(places[(group_flags[request.group] & 1) > 0], self.size)
        return np.cumsum(change[:-1]) > 0


def flags_of(answers: pa.Table, round: int) -> np.ndarray:
    """Answers of one round in the order of shards."""
    rows = sorted((r["shard"], r["blob"]) for r in answers.filter(pa.compute.equal(answers.column("round"), round)).to_pylist())
    return np.frombuffer(b"".join(b for _, b in rows), np.uint8)


REQUEST = "shard int, bucket int, round int, blob binary"


def request_table(rows, round: int) -> pa.Table:
    held = [(s, b, round, raw) for s, b, raw in rows]
    names, kinds = ["shard", "bucket", "round", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*held)) or [()] * 4, kinds)], names)


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``spans``, the removed (start, end) in bytes.

    ``bucket_bytes`` bounds what a task holds; a task needs about thirty times as much memory.
    """
    dealing = deal(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), bucket_bytes)
    dealt, order, n_shards = dealing.rows, dealing.order, dealing.n_buckets

    def ask_cells(key, table):
        bucket = Bucket(table, size, n_shards)
        return request_table(bucket.cells.rows(key[0].as_py()), 1)

    def ask_groups(key, table, answers):
        if not table.num_rows:
            return request_table([], 2)
        bucket = Bucket(table, size, n_shards)
        return request_table(bucket.open_strings(flags_of(answers, 1))[2].rows(key[0].as_py()), 2)

    def reply(key, table):
        out = answer([(r["bucket"], r["blob"]) for r in table.select(["bucket", "blob"]).to_pylist()], order)
        return request_table([(key[0].as_py(), b, raw) for b, raw in out], table.column("round")[0].as_py())

    def finish(key, table, answers):
        bucket = Bucket(table, size, n_shards) if table.num_rows else None
        out = []
        if bucket is not None:
            gone = bucket.removed(flags_of(answers, 1), flags_of(answers, 2))
            for d, (a, b) in enumerate(zip(bucket.offsets[:-1].tolist(), bucket.offsets[1:].tolist())):
                mask = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                kept = bucket.data[a:b] if not len(edges) else bucket.data[a:b][~mask]
                spans = [{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()]
                out.append((bucket.ids[d], b - a, int(mask.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    by_bucket = dealt.groupBy("bucket")
    first = by_bucket.applyInArrow(ask_cells, REQUEST).groupBy("shard").applyInArrow(reply, REQUEST)
    second = by_bucket.cogroup(first.groupBy("bucket")).applyInArrow(ask_groups, REQUEST).groupBy("shard").applyInArrow(reply, REQUEST)
    answers = first.union(second)
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])
