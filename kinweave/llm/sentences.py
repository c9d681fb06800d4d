"""Substring dedup by sliding sentence spans: runs of consecutive sentences are hashed and joined globally.

A sentence ends after any of . ! ? , ; : (a clause counts as one), at a line end, and after ``WORDS_IN_SENTENCE`` words,
so that text without punctuation has sentences too. From every sentence the shortest run of at least ``SENTENCES`` of
them with at least ``WORDS`` words is a span; a text without such a run, but with a sentence, is one span as a whole. Of equal
spans the one in the smallest id, and there at the first place, is the first; sentences that any other of them covers
are removed. Spans are judged on the input, so overlapping spans of one document count.

Documents are dealt to buckets by ranges of ids. A bucket emits each distinct span once, as a row of 96 hash bits, and a
window over equal hashes keeps the rows of all but the lowest bucket; these go back to their buckets. So rows are at most
as many as sentences, and a span that a third of all documents share is one row for each bucket. The text is
shuffled once and its exchange reused.

Null and empty texts have no sentences. Null ids come last; repeated ids are ordered by text, and of repeated rows all
but one lose their spans. A document is held whole by one task, with about ten times its size in memory. Other columns
aren't read. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.llm import textbytes as tb
from kinweave.llm.dealing import deal

SENTENCES, WORDS = 2, 20
WORDS_IN_SENTENCE = 12
BUCKET_BYTES = 4 << 20
_SENTENCE = re.compile(rb"[^\x20\x09-\x0D.!?,;:]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D.!?,;:]+){0,%d}[.!?,;:]*" % (WORDS_IN_SENTENCE - 1))


def sentences(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of each sentence in bytes, without blanks at its ends."""
    return [m.span() for m in _SENTENCE.finditer(text)]


class Bucket:
    """Documents of one bucket in order of id and text, and their spans."""

    def __init__(self, table: pa.Table, least: int, words: int):
        table = table.combine_chunks()
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").cast(pa.large_binary()).to_pylist()
        by = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.ids, self.texts = [ids[i] for i in by], [texts[i] or b"" for i in by]
        self.places = [sentences(t) for t in self.texts]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in self.places])]).astype(np.int64)
        held = [t[a:b] for t, p in zip(self.texts, self.places) for a, b in p]
        n_words = np.concatenate([[0], np.cumsum([len(s.split()) for s in held])]).astype(np.int64)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, held)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.begin, self.end = self._spans(n_words, least, words)
        one, two = (self._hashes(digests[:, h]) for h in (0, 1))
        two >>= np.uint64(32)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        self.group = np.empty(len(one), np.int64)
        self.group[order] = np.cumsum(new) - 1
        #: The first place of each distinct span; spans are in order of id and place.
        self.least = np.minimum.reduceat(order, first) if len(first) else first
        self.one, self.two = one[first], two[first]

    def _spans(self, n_words: np.ndarray, least: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(self.first[-1])
        begin = np.arange(n)
        end = np.maximum(begin + least, np.searchsorted(n_words, n_words[:-1] + words, "left"))
        ok = end <= np.repeat(self.first[1:], np.diff(self.first))
        whole = np.flatnonzero((np.diff(self.first) > 0) & (np.diff(np.concatenate([[0], np.cumsum(ok)])[self.first]) == 0))
        begin, end = np.concatenate([begin[ok], self.first[whole]]), np.concatenate([end[ok], self.first[whole + 1]])
        order = np.argsort(begin)
        return begin[order], end[order]

    def _hashes(self, digests: np.ndarray) -> np.ndarray:
        size = self.end - self.begin
        out = tb.mix(size.astype(np.uint64))
        for j in range(int(size.max(initial=0))):
            at = np.flatnonzero(size > j)
            out[at] = tb.combine(out[at], digests[self.begin[at] + j])
        return out

    def removed(self, later: np.ndarray) -> np.ndarray:
        """True for each sentence that a span other than the first covers; ``later`` marks distinct spans that a lower bucket has."""
        gone = (np.arange(len(self.group)) > self.least[self.group]) | later[self.group]
        change = np.zeros(self.first[-1] + 1, np.int64)
        np.add.at(change, self.begin[gone], 1)
        np.subtract.at(change, self.end[gone], 1)
        return np.cumsum(change[:-1]) > 0


def dedup_sentences(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_sentences, n_removed, kept_sha256 (of the kept sentences, one a line), and ``spans``, the removed (start, end) in bytes."""
    by_bucket = deal(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), bucket_bytes).rows.groupBy("bucket")

    def ask(key, table):
        bucket = Bucket(table, least, words)
        return pa.table([pa.array(np.full(len(bucket.one), key[0].as_py(), np.int32)), pa.array(bucket.one.view(np.int64)), pa.array(bucket.two.astype(np.uint32).view(np.int32))], ["bucket", "one", "two"])

    def finish(key, table, later):
        out = []
        if table.num_rows:
            bucket = Bucket(table, least, words)
            join = lambda one, two: tb.mix(one + two * np.uint64(0x9E3779B97F4A7C15))
            known = join(later.column("one").to_numpy().view(np.uint64), later.column("two").to_numpy().view(np.uint32).astype(np.uint64))
            gone = bucket.removed(np.isin(join(bucket.one, bucket.two), known))
            for d, places in enumerate(bucket.places):
                mine = gone[bucket.first[d] : bucket.first[d + 1]].tolist()
                kept = hashlib.sha256(b"\n".join(bucket.texts[d][a:b] for (a, b), g in zip(places, mine) if not g)).hexdigest()
                out.append((bucket.ids[d], len(places), sum(mine), kept, [{"start": a, "end": b} for (a, b), g in zip(places, mine) if g]))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], ["doc_id", "n_sentences", "n_removed", "kept_sha256", "spans"])

    spans = by_bucket.applyInArrow(ask, "bucket int, one long, two int")
    lowest = F.min("bucket").over(Window.partitionBy("one", "two"))
    later = spans.withColumn("lowest", lowest).where("bucket > lowest").select("bucket", "one", "two")
    return by_bucket.cogroup(later.groupBy("bucket")).applyInArrow(finish, "doc_id long, n_sentences long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")
