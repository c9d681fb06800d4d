"""Language-model scores from an n-gram trie in Elias-Fano code, learned from all training documents.

The model is an interpolated bigram model with absolute discounting over additive unigrams:

    p(w | v) = max(c(v w) - D, 0) / c(v) + D * t(v) / c(v) * p(w),    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

where t(v) is the number of different words after v; after an unseen v it is p(w). A text is its words in
lower case and one end; the first word follows a start.

The model grows with the corpus, so no task holds it whole. A first pass counts words, which gives N and V. Documents are
dealt to buckets by hash. A bucket sends each distinct context with its distinct successors and their training
counts to the shard of the context. A shard sums the counts, writes its part of the trie to a file of its own, maps it
into memory and answers the buckets: c and the back-off weight of its contexts and the discounted probability of each
pair. A context is a word too, so c(v) also gives the unigram counts. A bucket then scores its documents. A bucket
and a shard exchange nothing if they share no context, so an exchange has at most as many rows as contexts.

The trie has three levels: the contexts' hashes, monotone pointers to the successors of each, and the successors, relative
to their context, as one monotone sequence; a context's range comes from two selects of pointers, and what its
successors are relative to from a select of the successor before the range. Beside the levels stand the smoothed log
probabilities max(c(v w) - D, 0) / c(v) of the pairs and the back-off weights D * t(v) / c(v) of the contexts, both
quantised to 16 bits, within ``STEP / 2`` of the logarithm. A pair is found by successor search within its range.

A context with so many of all words that it would fill a shard is split by its successors into parts, each a context of
its own that is sent the whole c; the parts' back-off weights add up. All counts come from all documents.

Null text is empty and has the end alone. Documents with a null id are scored but not learned from, and
aren't held out. Repeated rows count and are scored each on its own; rows equal in id and text share a bucket, and a
document is held whole by one task. Other columns aren't read. An empty table has no rows.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm import textbytes as tb
from kinweave.llm.eliasfano import EliasFano
from kinweave.plans.scratch import materialize, shuffle_partitions, text_bytes

DISCOUNT = 0.75
BUCKET_BYTES = 4 << 20
#: Parts that a context gets for each shard that its pairs would fill.
HOT_PARTS = 2
FOLDS, HELD_FOLD = 5, 1
U64 = np.uint64
START, END = U64(0x5354415254303031), U64(0x454E443030303031)
_SUCCESSOR_BITS = U64(40)
_DROP = U64(24)
_ODD = U64(0x9E3779B97F4A7C15)

#: Codes of base-10 logarithms from -12 to 0 in even steps; code 0 stands for none.
STEP = 12 / 65534
PROBABILITIES = np.concatenate([[0.0], 10 ** (-STEP * np.arange(65534, -1, -1))])


def quantise(logs: np.ndarray) -> np.ndarray:
    """The code of the nearest logarithm."""
    return np.clip(65535 + np.rint(logs / STEP), 1, 65535).astype("<u2")


class Trie:
    """Contexts, pointers, successors and codes as views of one buffer."""

    def __init__(self, raw: np.ndarray):
        *at, n, m = np.frombuffer(raw[:48].tobytes(), "<u8").tolist()
        self.contexts, self.pointers, self.successors = (EliasFano.from_buffer(raw, a) for a in at[:3])
        self.weights = raw[at[3] : at[3] + 2 * n].view("<u2")
        self.codes = raw[at[3] + 2 * n : at[3] + 2 * (n + m)].view("<u2")

    @staticmethod
    def build(contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, weights: np.ndarray, logs: np.ndarray) -> bytes:
        """From contexts in order, the number of successors of each (one at least), these in order within contexts, and the logarithms of back-off weights and pairs."""
        pointers = np.concatenate([[0], np.cumsum(sizes)])
        last = successors[pointers[1:] - 1] + U64(1)
        base = np.cumsum(last, dtype=U64) - last
        levels = [EliasFano.encode(contexts).to_bytes(), EliasFano.encode(pointers).to_bytes(), EliasFano.encode(np.repeat(base, sizes) + successors).to_bytes()]
        levels = [x + bytes(-len(x) % 8) for x in levels]
        at = 48 + np.cumsum([0, *map(len, levels)])
        return np.array([*at, len(contexts), len(successors)], "<u8").tobytes() + b"".join(levels) + quantise(weights).tobytes() + quantise(logs).tobytes()

    def lookup(self, contexts: np.ndarray, owner: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the contexts' back-off weights and of pairs (contexts[owner], successor); 0 for those not in the trie."""
        weights, codes = np.zeros(len(contexts), "<u2"), np.zeros(len(owner), "<u2")
        node = self.contexts.find(contexts)
        held = np.flatnonzero(node >= 0)
        weights[held] = self.weights[node[held]]
        first, last, base = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64), np.zeros(len(contexts), U64)
        first[held], last[held] = self.pointers.select(node[held]), self.pointers.select(node[held] + 1)
        inner = held[first[held] > 0]
        base[inner] = self.successors.select(first[inner] - 1) + U64(1)
        known = np.flatnonzero(node[owner] >= 0)
        mine = owner[known]
        at = self.successors.find(base[mine] + successors[known], first[mine], last[mine])
        codes[known[at >= 0]] = self.codes[at[at >= 0]]
        return weights, codes


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in the least of 1, 2, 4 or 8 bytes, which the first byte tells."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _widen(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    return np.frombuffer(raw, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + n * width


def _encode(keys, counts, sizes, successors, pair_counts) -> bytes:
    head = np.array([len(keys), len(successors)], "<u8").tobytes() + keys.astype("<u8").tobytes()
    low = (successors & U64(0xFFFFFFFF)).astype("<u4").tobytes() + (successors >> U64(32)).astype(np.uint8).tobytes()
    return head + _narrow(counts) + _narrow(sizes) + low + _narrow(pair_counts)


def _decode(raw: bytes):
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    keys = np.frombuffer(raw, "<u8", n, 16)
    counts, at = _widen(raw, 16 + 8 * n, n)
    sizes, at = _widen(raw, at, n)
    successors = np.frombuffer(raw, "<u4", m, at).astype(U64) | (np.frombuffer(raw, np.uint8, m, at + 4 * m).astype(U64) << U64(32))
    return keys, counts, sizes, successors, _widen(raw, at + 5 * m, m)[0]


class Bucket:
    """Documents of one bucket, their pairs, and what is asked about them. ``hot``: sorted hashes of split contexts and their parts."""

    def __init__(self, table: pa.Table, n_shards: int, hot: tuple[np.ndarray, np.ndarray]):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_pylist()
        data, offsets = tb.text_bytes(table.column("text"))
        words, first = [], [np.zeros(1, np.int64)]
        for a, b in tb.blocks(offsets):
            part = tb.lower(data[offsets[a] : offsets[b]])
            starts, ends, begin = tb.word_spans(part, offsets[a : b + 1] - offsets[a])
            words.append(tb.word_hashes(part, starts, ends))
            first.append(begin[1:] + first[-1][-1])
        words, first = np.concatenate(words), np.concatenate(first)
        self.held_out, learned = folds_of(self.ids)
        #: Pairs of document d are rows edge[d] to edge[d + 1].
        self.edge = first + np.arange(len(first))
        self.after = np.insert(words, first[1:], END)
        before = np.empty_like(self.after)
        before[1:] = self.after[:-1]
        before[self.edge[:-1]] = START
        train = np.repeat(learned, np.diff(self.edge))
        parts = np.ones(len(before), U64)
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], before), len(hot[0]) - 1)
            parts = np.where(hot[0][at] == before, hot[1][at], U64(1))
        part = np.where(parts > 1, tb.mix(self.after) % parts, U64(0))
        key = np.where(parts > 1, tb.mix(before + (part + U64(1)) * _ODD), before)
        self.keys, node = np.unique(key, return_inverse=True)
        counts = np.bincount(node, train, len(self.keys)).astype(np.int64)
        #: All parts of a split context are asked for, each with the context's whole count.
        self.split = []
        for word, n in zip(*(h.tolist() for h in hot)):
            rows = np.flatnonzero(before == U64(word)) if n > 1 else []
            if len(rows):
                own = tb.mix(U64(word) + np.arange(1, n + 1, dtype=U64) * _ODD)
                self.split.append((own, int(train[rows].sum())))
        if self.split:
            every = np.unique(np.concatenate([self.keys, *(own for own, _ in self.split)]))
            to = np.searchsorted(every, self.keys)
            node = to[node]
            wide = np.zeros(len(every), np.int64)
            wide[to], self.keys = counts, every
            for own, whole in self.split:
                wide[np.searchsorted(every, own)] = whole
            counts = wide
        self.counts, self.node = counts, node
        both = (node.astype(U64) << _SUCCESSOR_BITS) | (self.after >> _DROP)
        order = np.argsort(both)
        held = both[order]
        new = np.ones(len(held), bool)
        new[1:] = held[1:] != held[:-1]
        begin = np.flatnonzero(new)
        self.pair = np.empty(len(held), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.pairs = held[begin]
        self.pair_counts = np.add.reduceat(train[order].astype(np.int64), begin) if len(begin) else begin
        self.sizes = np.bincount((self.pairs >> _SUCCESSOR_BITS).astype(np.int64), minlength=len(self.keys))
        shard = ((self.keys >> U64(32)) * U64(n_shards)) >> U64(32)
        self.bounds = np.searchsorted(shard, np.arange(n_shards + 1, dtype=U64))

    def rows(self, bucket: int):
        pointer = np.concatenate([[0], np.cumsum(self.sizes)])
        for shard in np.flatnonzero(np.diff(self.bounds)).tolist():
            a, b = self.bounds[shard], self.bounds[shard + 1]
            at = slice(pointer[a], pointer[b])
            low = self.pairs[at] & U64((1 << 40) - 1)
            yield shard, bucket, _encode(self.keys[a:b], self.counts[a:b], self.sizes[a:b], low, self.pair_counts[at])

    def scores(self, replies: list[tuple[int, bytes]], total: int, distinct: int):
        """For each document (n_tokens, n_known, base_score, score)."""
        counts, weights, codes = [], [], []
        for _, raw in sorted(replies):
            n, m = np.frombuffer(raw, "<u8", 2).tolist()
            c, at = _widen(raw, 16, n)
            counts.append(c)
            weights.append(np.frombuffer(raw, "<u2", n, at))
            codes.append(np.frombuffer(raw, "<u2", m, at + 2 * n))
        count, weight, code = map(np.concatenate, (counts, weights, codes))
        weight = PROBABILITIES[weight]
        for own, _ in self.split:
            at = np.searchsorted(self.keys, own)
            weight[at] = weight[at].sum()
        c = count[self.node]
        known = np.empty(len(c))
        known[:-1] = c[1:]
        known[self.edge[1:] - 1] = c[self.edge[:-1]]
        base = (known + 0.5) / (total + 0.5 * (distinct + 1))
        p = np.where(c > 0, PROBABILITIES[code[self.pair]] + weight[self.node] * base, base)
        begin = self.edge[:-1]
        add = lambda x: np.add.reduceat(x, begin)
        return np.diff(self.edge), add((known > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(p))


def answer(blobs: list[tuple[int, bytes]], discount: float) -> list[tuple[int, bytes]]:
    """One shard's replies by bucket; the start's count stands for the end's."""
    asked = [(bucket, _decode(raw)) for bucket, raw in sorted(blobs)]
    keys, node = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, node, np.concatenate([a[1] for _, a in asked]))
    owner = np.repeat(node, np.concatenate([a[2] for _, a in asked]))
    both = (owner.astype(U64) << _SUCCESSOR_BITS) | np.concatenate([a[3] for _, a in asked])
    order = np.argsort(both)
    held = both[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    begin = np.flatnonzero(new)
    sums = np.add.reduceat(np.concatenate([a[4] for _, a in asked])[order], begin) if len(begin) else begin
    distinct = held[begin]
    place = np.empty(len(held), np.int64)
    place[order] = np.cumsum(new) - 1
    del both, held, order, owner
    pairs = distinct[sums > 0]
    sums = sums[sums > 0]
    after = np.bincount((pairs >> _SUCCESSOR_BITS).astype(np.int64), minlength=len(keys))
    used = after > 0
    own = counts[used].astype(float)
    with np.errstate(divide="ignore"):
        weights = np.log10(discount * after[used] / own)
        logs = np.log10(np.maximum(sums - discount, 0) / np.repeat(own, after[used]))
    replies = []
    with tempfile.NamedTemporaryFile(prefix="trie-") as f:
        f.write(Trie.build(keys[used], after[used], pairs & U64((1 << 40) - 1), weights, logs))
        f.flush()
        trie = Trie(np.memmap(f.name, np.uint8, "r").view(np.ndarray))
        weights, codes = trie.lookup(keys, (distinct >> _SUCCESSOR_BITS).astype(np.int64), distinct & U64((1 << 40) - 1))
        del trie
    at = to = 0
    for bucket, (own, _, _, successors, _) in asked:
        mine, found = node[at : at + len(own)], place[to : to + len(successors)]
        at, to = at + len(own), to + len(successors)
        raw = np.array([len(own), len(found)], "<u8").tobytes() + _narrow(counts[mine]) + weights[mine].tobytes() + codes[found].tobytes()
        replies.append((bucket, raw))
    return replies


def count_words(rows: DataFrame) -> DataFrame:
    """``h``, the hash of a word, the start or the end, ``n``, its pairs as a context, and ``train``, its occurrences as a token of training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column(1))
            train = folds_of(batch.column(0).to_pylist())[1]
            for a, b in tb.blocks(offsets):
                part = tb.lower(data[offsets[a] : offsets[b]])
                starts, ends, first = tb.word_spans(part, offsets[a : b + 1] - offsets[a])
                keys, node = np.unique(tb.word_hashes(part, starts, ends), return_inverse=True)
                learned = np.bincount(node, np.repeat(train[a:b], np.diff(np.append(first[:-1], len(starts)))), len(keys)).astype(np.int64)
                n = np.bincount(node, minlength=len(keys))
                columns = [np.append(keys, [START, END]).view(np.int64), np.append(n, [b - a, 0]), np.append(learned, [0, int(train[a:b].sum())])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "n", "train"])

    return rows.mapInArrow(count, "h long, n long, train long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def hot_contexts(words: DataFrame, n_shards: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of contexts with over 1 / (parts * n_shards) of all pairs, so fewer than that many, and the parts of each."""
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = sorted((r["h"] & ((1 << 64) - 1), r["n"]) for r in words.where(F.col("n") * parts * n_shards > total).collect()) if total else []
    return np.array([h for h, _ in hot], U64), np.array([-(-parts * n * n_shards // total) for _, n in hot], U64)


def folds_of(ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """(held out, learned from) for each id."""
    folds = np.array([-1 if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids], np.int64)
    return folds == HELD_FOLD, (folds >= 0) & (folds != HELD_FOLD)


_ROW = "shard int, bucket int, blob binary"


def _table(rows) -> pa.Table:
    names, kinds = ["shard", "bucket", "blob"], [pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, kinds)], names)


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", discount: float = DISCOUNT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The fold of a document is crc32 of its id's text modulo 5; fold 1 is held out and all others train.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_buckets = n_shards = max(shuffle_partitions(spark), -(-text_bytes(rows, "text") // bucket_bytes))
    words = materialize(count_words(rows), "words")
    total, distinct = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    held = spark.sparkContext.broadcast(hot_contexts(words, n_shards, HOT_PARTS))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)).cast("int").alias("bucket"), "doc_id", "text")
    by_bucket = dealt.groupBy("bucket")

    def ask(key, table):
        return _table(Bucket(table, n_shards, held.value).rows(key[0].as_py()))

    def reply(key, table):
        replies = answer([(r["bucket"], r["blob"]) for r in table.select(["bucket", "blob"]).to_pylist()], discount)
        return _table((key[0].as_py(), b, raw) for b, raw in replies)

    def finish(key, table, answers):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        bucket = Bucket(table, n_shards, held.value)
        found = bucket.scores([(r["shard"], r["blob"]) for r in answers.to_pylist()], total, distinct)
        columns = [bucket.ids, bucket.held_out, found[0], found[1], np.full(len(bucket.ids), total), *found[2:]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    asked = by_bucket.applyInArrow(ask, _ROW)
    answers = asked.groupBy("shard").applyInArrow(reply, _ROW)
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
