"""Phrase collocations by Suffix-sigma: sorted suffixes, all of whose prefixes are counted by one stack.

Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at spaces and tabs. A
suffix is a word and up to ``max_n`` - 1 words after it in its piece. Everything is counted for each language
(null: "und").

1. Words are counted, and pairs and triples of neighbouring words by hash. A phrase with a pair or a triple below
   ``min_count`` can't reach it, so suffixes end before those. They are told by a bit map of fixed size, in which a
   collision only keeps a suffix longer than it need be: the more a corpus has, the less the map saves, never a phrase.
2. Suffixes are summed within a block of text and shuffled by language and first word. A word that alone would make
   more than half a mean partition is hot, and a key goes on through hot words to the first other one: no key has more
   rows than that, and a suffix of hot words alone is one row a block. The hot words are at most two a partition.
3. Each partition is sorted in reverse order and read as a stream: one stack holds the open prefixes with their
   counts, which are emitted when they close. Only prefixes of hot words can be open in several partitions; their counts
   are emitted whatever they are, and all counts are summed again.
4. Parts of phrases are then joined from the same counts, which have them all.

Scores are exact: 1000 * a * n and l * r are decimals of 38 digits, enough for n up to 10^17 words.

Null and empty texts have no words. Ids aren't read, repeated rows count again, other columns aren't read whatever
their names, and an empty table gives no phrases. Long texts are cut into blocks between words, not between
suffixes: a text is held whole by one task, and its suffixes block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.textbytes import blocks, combine, hash_text, text_bytes, word_hashes, word_spans
from kinweave.plans.scratch import materialize, shuffle_partitions

MAX_N, MIN_COUNT, TOP = 5, 100, 2000
#: Bits of the map of pairs and triples, and how many of them a row has.
RUN_BITS, _ROW_BITS = 1 << 28, 32768
_BLOCK_BYTES = 4 << 20

# Within words the bytes 0 to 8 stand as bytes that UTF-8 doesn't have, so that the separator, a tab, is below all others
# and phrases that begin with the same words are neighbours in any sorted order.
_SEPARATOR, _FIRST_FREE = 9, 0xF5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[:9] = np.arange(_FIRST_FREE, _FIRST_FREE + 9)
_FOLD[0x20] = _SEPARATOR
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_CUTS
_INSIDE[_SEPARATOR] = False
_FREE = bytes(range(_FIRST_FREE, _FIRST_FREE + 10))
_BACK = bytes.maketrans(_FREE[:9] + bytes([_SEPARATOR]), bytes(range(9)) + b" ")
#: The language stands before a suffix as if it were its first word.
_LANG, _LANG_BACK = bytes.maketrans(bytes(range(10)), _FREE), bytes.maketrans(_FREE, bytes(range(10)))

U64 = np.uint64


class _Words:
    """The words of a block of texts: their spans, hashes and languages, and whether each is the last of its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        self.data = _FOLD[data]
        self.starts, self.ends, first = word_spans(self.data, offsets, _INSIDE)
        counts = np.diff(np.append(first[:-1], len(self.starts)))
        doc = np.repeat(np.arange(len(offsets) - 1), counts)
        # Cuts before a word number its piece.
        piece = np.cumsum(_CUTS[self.data], dtype=np.int32)[self.starts] if len(self.data) else np.empty(0, np.int64)
        self.last = np.ones(len(self.starts), bool)
        self.last[:-1] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        self.plain = word_hashes(self.data, self.starts, self.ends)
        self.lang = lang[doc]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    """Blocks of words and the names of the languages that they are numbered by."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column(1))
        for a, b in blocks(offsets, _BLOCK_BYTES):
            yield _Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], code[a:b]), names


def _salted(words: _Words, names: list[str]) -> np.ndarray:
    """Hashes of words in their languages, as signed numbers."""
    of = np.array([hash_text(n.encode()) for n in names] or [0], U64)
    return combine(of[words.lang], words.plain).view(np.int64)


def _places(words: _Words, salted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in their map of each word with the next one, and with the next two."""
    pair = combine(salted[:-1].view(U64), words.plain[1:])
    place = lambda x: (x & U64(RUN_BITS - 1)).astype(np.int64)
    return place(pair), place(combine(pair[:-1], words.plain[2:]))


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of ascending places below ``_ROW_BITS``: steps of two bytes, then counts of one byte, larger ones as several steps of 0."""
    times = -(-counts // 255)
    steps = np.zeros(times.sum(), "<u2")
    held = np.full(len(steps), 255, np.uint8)
    last = np.cumsum(times) - 1
    steps[last - times + 1] = np.diff(places, prepend=0)
    held[last] = counts - 255 * (times - 1)
    return steps.tobytes() + held.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 3
    return np.cumsum(np.frombuffer(blob, "<u2", n), dtype=np.int64), np.frombuffer(blob, np.uint8, n, 2 * n)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word (a hash of both) and n from rows of lang and text."""

    def count(batches):
        for words, names in _read(batches):
            found, at, n = np.unique(_salted(words, names), return_index=True, return_counts=True)
            lang = pa.array(names, pa.string()).take(pa.array(words.lang[at]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(found), pa.array(n)], ["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def run_counts(texts: DataFrame) -> DataFrame:
    """Counts of the pairs and triples of each block of text: packed, for each row of their map."""

    def count(batches):
        for words, names in _read(batches):
            pairs, triples = _places(words, _salted(words, names))
            place, times = np.unique(np.concatenate([pairs[~words.last[:-1]], triples[~words.last[:-2] & ~words.last[1:-1]]]), return_counts=True)
            row, first = np.unique(place // _ROW_BITS, return_index=True)
            ends = np.append(first, len(place))
            packed = [_packed(place[a:b] % _ROW_BITS, times[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(packed, pa.binary())], ["row", "packed"])

    return texts.mapInArrow(count, "row long, packed binary")


def run_map(packed: DataFrame, min_count: int) -> np.ndarray:
    """The bits of the pairs and triples that reach ``min_count``; rows of the map are summed one after the other in each task."""

    def total(batches):
        row, sums = None, np.zeros(_ROW_BITS, np.int64)
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != row and row is not None:
                    yield done(row, sums)
                    sums[:] = 0
                row = k
                places, counts = _unpacked(blob)
                np.add.at(sums, places, counts)
        if row is not None:
            yield done(row, sums)

    def done(row: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([np.packbits(sums >= min_count, bitorder="little").tobytes()], pa.binary())], ["row", "bits"])

    rows = packed.repartition("row").sortWithinPartitions("row")
    out = np.zeros(RUN_BITS // 8, np.uint8)
    for r in rows.mapInArrow(total, "row long, bits binary").toLocalIterator():
        at = r["row"] * (_ROW_BITS // 8)
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _bits(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (held[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def _suffixes(batches: Iterator[pa.RecordBatch], runs: np.ndarray, hot: np.ndarray, max_n: int) -> Iterator[pa.RecordBatch]:
    """Rows of key, suffix (its language first) and how often it stands in the block."""
    for words, names in _read(batches):
        salted = _salted(words, names)
        if not len(salted):
            continue
        _, at, ids = np.unique(salted, return_index=True, return_inverse=True)
        n = len(ids)
        # Id 0 is the end of a suffix.
        window = np.zeros((n, max_n), np.int32)
        window[:, 0] = ids + 1
        pairs, triples = (_bits(runs, x) for x in _places(words, salted))
        pairs &= ~words.last[:-1]
        goes = np.ones(n, bool)
        for d in range(1, min(max_n, n)):
            goes = goes[: n - d] & pairs[d - 1 :]
            if d > 1:
                goes &= triples[d - 2 :]
            window[: n - d, d] = np.where(goes, ids[d:] + 1, 0)
        # Neighbours share their first words, which the shuffle's files compress.
        order = np.lexsort(window.T[::-1])
        window = window[order]
        new = np.concatenate([[True], (window[1:] != window[:-1]).any(1)])
        count = np.diff(np.append(np.flatnonzero(new), len(window)))
        window = window[new]
        # Words as binary strings; a suffix is theirs, joined.
        begin, end = words.starts[at], words.ends[at]
        size = end - begin
        total = np.concatenate([[0], np.cumsum(size)])
        gather = np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)
        vocabulary = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(words.data[gather])])
        lang = pa.array([n.encode().translate(_LANG) for n in names], pa.large_binary()).take(pa.array(words.lang[at][window[:, 0] - 1]))
        parts = [lang, *(vocabulary.take(pa.array(window[:, d] - 1, mask=window[:, d] == 0)) for d in range(max_n))]
        suffix = pc.binary_join_element_wise(*parts, pa.scalar(bytes([_SEPARATOR]), pa.large_binary()), null_handling="skip").cast(pa.binary())
        # The key is the words up to the first that isn't hot.
        hashes = salted[at]
        is_hot = np.append(False, np.isin(hashes, hot))
        hashes = np.append(0, hashes).view(U64)
        key, goes = hashes[window[:, 0]], is_hot[window[:, 0]]
        for d in range(1, max_n):
            key = np.where(goes & (window[:, d] > 0), combine(key, hashes[window[:, d]]), key)
            goes &= is_hot[window[:, d]]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), suffix, pa.array(count)], ["key", "suffix", "n"])


def _hot_words(vocabulary: pa.Array, lang: str, hot: np.ndarray) -> np.ndarray:
    data, offsets = text_bytes(vocabulary)
    plain = word_hashes(data, offsets[:-1], offsets[1:])
    return np.isin(combine(np.full(len(plain), hash_text(lang.encode()), U64), plain).view(np.int64), hot)


def _lang_name(word: bytes) -> str:
    return word.translate(_LANG_BACK).decode()


def _emitted(phrases: list[bytes], size: int, n: np.ndarray) -> pa.RecordBatch:
    """lang, phrase as it was in the text with spaces between words, size and n."""
    cut = [p.split(bytes([_SEPARATOR]), 1) for p in phrases]
    langs, phrases = [_lang_name(c[0]) for c in cut], [c[1].translate(_BACK) for c in cut]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(n, pa.int64())], ["lang", "phrase", "size", "n"])


def _count(batches: Iterator[pa.RecordBatch], hot: np.ndarray, max_n: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, size and n of the prefixes of sorted suffixes: those that reach ``min_count``, and all of hot words alone that are shorter than a suffix.

    The stack holds the open prefixes of the last suffix, a word (the language first) and a count so far for each depth.
    A batch moves through it at once: at each depth the rows between two changes of the prefix are summed, what was
    open before the batch is added to its first prefix, and what is open at its end stays on the stack.
    """
    words_open: list[bytes] = []
    counts_open: list[int] = []
    separator, depth = bytes([_SEPARATOR]), max_n + 1

    def closed(keep: int) -> Iterator[pa.RecordBatch]:
        """Take prefixes of more than ``keep`` words off the stack."""
        while len(words_open) > keep:
            size, n = len(words_open) - 1, counts_open.pop()
            if size and (n >= min_count or (size < max_n and _hot_words(pa.array(words_open[1:], pa.large_binary()), _lang_name(words_open[0]), hot).all())):
                yield _emitted([separator.join(words_open)], size, np.array([n]))
            words_open.pop()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        # Words of each row by depth, as codes within the batch; -1 where a suffix has ended.
        split = pc.split_pattern(batch.column(0).cast(pa.large_binary()), separator)
        coded = split.flatten().dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        lens = pc.list_value_length(split).to_numpy().astype(np.int64)
        words = np.full((n, depth), -1, np.int64)
        words[np.repeat(np.arange(n), lens), np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)] = codes
        is_hot = np.zeros((n, max_n), bool)
        for k in np.unique(words[:, 0]).tolist():
            rows = words[:, 0] == k
            seen = np.unique(words[rows, 1:])
            table = np.zeros(len(vocabulary) + 1, bool)
            table[seen[seen >= 0]] = _hot_words(vocabulary.take(pa.array(seen[seen >= 0])), _lang_name(vocabulary[k].as_py()), hot)
            is_hot[rows] = table[words[rows, 1:]]
        all_hot = np.logical_and.accumulate(is_hot, axis=1)
        changes = np.ones((n + 1, depth), bool)
        changes[1:n] = np.logical_or.accumulate(words[1:] != words[:-1], axis=1)
        first = vocabulary.take(pa.array(words[0, : lens[0]])).to_pylist()
        same = 0
        while same < min(len(first), len(words_open)) and first[same] == words_open[same]:
            same += 1
        yield from closed(same)
        before, words_open, counts_open = counts_open, [], []
        total = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
        for d in range(depth):
            edges = np.flatnonzero(changes[:, d])
            begins, ends = edges[:-1], edges[1:]
            there = words[begins, d] >= 0
            begins, ends = begins[there], ends[there]
            if not len(begins):
                break
            held = total[ends] - total[begins]
            if begins[0] == 0 and d < len(before):
                held[0] += before[d]
            if ends[-1] == n:
                words_open.append(vocabulary[words[-1, d]].as_py())
                counts_open.append(int(held[-1]))
            if d:
                told = (ends < n) & ((held >= min_count) | (all_hot[begins, d - 1] & (d < max_n)))
                rows = begins[told]
                parts = [vocabulary.take(pa.array(words[rows, j])) for j in range(d + 1)]
                yield _emitted(pc.binary_join_element_wise(*parts, pa.scalar(separator, pa.large_binary())).to_pylist(), d, held[told])
    yield from closed(0)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size and n of all phrases of up to ``max_n`` words that occur ``min_count`` times or more; lang and its n words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = materialize(word_counts(texts), "words")
    n_parts, n_words = shuffle_partitions(spark), counts.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r["word"] for r in counts.where(F.col("n") * (2 * n_parts) > n_words).select("word").collect()], np.int64)  # at most two a partition
    held = spark.sparkContext.broadcast((run_map(run_counts(texts), min_count), hot))
    rows = texts.mapInArrow(lambda batches: _suffixes(batches, *held.value, max_n), "key long, suffix binary, n long")
    dealt = rows.repartition(n_parts, "key").select("suffix", "n").sortWithinPartitions(F.desc("suffix"))
    found = dealt.mapInArrow(lambda batches: _count(batches, held.value[1], max_n, min_count), "lang string, phrase string, size int, n long")
    found = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return materialize(found, "phrases"), counts.groupBy("lang").agg(F.sum("n").alias("n"))


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` collocations.

    A phrase of two words or more, cut after its first k words, has l and r occurrences of its parts and the score
    1000 * a * n / (l * r), rounded down; its lowest-scoring cut counts, the first of equal ones. Phrases that a
    longer one covers in all their occurrences are left out. Order: score, then a, both descending, then the phrase.
    """
    counted, sizes = phrase_counts(docs, text, lang, max_n, min_count)
    found = counted.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    # Only phrases that are longer by a word need be looked at: those between a phrase and one that covers it cover it too.
    ends = F.array(F.slice("w", F.lit(1), F.col("size") - 1), F.slice("w", F.lit(2), F.col("size") - 1))
    longer = found.where("size > 2").select(F.col("lang").alias("c_lang"), F.explode(F.transform(ends, lambda x: F.array_join(x, " "))).alias("c_phrase"), "a")
    cover = longer.groupBy("c_lang", "c_phrase").agg(F.max("a").alias("cover"))
    kept = found.join(cover, (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("c_phrase")), "left").where("cover IS NULL OR cover < a")

    def cut(k: Column) -> Column:
        return F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("rest"))

    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    left, right = (counted.select(F.col("lang").alias(f"{x}_lang"), F.col("phrase").alias(f"{x}_phrase"), F.col("n").alias(x)) for x in "lr")
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase"))).join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    words = sizes.select(F.col("lang").alias("n_lang"), F.col("n").alias("words"))
    wide = lambda name: F.col(name).cast("decimal(17,0)").alias(name)
    exact = cuts.join(words, F.col("lang") == F.col("n_lang")).select("lang", "phrase", "k", "a", "l", "r", "words", wide("a").alias("da"), wide("l").alias("dl"), wide("r").alias("dr"), wide("words").alias("dn"))
    scored = exact.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * da * dn) div (dl * dr)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "words")).alias("best"))
    rows = best.select("lang", "phrase", "best.a", "best.l", "best.r", F.col("best.words").alias("n"), "best.score")
    # A language's phrases are ranked in parts first, so that none is sorted whole.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
