"""Token ids in binary segments with Elias-Fano encoded document boundaries.

Format. A data set is a Parquet table of segments, one row each, so that Spark's committer makes writes
atomic and any Hadoop store can hold it: shard and part (segments in this order hold the documents in
ascending id order), inner (ids in earlier segments of its shard), doc_ids (int64, little-endian), ids (all ids
concatenated, little-endian, uint16 or uint32 by ``width``) and bounds, the Elias-Fano code of the end offset
of each document within the segment, with its select samples. There is no table of 64-bit offsets: readers find the
i-th bound by ``EliasFano.select`` in near n * (2 + log2(ids / n)) bits, and nothing is built to read one document.

Documents are ordered by id, null first, then by text; repeated rows stay. Null and empty texts hold the
end id alone. Other columns aren't read. An empty table gives no segments.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.eliasfano import EliasFano
from kinweave.plans.scratch import scratch_path, shuffle_partitions, text_bytes

SEGMENT_IDS = 1 << 21
SHARD_BYTES = 32 << 20
NO_ID = -(1 << 63)


#: Characters whose normal form, case and class are the same for Python and any tokenizer: ASCII and Latin-1 letters.
_LETTERS = "a-zªµºß-öø-ÿ"
_UNUSUAL = re.compile(r"[^\t-\r -~ªµºÀ-ÖØ-öø-ÿ]|<\|")
#: The pieces of lower-case text that the pattern below gives on those characters (fixed values).
_PIECES = re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{_LETTERS}0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_pieces(config: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and encodes each piece of ``_PATTERN`` by itself."""
    steps = (config.get("normalizer") or {}).get("normalizers", [{}])
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    blanks = [{k: v for k, v in x.items() if k != "type"} for x in steps[1:2]] == [{"pattern": {"Regex": r"\s+"}, "content": " "}]
    return blanks and [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and cuts[0].get("behavior") == "Removed" and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN} and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]


class _Cache(dict):
    """Ids of pieces, as bytes; a missing one is encoded. Of two generations the older goes when the younger is full."""

    def __init__(self, encode, size: int):
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, piece: str) -> bytes:
        held = self.old.get(piece)
        self[piece] = held = self.encode(piece) if held is None else held
        return held

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    If the tokenizer cuts texts into pieces by the known pattern, texts of usual characters are cut here and
    each distinct piece is encoded, without the cutting steps, once while it is cached. Other texts are
    encoded as they are.
    """

    def __init__(self, tokenizer_json: str, cache_size: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        config = json.loads(tokenizer_json)
        self.cache = None
        if _cuts_pieces(config):
            bytes_only = config["pre_tokenizer"]["pretokenizers"][1]
            pieces = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": bytes_only}))
            self.cache = _Cache(lambda piece: array(self._code, pieces.encode(piece, add_special_tokens=False).ids).tobytes(), cache_size)

    def _ids(self, tokenizer, text: str) -> bytes:
        return array(self._code, tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, little-endian."""
        if not text:
            return b""
        if self.cache is None or _UNUSUAL.search(text):
            return self._ids(self.tokenizer, text)
        self.cache.age()
        return b"".join(map(self.cache.__getitem__, _PIECES.findall(text.lower())))


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(tokenizer_json: str) -> TextEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = TextEncoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


_SEGMENT = "shard int, part int, inner long, doc_ids binary, ids binary, width int, bounds binary"
_NAMES = ["shard", "part", "inner", "doc_ids", "ids", "width", "bounds"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]


def _pack(shard: int, part: int, inner: int, keys: list[int | None], ids: list[bytes], width: int) -> pa.RecordBatch:
    bounds = EliasFano.encode(np.cumsum([len(x) // width for x in ids]))
    row = (shard, part, inner, np.array([NO_ID if k is None else k for k in keys], "<i8").tobytes(), b"".join(ids), width, bounds.to_bytes())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2, segment_ids: int = SEGMENT_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Tokenize whole texts with the tokenizers file ``tokenizer`` and write segments to ``path``.

    Documents are dealt to shards by ranges of ids; a range's rows are sorted and encoded in one task,
    which holds one segment and one batch at a time. A segment ends after the document that fills it.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_shards = max(shuffle_partitions(spark), -(-text_bytes(rows, "text") // shard_bytes))
    ordered = rows.repartitionByRange(n_shards, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), _encoder(held.value)
        width, part, inner, total, keys, ids = encoder.dtype.itemsize, 0, 0, 0, [], []
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                ids.append(encoder.encode(text.as_py()) + end)
                total += len(ids[-1]) // width
                if total >= segment_ids:
                    yield _pack(shard, part, inner, keys, ids, width)
                    part, inner, total, keys, ids = part + 1, inner + total, 0, [], []
        if keys:
            yield _pack(shard, part, inner, keys, ids, width)

    ordered.mapInArrow(encode, _SEGMENT).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """A row for each document from the segments: doc_id, start, n_tokens, ids_crc32.

    The totals of shards, one row for each, go to the driver for the running sum; shards are as many as
    partitions, so their number is bounded by the write's plan.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    sizes = segments.select("shard", F.expr("octet_length(ids) div width").alias("size"))
    totals = sorted((r["shard"], r["size"]) for r in sizes.groupBy("shard").agg(F.sum("size").alias("size")).collect())
    before, offsets = 0, {}
    for shard, size in totals:
        offsets[shard] = before
        before += size
    held = spark.sparkContext.broadcast(offsets)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, inner, doc_ids, ids, width, bounds = (batch.column(c)[row].as_py() for c in range(6))
                ids = np.frombuffer(ids, f"<u{width}")
                code = EliasFano.from_buffer(bounds)
                ends = code.select(np.arange(len(code))).astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends)]
                keys = [None if k == NO_ID else k for k in np.frombuffer(doc_ids, "<i8").tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins + inner + held.value[shard], pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("shard", "inner", "doc_ids", "ids", "width", "bounds").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(row, i: int) -> np.ndarray:
    """Ids of the i-th document of a segment row, by two selects."""
    bounds = EliasFano.from_buffer(row["bounds"])
    return np.frombuffer(row["ids"], f"<u{row['width']}")[bounds.select(i - 1) if i else 0 : bounds.select(i)]


def encode_tokens(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write segments to the shared folder and read the per-document digest back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
