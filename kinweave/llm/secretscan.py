"""Secrets in text: fixed patterns, and strings in sensitive contexts that a primed compressor can't make shorter.

Base kinds are found by pattern alone, leftmost and non-overlapping within a kind; a match that fails its check is
dropped without another try:
assign, a name such as password or token, then : or = and a value of 6 characters or more (the span is all of it);
access, AKIA and at least 16 capitals or digits; hex, 24 or more lower-case hex digits.

The added kind "novel" works by dictionary-primed compression. A candidate is a run of 12 characters or more of keys
and passwords, with a letter and a digit, that has a sensitive word (key, token, password, ...) within 48
characters before it on its line. It is measured by its marginal bytes: zstandard compresses the surrounding text
with and without the candidate, both times primed with a dictionary of the corpus' most frequent identifiers; the
difference is what the candidate itself costs. Names, words, repeated samples and what stands nearby are matched in
the dictionary or the surroundings and cost little; random keys cost a byte a character. From ``threshold`` bytes a
character on the candidate is reported, unless it overlaps a base span.

The dictionary is learned from the whole corpus: identifiers of every text are counted, and the most frequent ones
up to ``DICTIONARY_BYTES`` are taken, ties in order of the identifier, so reruns agree. Its size never grows.

Null and empty texts have no spans. Ids aren't interpreted, repeated rows are searched each on its own, other columns
aren't read, and an empty table gives no rows. Time is in proportion to the text: candidates don't overlap, and each
costs two compressions of at most ``CONTEXT`` characters on both sides; one of over 512 characters costs two for each 48 of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from kinweave.plans.scratch import materialize

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")
THRESHOLD = 0.9
#: Characters on each side that a candidate is measured against, and that a sensitive word may stand before it.
CONTEXT, NEAR = 96, 48
DICTIONARY_BYTES, LEVEL = 32 << 10, 19
#: An identifier of the dictionary has so many characters.
_LEAST, _MOST = 4, 32

# The patterns of the base kinds.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
#: Texts with a base span pass this.
_CUE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: Placeholders and series, which nobody keeps secret; they prime the compressor like identifiers.
_PLAIN = ("example", "changeme", "placeholder", "xxxxxxxxxxxxxxxx", "0000000000000000", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "qwertyuiop")
_SENSITIVE = re.compile(r"(?i:passw|passphrase|pwd|secret|token|credential|bearer|authori[sz]|signature|api.?key|access.?key|private.?key|encryption.?key|license.?key)", re.ASCII)
_SENSITIVE_CUE = _SENSITIVE.pattern
_RUN = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{12,}", re.ASCII)
#: Longer runs are measured in pieces of this many characters, each about as long as a key.
_LONGEST, _PIECE = 512, 48
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_WORDS = re.compile(rf"[A-Za-z_][A-Za-z0-9_]{{{_LEAST - 1},{_MOST - 1}}}", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of all base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


class Novelty:
    """Marginal compressed bytes of a string against what surrounds it and a dictionary."""

    def __init__(self, words: list[str]):
        # The matches that cost least are nearest: the most frequent words come last.
        primer = zstandard.ZstdCompressionDict("\n".join([*reversed(words), *_PLAIN]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=LEVEL)
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, candidate: str, before: str, after: str) -> float:
        """Bytes for each byte of the candidate. Copies of it nearby don't count as surroundings."""
        around = (before + "\n" + after).replace(candidate, "")
        body, rest = candidate.encode(), around.encode()
        size = len(self._compressor.compress(rest + b"\n" + body)) - len(self._compressor.compress(rest + b"\n"))
        return max(size, 0) / len(body)

    def of_long(self, run: str) -> float:
        """The same for a run of more than ``_LONGEST`` characters, piece by piece and without surroundings: over a long string the compressor's codes for single characters are shorter than a byte, however random it is."""
        return sum(self(run[i : i + _PIECE], "", "") * len(run[i : i + _PIECE]) for i in range(0, len(run), _PIECE)) / len(run)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans that might be secrets: runs of at most 512 key characters with a letter and a digit, after a sensitive word on their line."""
    return ((a, b) for a, b in runs(text) if b - a <= _LONGEST)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """``candidates`` of any length."""
    for word in _merged(text):
        for m in _RUN.finditer(text, *word):
            if _LETTER.search(m[0]) and _DIGIT.search(m[0]):
                yield m.span()


def _merged(text: str) -> Iterator[tuple[int, int]]:
    """Regions of text after sensitive words: ``NEAR`` characters of the line and the run that begins in them, without overlaps."""
    begin = end = last = -1
    for m in _SENSITIVE.finditer(text):
        line = text.find("\n", m.end(), m.end() + NEAR)
        stop = m.end() + NEAR if line < 0 else line
        # Only a run that began before is followed to its end, and once for all words in it.
        if line < 0 and stop < len(text) and _RUN_CHARS.match(text[stop - 1]):
            if stop > last:
                tail = _RUN_CHARS.match(text, stop)
                last = tail.end() if tail else stop
            stop = last
        stop = min(stop, len(text))
        if m.end() <= end:
            end = max(end, stop)
            continue
        if begin >= 0:
            yield begin, end
        begin, end = m.end(), stop
    if begin >= 0:
        yield begin, end


_RUN_CHARS = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]+", re.ASCII)


def spans_of(text: str, novelty: Novelty, threshold: float = THRESHOLD, base: bool = True, added: bool = True) -> list[tuple[int, int, int, float]]:
    """(start, rank of kind, end, score) of all spans, in order; base spans score 1."""
    found = base_spans(text) if base else []
    out = [(*s, 1.0) for s in found]
    at, last = 0, -1
    for a, b in runs(text) if added else ():
        # Base spans are in order of their starts; the furthest end so far tells whether one reaches in.
        while at < len(found) and found[at][0] < b:
            last = max(last, found[at][2])
            at += 1
        if last > a:
            continue
        score = novelty(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]) if b - a <= _LONGEST else novelty.of_long(text[a:b])
        if score >= threshold:
            out.append((a, 3, b, min(score, 1.0)))
    return sorted(out)


def identifiers(docs: DataFrame, text: str = "text", most_bytes: int = DICTIONARY_BYTES) -> list[str]:
    """The most frequent identifiers of all texts, as many as fit into ``most_bytes`` with a separator each, most frequent first."""

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                words = pc.split_pattern_regex(pc.fill_null(batch.column(0).slice(at, 1024), ""), "[^A-Za-z0-9_]+").flatten()
                kept = pc.value_counts(words)
                word, n = kept.field(0), kept.field(1)
                size = pc.binary_length(word)
                used = pc.and_(pc.and_(pc.greater_equal(size, _LEAST), pc.less_equal(size, _MOST)), pc.invert(pc.match_substring_regex(word, "^[0-9]")))
                yield pa.RecordBatch.from_arrays([word.filter(used), n.filter(used)], ["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most_bytes // (_LEAST + 1))
    out, size = [], 0
    for r in counts.collect():
        size += len(r["word"]) + 1
        if size > most_bytes:
            break
        out.append(r["word"])
    return out


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", words: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans``: an array of (start, end, kind, score) in order of start, then kind; places are code points with an exclusive end.

    ``words`` is the dictionary, by default the corpus' own ``identifiers``.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    words = identifiers(rows) if words is None else words

    def scan(batches):
        novelty = Novelty(words)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            base = pc.match_substring_regex(texts, _CUE).to_pylist()
            added = pc.match_substring_regex(texts, _SENSITIVE_CUE).to_pylist()
            spans = []
            for i, (b, s) in enumerate(zip(base, added)):
                found = spans_of(texts[i].as_py(), novelty, threshold, b, s) if b or s else ()
                spans.append([{"start": x[0], "end": x[2], "kind": KINDS[x[1]], "score": x[3]} for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,kind:string,score:double>>"
    return rows.mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    rows = materialize(docs.select("doc_id", F.col(text).alias("text")), "secrets")
    words = options.pop("words", None)
    words = identifiers(rows) if words is None else words
    threshold = options.pop("threshold", THRESHOLD)

    def clean(batches):
        novelty = Novelty(words)
        for batch in batches:
            out = []
            for held in batch.column(1).to_pylist():
                parts, at = [], 0
                for a, kind, b, _ in spans_of(held or "", novelty, threshold):
                    if a >= at:
                        parts += [held[at:a], f"<{KINDS[kind]}>"]
                        at = b
                out.append(None if held is None else "".join([*parts, held[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(clean, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
