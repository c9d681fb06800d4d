"""Quality rules: a short-circuit cascade ordered by rejections per second of cost.

Each rule rejects some documents. On a bounded sample of the corpus the operator measures what every
rule costs and how many documents it rejects, and evaluates the rules in descending order of rejections
per cost; a rule sees only documents that all rules before it passed. A document is kept if no rule
rejects it, so the order changes the time and never the verdict.

Null text counts as the empty text, which has no words and fails the length rule. Repeated rows and ids
are judged each on its own. Other columns are neither read nor changed.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.rows import numbered

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
SAMPLE_ROWS = 400


class Page:
    """One text with measures that are computed when a rule first asks for them."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.words = self.text.split()
        self.n_words = len(self.words)
        self._held: dict[str, int] = {}

    def measure(self, name: str) -> int:
        if name not in self._held:
            self._held[name] = getattr(self, f"_{name}")()
        return self._held[name]

    def _word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, _CONTINUATION))

    def _n_symbols(self) -> int:
        return len(self.text.translate(None, _NOT_SYMBOL))

    def _n_lines(self) -> int:
        return len([line for line in self.text.split(b"\n") if line.strip()])

    def _n_dup_lines(self) -> int:
        lines = [line for line in self.text.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        windows = list(zip(self.words, self.words[1:], self.words[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        total, covered = 0, 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total

    def _n_lettered(self) -> int:
        return sum(map(bool, map(_LETTER.search, self.words)))

    def _n_ellipsis_lines(self) -> int:
        return sum(line.rstrip().endswith((b"...", "…".encode())) for line in self.text.split(b"\n") if line.strip())


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to drop."""

    name: str
    rejects: Callable[[Page], bool]


def default_rules() -> list[Rule]:
    """Thresholds of common web-corpus filters; the first two are the base rules."""
    m = lambda name: lambda p: p.measure(name)
    words, symbols, dups, lines, letters = m("word_chars"), m("n_symbols"), m("n_dup_lines"), m("n_lines"), m("n_lettered")
    return [
        Rule("short", lambda p: p.n_words < 50),
        Rule("repeated_windows", lambda p: 100 * p.measure("n_repeat_words") > 50 * p.n_words),
        Rule("word_length", lambda p: not 2 * p.n_words <= words(p) <= 20 * p.n_words),
        Rule("symbols", lambda p: 10 * symbols(p) > p.n_words),
        Rule("duplicate_lines", lambda p: 2 * dups(p) > lines(p)),
        Rule("few_letters", lambda p: 10 * letters(p) < 7 * p.n_words),
        Rule("ellipsis_lines", lambda p: 10 * p.measure("n_ellipsis_lines") > 3 * lines(p)),
    ]


def measure(texts: list[bytes | None], rules: list[Rule]) -> list[tuple[str, int, float]]:
    """(name, rejected texts, seconds) of each rule by itself."""
    out = []
    for rule in rules:
        pages = [Page(text) for text in texts]
        began = time.perf_counter()
        rejected = sum(rule.rejects(page) for page in pages)
        out.append((rule.name, rejected, time.perf_counter() - began))
    return out


def plan_cascade(measured: list[tuple[str, int, float]], rules: list[Rule]) -> list[Rule]:
    """The rules by rejections per second, highest first; ties and no measures keep the given order."""
    scores = {name: rejected / max(seconds, 1e-9) for name, rejected, seconds in measured}
    return sorted(rules, key=lambda rule: -scores.get(rule.name, 0.0))


def first_rejection(page: Page, cascade: list[Rule]) -> str | None:
    """The name of the first rule that rejects the page; later rules aren't evaluated."""
    return next((rule.name for rule in cascade if rule.rejects(page)), None)


def sample_measures(docs: DataFrame, text: str, rules: list[Rule], rows: int) -> list[tuple[str, int, float]]:
    """Measures of about ``rows`` texts drawn by hash from all documents, taken where the texts are; only the order depends on them."""
    share = min(1.0, rows / max(docs.count(), 1))
    picked = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure([t.as_py() for t in batch.column(0).cast(pa.large_binary())], rules)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.float64()))], ["name", "rejected", "seconds"])

    sums = picked.mapInArrow(scan, "name string, rejected long, seconds double").groupBy("name").agg(F.sum("rejected"), F.sum("seconds"))
    return [tuple(r) for r in sums.collect()]


def quality_filter(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    rules = rules or default_rules()
    cascade = plan_cascade(sample_measures(docs, text, rules, sample_rows), rules)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            yield batch.filter(pa.array([first_rejection(Page(t.as_py()), cascade) is None for t in texts], pa.bool_()))

    plain = numbered(docs)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def quality_report(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, reasons: bool = False) -> DataFrame:
    """A row for each document: measures, ``base_failed`` and ``kept``.

    With ``reasons`` also ``rejected_by``, the first of the given rules, in the given order, that rejects the
    document: it doesn't depend on the order that was measured, and costs a second pass over the rules of each rejected one.
    """
    given = rules or default_rules()
    cascade = plan_cascade(sample_measures(docs, text, given, sample_rows), given)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean" + (", rejected_by string" if reasons else "")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *["rejected_by"] * reasons]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()] * reasons
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                page = Page(raw.as_py())
                rejected = first_rejection(page, cascade) is not None
                failed = page.n_words < 50 or 100 * page.measure("n_repeat_words") > 50 * page.n_words
                reason = [first_rejection(page, given) if rejected else None] if reasons else []
                out.append((key, page.n_words, *map(page.measure, ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, not (failed or rejected), *reason))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, schema)
