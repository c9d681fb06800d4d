"""Language ID of words in code-switched text by a linear-chain conditional random field.

Every word is a run of letters and non-ASCII bytes. Its features are its byte n-grams of two to four with
marks at both ends (those with a mark are affixes) and the word itself (the lexicon), hashed to ``2**18``
rows of weights. Learned transitions tie neighbouring words, and forward-backward over a whole document
gives every word a distribution over languages. A document's language is that with the largest mean, which
is also its score.

The field is fitted on the driver by gradient ascent on a bounded sample: for each language at most
``sample_docs`` labelled documents by hash of their id, and of each ``windows`` windows of ``window`` words
spread over the whole text. Training sequences join two windows, of different languages in a third of
the cases, so transitions between languages are learned too. The model has a fixed size and is broadcast.

Documents in the held-out fold are never learned from; nor are those with a null id or language. Null
text and texts without a letter get ``und`` with score 0, and so do all texts if no language was learned.
Repeated rows are judged each on its own. Language, source and id take no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm import textbytes as tb

FOLDS, HELD_FOLD = 4, 2
SAMPLE_DOCS, WINDOWS, WINDOW = 300, 6, 24
#: Text without spaces is cut into words of so many bytes, a multiple of two, three and four.
WORD_BYTES = 60
ROUNDS, RATE, DECAY = 40, 0.5, 1e-6
ROWS = 1 << 18
UNKNOWN = "und"
_CHUNK = 32
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ASCII_LETTERS = _LETTERS.copy()
_ASCII_LETTERS[0x80:] = False
_ODD = tb.powers(12)[1:]


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(lower-case bytes, word starts, word ends, first word of each document); a run of over ``WORD_BYTES`` is cut into words of that many."""
    data = tb.lower(data)
    starts, ends, first = tb.word_spans(data, offsets, _LETTERS)
    pieces = -(-(ends - starts) // WORD_BYTES)
    if len(pieces) and pieces.max() > 1:
        place = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + WORD_BYTES * place, np.repeat(ends, pieces)
        ends = np.minimum(ends, starts + WORD_BYTES)
        first = np.searchsorted(starts, offsets)
    return data, starts, ends, first


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of weights, first row of each word) for words in ``data``."""
    lens = ends - starts + 2
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = np.repeat(starts, lens) + place - 1
    marks = (place == 0) | (place == np.repeat(lens, lens) - 1)
    units = np.where(marks, 1, data[np.clip(at, 0, max(len(data) - 1, 0))].astype(np.uint64) + 2).astype(np.uint64)
    left = np.repeat(first + lens, lens) - np.arange(len(units))
    held, kept = units, []
    for n in (2, 3, 4):
        held = held[: len(units) - n + 1] * _ODD[n] + units[n - 1 :] if len(units) >= n else held[:0]
        inside = left[: len(held)] >= n
        rows = (tb.mix(held + np.uint64(n)) % np.uint64(ROWS)).astype(np.int64)
        kept.append((np.flatnonzero(inside), rows[inside]))
    whole = (tb.mix(tb.word_hashes(data, starts, ends) + np.uint64(9)) % np.uint64(ROWS)).astype(np.int64)
    kept.append((first, whole))
    place = np.concatenate([p for p, _ in kept])
    order = np.argsort(place, kind="stable")
    rows = np.concatenate([r for _, r in kept])[order]
    return rows, np.searchsorted(place[order], first)


@dataclass
class Field:
    """Languages, weights of features by language, and log transitions."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """exp of each word's scores, the largest 1; equal words are scored once."""
        hashes = tb.word_hashes(data, starts, ends)
        _, first, node = np.unique(hashes, return_index=True, return_inverse=True)
        if not len(first):
            return np.empty((0, len(self.langs)), np.float32)
        rows, begin = features(data, starts[first], ends[first])
        scores = np.add.reduceat(self.weights[rows], begin, axis=0)
        return np.exp(scores - scores.max(1, keepdims=True))[node]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Distribution of each word's label by forward-backward over each document."""
    forward, backward = messages(emissions, first, transitions)
    return _scaled(forward * backward)


def messages(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each word, each with sum 1.

    Documents are cut into chunks whose transfer matrices are multiplied side by side; a pass over the
    chunks of all documents gives the messages at their ends, and a second pass fills the chunks.
    """
    n_labels = emissions.shape[1]
    counts = np.diff(first)
    per = -(-counts // _CHUNK)
    total = int(per.sum())
    if not total:
        return emissions, emissions
    doc = np.repeat(np.arange(len(per)), per)
    k = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][doc] + _CHUNK * k
    size = np.minimum(_CHUNK, first[1:][doc] - begin)
    by_size = np.argsort(-size, kind="stable")
    begin, size = begin[by_size], size[by_size]
    row_of = np.empty(total, np.int64)
    row_of[by_size] = np.arange(total)
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(_CHUNK)]
    move = np.exp(transitions).astype(np.float32)
    matrix = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (total, n_labels, n_labels)).copy()
    for t in range(_CHUNK):
        if not (m := active[t]):
            break
        step = (matrix[:m].reshape(-1, n_labels) @ move).reshape(m, n_labels, n_labels) * emissions[begin[:m] + t][:, None, :]
        matrix[:m] = step / np.maximum(step.sum((1, 2), keepdims=True), 1e-30)
    by_chunks = np.argsort(-per, kind="stable")
    chunk0 = (np.cumsum(per) - per)[by_chunks]
    docs_with = [int(np.searchsorted(-per[by_chunks], -j, "left")) for j in range(int(per.max()))]
    into = np.empty((total, n_labels), np.float32)
    back = np.empty((total, n_labels), np.float32)
    message = np.full((len(per), n_labels), 1 / n_labels, np.float32)
    for j, m in enumerate(docs_with):
        rows = row_of[chunk0[:m] + j]
        into[rows] = message[:m]
        message[:m] = _scaled(np.einsum("dl,dlm->dm", message[:m], matrix[rows]))
    message[:] = 1 / n_labels
    for j, m in reversed(list(enumerate(docs_with))):
        rows = row_of[chunk0[:m] + j]
        back[rows] = message[:m]
        message[:m] = _scaled(np.einsum("dlm,dm->dl", matrix[rows], message[:m]))
    forward, backward = np.empty_like(emissions), np.empty_like(emissions)
    for t in range(_CHUNK):
        if m := active[t]:
            into[:m] = _scaled((into[:m] @ move) * emissions[begin[:m] + t])
            forward[begin[:m] + t] = into[:m]
    for t in reversed(range(_CHUNK)):
        if m := active[t]:
            at = begin[:m] + t
            backward[at] = back[:m]
            back[:m] = _scaled((back[:m] * emissions[at]) @ move.T)
    return forward, backward


def fit(windows: list[tuple[str, list[bytes]]], rounds: int = ROUNDS, seed: int = 5) -> Field | None:
    """A field from (language, words) windows, by AdaGrad on the likelihood of all sequences at once."""
    langs = sorted({lang for lang, words in windows if words})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    by_lang = {lang: [w for x, w in windows if x == lang and w] for lang in langs}
    sequences = []
    for y, lang in enumerate(langs):
        for words in by_lang[lang]:
            other = y if len(langs) == 1 or rng.random() > 1 / 3 else int(rng.choice([z for z in range(len(langs)) if z != y]))
            mate = by_lang[langs[other]][int(rng.integers(len(by_lang[langs[other]])))]
            sequences.append((words + mate, [y] * len(words) + [other] * len(mate)))
    vocabulary = sorted({w for words, _ in sequences for w in words})
    index = {w: i for i, w in enumerate(vocabulary)}
    node = np.array([index[w] for words, _ in sequences for w in words])
    label = np.array([y for _, ys in sequences for y in ys])
    first = np.concatenate([[0], np.cumsum([len(w) for w, _ in sequences])])
    ends = np.cumsum([len(w) for w in vocabulary])
    rows, begin = features(np.frombuffer(b"".join(vocabulary), np.uint8), ends - [len(w) for w in vocabulary], ends)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(begin, len(rows))))
    n, n_labels = len(node), len(langs)
    weights, transitions = np.zeros((ROWS, n_labels), np.float32), np.zeros((n_labels, n_labels))
    speed_w, speed_t = np.full((ROWS, n_labels), 1e-6), np.full((n_labels, n_labels), 1e-6)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    right = np.flatnonzero(inner)
    for _ in range(rounds):
        scores = np.add.reduceat(weights[rows], begin, axis=0)
        emissions = np.exp(scores - scores.max(1, keepdims=True))[node].astype(np.float32)
        forward, backward = messages(emissions, first, transitions)
        p = _scaled(forward * backward)
        pair = forward[right - 1][:, :, None] * np.exp(transitions) * (emissions * backward)[right][:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-30)
        grad_t = -pair.sum(0)
        np.add.at(grad_t, (label[right - 1], label[right]), 1)
        error = -p.astype(float)
        error[np.arange(n), label] += 1
        grad_w = np.empty((ROWS, n_labels))
        for y in range(n_labels):
            by_word = np.bincount(node, error[:, y], len(vocabulary))
            grad_w[:, y] = np.bincount(rows, by_word[owner], ROWS)
        grad_w -= DECAY * n * weights
        speed_w += grad_w**2
        speed_t += grad_t**2
        weights += (RATE * grad_w / np.sqrt(speed_w)).astype(np.float32)
        transitions += RATE * grad_t / np.sqrt(speed_t)
    return Field(langs, weights, transitions)


def held_out(id: Column) -> Column:
    """True in the fold that isn't learned from; null ids are in none."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def _windows(text: bytes, windows: int, window: int) -> list[list[bytes]]:
    data = np.frombuffer(text, np.uint8)
    data, starts, ends, _ = words_of(data, np.array([0, len(data)]))
    if not len(starts):
        return []
    at = np.unique(np.linspace(0, max(0, len(starts) - window), windows).astype(int))
    return [[data[a:b].tobytes() for a, b in zip(starts[i : i + window], ends[i : i + window])] for i in at]


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS, window: int = WINDOW) -> Field | None:
    """A field from the labelled documents outside the held-out fold: ``windows`` of ``window`` words from each of ``sample_docs`` documents a language.

    The driver holds these windows, so its memory grows with the number of languages.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(x for name, n in sorted(counts.items()) for x in (F.lit(name), F.lit(min(1.0, 2 * sample_docs / n)))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    picked = rows.select("lang", "text", draw.alias("draw")).where(F.col("draw") < share[F.col("lang")] * (1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[b" ".join(w) for w in _windows(t.as_py(), windows, window)] for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, pa.list_(pa.binary()))], ["lang", "draw", "windows"])

    found = sorted(tuple(r) for r in picked.mapInArrow(cut, "lang string, draw long, windows array<binary>").collect())
    chosen, taken = [], dict.fromkeys(counts, 0)
    for name, _, held in found:
        if taken[name] < sample_docs:
            taken[name] += 1
            chosen += [(name, bytes(w).split()) for w in held]
    return fit(chosen)


def identify(docs: DataFrame, field: Field | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, lang_pred, score, and n_words by predicted language, in order of languages."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(field)
    langs = field.langs if field else []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column(1))
            for a, b in tb.blocks(offsets, 2 << 20):
                lo, hi = offsets[a], offsets[b]
                part, starts, ends, first = words_of(data[lo:hi], offsets[a : b + 1] - lo)
                ascii_before = np.concatenate([[0], np.cumsum(_ASCII_LETTERS[part])])
                edges = offsets[a : b + 1] - lo
                lettered = np.diff(ascii_before[edges]) > 0
                for d in np.flatnonzero(~lettered & (np.diff(first) > 0)):
                    lettered[d] = any(c.isalpha() for c in part[edges[d] : edges[d + 1]].tobytes().decode())
                n = b - a
                pred, score, labels = [UNKNOWN] * n, np.zeros(n), np.zeros((n, max(len(langs), 1)), np.int64)
                if field is not None and len(starts):
                    p = marginals(field.emissions(part, starts, ends), first, field.transitions)
                    docs_of = tb.spread(first, len(starts))
                    mean = np.stack([np.bincount(docs_of, p[:, y], n) for y in range(len(langs))], 1) / np.maximum(np.diff(first), 1)[:, None]
                    best = p.argmax(1)
                    labels = np.bincount(docs_of * len(langs) + best, minlength=n * len(langs)).reshape(n, -1)
                    top = mean.argmax(1)
                    score = np.where(lettered, np.clip(mean[np.arange(n), top], 0, 1), 0.0)
                    pred = [langs[t] if ok else UNKNOWN for t, ok in zip(top, lettered)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(pred), pa.array(score, pa.float64()), pa.array(labels.tolist(), pa.list_(pa.int64()))], ["doc_id", "lang_pred", "score", "n_words_by_lang"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double, n_words_by_lang array<long>")
