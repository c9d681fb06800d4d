"""Documents dealt to buckets of about equal bytes, in order of id and text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.plans.scratch import shuffle_partitions

#: Rows of the driver's sample for each bucket, and at most.
SAMPLE_ROWS, MOST_SAMPLE_ROWS = 100, 1 << 20
#: Stands for a null id, which comes after all others; an id of 2**63 - 1 counts as null.
LAST = np.iinfo(np.int64).max
_PREFIX = 7


@dataclass(frozen=True)
class Dealing:
    """``rows`` of bucket, doc_id and text, and for each bucket its ``order``: buckets that share an id share it too."""

    rows: DataFrame
    order: np.ndarray

    @property
    def n_buckets(self) -> int:
        return len(self.order)


def _prefix(text: Column) -> Column:
    """The first bytes of the text as an integer that follows the texts' order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, _PREFIX)), 2 * _PREFIX, "0"), 16, 10).cast("long")


def bounds_of(ids: np.ndarray, prefixes: np.ndarray, sizes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The last (id, prefix) of each bucket but the last one, from a sample of rows.

    A bucket ends between ids, except that an id that alone would fill one gets buckets of its own, split by prefix.
    """
    out, most = [], np.iinfo(np.int64).max
    if not len(ids) or n_buckets < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.lexsort((prefixes, ids))
    ids, prefixes, sizes = ids[by], prefixes[by], sizes[by].astype(float) + 1
    share = sizes.sum() / n_buckets
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    held = 0.0
    for a, b, size in zip(first.tolist(), [*first[1:].tolist(), len(ids)], np.add.reduceat(sizes, first).tolist()):
        key = int(ids[a])
        if b - a > 1 and size > share:
            if held and key > np.iinfo(np.int64).min:
                out.append((key - 1, most))
            running, last = np.cumsum(sizes[a:b]), 0
            for i in range(b - a - 1):
                if running[i] - last >= share and prefixes[a + i] != prefixes[a + i + 1]:
                    out.append((key, int(prefixes[a + i])))
                    last = running[i]
            out.append((key, most))
            held = 0.0
            continue
        held += size
        if held >= share:
            out.append((key, most))
            held = 0.0
    return tuple(np.array(x, np.int64) for x in zip(*[p for p in out if p[0] < LAST or p[1] < most])) if out else (np.empty(0, np.int64),) * 2


def deal(rows: DataFrame, bucket_bytes: int) -> Dealing:
    """``rows`` of doc_id and text in buckets of about ``bucket_bytes`` of text: a lower bucket has smaller ids, and of equal ones smaller texts.

    Rows equal in id and in the first seven bytes of the text, and a single document, are never split.
    """
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_buckets = max(shuffle_partitions(spark), -(-size // bucket_bytes))
    share = min(1.0, min(MOST_SAMPLE_ROWS, SAMPLE_ROWS * n_buckets) / max(n, 1))
    picked = rows if share == 1 else rows.sample(share, seed=17)
    sample = picked.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("i"), _prefix(F.col("text")).alias("p"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("s")).toArrow()
    ids, cuts = bounds_of(*(c.to_numpy() for c in sample.columns), n_buckets)
    order = np.concatenate([[0], np.cumsum(np.append(ids, LAST)[1:] != ids)]).astype(np.int32)
    held = spark.sparkContext.broadcast((ids, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cuts = held.value
        for batch in batches:
            mine = batch.column(0).fill_null(LAST).to_numpy()
            bucket, stop = np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")
            prefix = batch.column(1).to_numpy(zero_copy_only=False)
            for b in np.unique(bucket[stop > bucket]).tolist():
                at = np.flatnonzero((bucket == b) & (stop > b))
                bucket[at] += np.searchsorted(cuts[b : stop[at[0]]], prefix[at], "left")
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), batch.column(0), batch.column(2)], ["bucket", "doc_id", "text"])

    dealt = rows.select("doc_id", _prefix(F.col("text")).alias("prefix"), "text").mapInArrow(place, "bucket int, doc_id long, text string")
    return Dealing(dealt, order)
