"""Most frequent items by lossy counting, in memory that does not grow with the number of distinct items.

Each task keeps (item, count, delta) entries. After every `1/epsilon` items a bucket ends and entries whose
count + delta does not exceed the number of ended buckets are dropped; so an entry's true count in the task
lies in [count, count + delta], and an item without entry occurred at most `buckets` times there. Task
summaries are merged by summing counts and deltas, with `buckets` standing for the tasks that lack the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.common import clean_seq, materialize

_SUMMARY = "h bigint, n bigint, delta bigint, pruned bigint"


class LossyCounter:
    """Entries for 64-bit items; at most about log(epsilon * n) / epsilon of them."""

    def __init__(self, epsilon: float) -> None:
        self.width = max(1, round(1 / epsilon))
        self.pruned = 0  # buckets that have ended
        self.items = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.deltas = np.empty(0, np.int64)
        self._rest: list[np.ndarray] = []
        self._waiting = 0

    def add(self, items: np.ndarray) -> None:
        while self._waiting + len(items) >= self.width:
            cut = self.width - self._waiting
            self._rest.append(items[:cut])
            items = items[cut:]
            self._flush()
            self.pruned += 1
            keep = self.counts + self.deltas > self.pruned
            self.items, self.counts, self.deltas = self.items[keep], self.counts[keep], self.deltas[keep]
        self._rest.append(items)
        self._waiting += len(items)

    def _flush(self) -> None:
        new, n = np.unique(np.concatenate(self._rest), return_counts=True) if self._rest else (self.items[:0], self.counts[:0])
        self._rest, self._waiting = [], 0
        at = np.searchsorted(self.items, new)
        known = at < len(self.items)
        known[known] = self.items[at[known]] == new[known]
        self.counts[at[known]] += n[known]
        fresh = ~known
        items = np.concatenate([self.items, new[fresh]])
        order = np.argsort(items, kind="stable")
        self.items = items[order]
        self.counts = np.concatenate([self.counts, n[fresh]])[order]
        self.deltas = np.concatenate([self.deltas, np.full(fresh.sum(), self.pruned)])[order]

    def summary(self) -> pa.RecordBatch:
        """One row per entry, and one with a null item that only carries `pruned`."""
        self._flush()
        size = len(self.items)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(self.items, 0), pa.int64(), mask=np.append(np.zeros(size, bool), True)),
                pa.array(np.append(self.counts, 0), pa.int64()),
                pa.array(np.append(self.deltas, 0), pa.int64()),
                pa.array(np.full(size + 1, self.pruned), pa.int64()),
            ],
            ["h", "n", "delta", "pruned"],
        )


def _summarise(epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LossyCounter(epsilon)
        for batch in batches:
            counter.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield counter.summary()

    return run


def merged_summary(hashes: DataFrame, epsilon: float) -> tuple[DataFrame, int]:
    """(h, low, high) for every item that some task kept, and the most that any other item can have."""
    parts = materialize(hashes.mapInArrow(_summarise(epsilon), _SUMMARY))
    missed = parts.filter(F.col("h").isNull()).agg(F.coalesce(F.sum("pruned"), F.lit(0)).alias("b")).first()["b"]
    merged = (
        parts.filter(F.col("h").isNotNull())
        .groupBy("h")
        .agg(F.sum("n").alias("low"), F.sum("delta").alias("d"), F.sum("pruned").alias("p"))
        .select("h", "low", (F.col("low") + F.col("d") + F.lit(missed) - F.col("p")).alias("high"))
    )
    return merged, missed


def frequent_items(df: DataFrame, id_col: str, item: str = "seq", k: int = 20, epsilon: float = 1e-4, broadcast_rows: int = 100_000) -> DataFrame:
    """The k most frequent items with guaranteed count intervals: item, n_low, n_high, n (recounted), certain.

    An item counts once per distinct id. Null and empty items are left out, as are all other columns.
    `epsilon` fixes the memory of a task, about log(epsilon * rows) / epsilon entries, whatever the data are: an item
    of which no task kept an entry occurs at most epsilon * rows times. Candidates are all items whose upper bound
    reaches the k-th lower bound; a second scan recounts them exactly, with the candidates broadcast only if they are
    at most `broadcast_rows`. `certain` tells that n exceeds what any dropped item can have, so that the row belongs
    here for sure; where counts are so even that it is false, a smaller epsilon (and more memory) is the caller's
    choice. Ties at the limit are all returned. An empty table gives an empty result.
    """
    items = df.select(F.col(id_col).alias("__id"), F.col(item).alias("item")).filter(F.col("item").isNotNull() & (F.col("item") != ""))
    keyed = items.withColumn("h", F.xxhash64("item"))
    # 16 bytes per row shuffle here instead of the item.
    once = keyed.select("__id", "h").distinct().select("h")
    merged, missed = merged_summary(once, epsilon)
    top = merged.select("low").orderBy(F.desc("low")).limit(k).agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("low")).first()
    kth = top["low"] if top["c"] == k else 0
    found = materialize(merged.filter(F.col("high") >= F.lit(kth)))
    rows = found.count()
    wanted = F.broadcast(found) if rows <= broadcast_rows else found
    counted = keyed.join(wanted, "h").select("item", "__id", "low", "high").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("n_low"), F.max("high").alias("n_high"))
    limit = counted.select("n").orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("__least"))
    return counted.join(F.broadcast(limit)).filter(F.col("n") >= F.col("__least")).select("item", "n_low", "n_high", "n", (F.col("n") > F.lit(missed)).alias("certain"))


def frequent_sequences(reads: DataFrame, k: int = 20, epsilon: float = 1e-4) -> DataFrame:
    return frequent_items(reads.select("read_id", clean_seq("seq").alias("seq")), "read_id", "seq", k, epsilon).withColumnRenamed("item", "seq")
