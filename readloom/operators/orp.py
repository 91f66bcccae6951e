"""Over-represented sequences: hot sequences from the head of the file, then a scan of every n-th read for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.common import materialize, written
from readloom.functions.ragged import flat
from readloom.operators.reads import bounded_head

#: Bases that the head holds, lengths, and the counts that make a sequence hot or reported.
HEAD_BASES = 1_510_000
LENGTHS = (10, 20, 40, 100)
LAST_LENGTH = 150
HOT = ((100, 5), (40, 20), (20, 100), (10, 500))
HOT_WHOLE = 3
REPORTED = ((10, 500), (20, 200), (40, 100), (100, 50))
REPORTED_OTHER = 20


def lengths(longest: int) -> list[int]:
    return [*LENGTHS, min(LAST_LENGTH, longest - 2)]


def head_reads(reads: DataFrame, bases: int = HEAD_BASES) -> DataFrame:
    """The head of the file, of bounded size and written once."""
    return written(bounded_head(reads, F.length("seq"), 1 << 62, bases), "head")


#: Base of the rolling hash; odd, so that it has an inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """64-bit hashes of all windows of a text: a difference of running sums of letter * BASE^place, divided by BASE^start."""

    def __init__(self, text: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.back = _powers(len(text), _BACK)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text.astype(np.uint64) * _powers(len(text), BASE))])

    def hashes(self, places: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[places + k] - self.sums[places]) * self.back[places]


def hash_of(word: bytes) -> int:
    return sum(c * pow(int(BASE), i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)


def _inner_windows(offsets: np.ndarray, k: int) -> np.ndarray:
    """Places of all windows of k letters but the last of each row."""
    length = np.diff(offsets)
    n = np.maximum(0, length - k)
    return np.arange(n.sum()) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)


def _count_hashes(ks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = flat(batch.column(0))
            rolling = Rolling(text)
            for k in ks:
                h, n = np.unique(rolling.hashes(_inner_windows(offsets, k), k), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["k", "h", "n"])

    return run


def _count_words(hot: dict[int, np.ndarray]):
    """Windows whose hash is hot, as words: what is counted in the end are the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = flat(batch.column(0))
            rolling = Rolling(text)
            counts: dict[bytes, int] = {}
            for k, wanted in hot.items():
                places = _inner_windows(offsets, k)
                for p in places[np.isin(rolling.hashes(places, k), wanted)].tolist():
                    w = text[p : p + k].tobytes()
                    counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def hot_sequences(head: DataFrame, longest: int | None = None) -> DataFrame:
    """word, n of the sequences frequent in the head that no longer one of similar frequency contains.

    Offsets run to len - k - 1. Without reads, or with the longest below 3 bases, the result may be empty.
    """
    if longest is None:
        longest = head.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("m")).first()["m"]
    ks = [k for k in lengths(longest) if k > 0]
    def least(size: Column) -> Column:
        out = F.when(size >= longest - 1, HOT_WHOLE)
        for at, n in HOT:
            out = out.when(size >= at, n)
        return out

    # Hashes are counted first, 20 bytes a window; only windows that are frequent by hash become words. Their number is bounded
    # by the head's size.
    hashes = head.select("seq").mapInArrow(_count_hashes(ks), "k int, h bigint, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n"))
    hot_hashes: dict[int, list[int]] = {}
    for r in hashes.filter(F.col("n") >= least(F.col("k"))).select("k", "h").collect():
        hot_hashes.setdefault(r["k"], []).append(r["h"])
    wanted = {k: np.array(v, np.int64).view(np.uint64) for k, v in hot_hashes.items()}
    counts = head.select("seq").mapInArrow(_count_words(wanted), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return without_contained(materialize(counts.filter(F.col("n") >= least(F.length("word")))))


def without_contained(hot: DataFrame, times: int = 10, most_lengths: int = 1000) -> DataFrame:
    """Drop a word that a longer or other word contains unless it is `times` as frequent (whole quotient).

    Containment is an equality join: every word is cut into its windows of the lengths that occur. Hot words have
    five lengths; more than `most_lengths` are refused.
    """
    sizes = [r["k"] for r in hot.select(F.length("word").alias("k")).distinct().limit(most_lengths + 1).collect()]
    if len(sizes) > most_lengths:
        raise ValueError(f"words of more than {most_lengths} lengths")
    inner = None
    for k in sorted(sizes):
        w = hot.filter(F.length("word") > k).select(F.explode(F.expr(f"transform(sequence(1, length(word) - {k} + 1), i -> substring(word, i, {k}))")).alias("word"), F.col("n").alias("n2"))
        inner = w if inner is None else inner.unionByName(w)
    if inner is None:
        return hot
    # Of all holders the most frequent decides: floor(n / n2) < times for some n2 if it holds for the largest.
    most = inner.groupBy("word").agg(F.max("n2").alias("n2"))
    return hot.join(most, "word", "left").filter(F.col("n2").isNull() | (F.floor(F.col("n") / F.col("n2")) >= times)).select("word", "n")


class HotWords:
    """Hot words by length as hashes for whole batches at once; hits are confirmed on the words themselves."""

    def __init__(self, words: list[str]) -> None:
        self.by: dict[int, tuple[np.ndarray, set[bytes]]] = {}
        for k in sorted({len(w) for w in words}):
            own = {w.encode() for w in words if len(w) == k}
            self.by[k] = np.sort(np.array([hash_of(w) for w in own], np.uint64)), own

    def hits(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(k, places where a hot word of k letters starts inside a row and a window may be probed)."""
        rolling = Rolling(text)
        row_end = np.repeat(offsets[1:], np.diff(offsets))
        row_start = np.repeat(offsets[:-1], np.diff(offsets))
        at = np.arange(len(text))
        for k, (hashes, words) in self.by.items():
            # the first window is always probed, the last one only if it is the first
            places = np.flatnonzero((at + k <= row_end) & ((at == row_start) | (at + k < row_end)))
            if len(places):
                h = rolling.hashes(places, k)
                i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                yield k, np.array([p for p in places[hashes[i] == h] if text[p : p + k].tobytes() in words], np.int64)


def _scan(words: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = HotWords(words)
        counts: dict[bytes, np.ndarray] = {}
        for batch in batches:
            text, offsets = flat(batch.column(0))
            row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for k, places in hot.hits(text, offsets):
                row, free = -1, 0
                for p in places.tolist():
                    if row_of[p] != row:
                        row, free = row_of[p], 0
                    if p < free:
                        continue
                    free = p + k + 1  # the next k offsets aren't probed
                    w = text[p : p + k].tobytes()
                    if w not in counts:
                        counts[w] = np.zeros(width + 2, np.int64)
                    start = p - offsets[row]
                    counts[w][0] += 1
                    counts[w][1 + min(start, width)] += 1
        # how many hits start at each position; what they cover follows from it
        rows = [(w, c) for w, c in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w, c in rows for _ in np.flatnonzero(c[1:])], pa.string()), pa.array([int(p) for _, c in rows for p in np.flatnonzero(c[1:])], pa.int32()), pa.array([int(c[1 + p]) for _, c in rows for p in np.flatnonzero(c[1:])], pa.int64())],
            ["word", "start", "n"],
        )

    return run


def scan_hot(reads: DataFrame, words: list[str], longest: int, every: int = 20) -> DataFrame:
    """word, start, n: hits of hot words in every n-th read, by the position they start at.

    The words come from a head of bounded size, hence so do they. In each read and length a hit hides the next k offsets.
    """
    if not words:
        return reads.sparkSession.createDataFrame([], "word string, start int, n bigint")
    sample = reads.filter(F.col("read_id") % every == 0).select("seq")
    return sample.mapInArrow(_scan(words, longest), "word string, start int, n bigint").groupBy("word", "start").agg(F.sum("n").alias("n"))


def reported(count: Column, word: str = "word", every: int = 20) -> Column:
    size, scaled = F.length(word), count * every
    rule = None
    for k, n in REPORTED:
        rule = F.when(size == k, scaled > n) if rule is None else rule.when(size == k, scaled > n)
    return rule.otherwise(scaled > REPORTED_OTHER)


def overrepresented(reads: DataFrame, every: int = 20, only_reported: bool = True) -> DataFrame:
    """word, n, positions (start -> hits): over-represented sequences of the reads (read_id in file order, seq)."""
    head = head_reads(reads)
    longest = head.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("m")).first()["m"]
    words = [r["word"] for r in hot_sequences(head, longest).collect()]  # bounded by the head
    hits = scan_hot(reads, words, longest, every)
    out = hits.groupBy("word").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("start", "n")))).alias("starts"))
    return out.filter(reported(F.col("n"), every=every)) if only_reported else out
