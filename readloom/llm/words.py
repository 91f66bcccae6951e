"""Occurrences and record counts of words of any length, from suffix arrays with common-prefix intervals.

A batch of records is one text. Its suffix array orders all suffixes by their first `depth` symbols, and beside it stands the common prefix of each suffix with the one before. Both hold for every word length n up
to the depth: the suffixes between two places where the common prefix is less than n are the occurrences of one word. For
the number of records every suffix whose nearest earlier suffix of the same record lies in the same interval is a
duplicate and is subtracted. Intervals of all batches are summed by word, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.common import clean_seq, delivered_once, materialize

_INTERVALS = "n int, word bigint, occurrences bigint, records bigint"
#: Symbols of three bits that one machine word holds; the first sort orders suffixes by as many.
PACKED = 21
#: Longest words that are counted: as many letters as fit 63 bits.
LONGEST = 31
#: Ends a record in the text; smaller than every letter.
END = 0


def packed_prefixes(text: np.ndarray) -> np.ndarray:
    """The first 21 symbols of each suffix as one number, so that numbers are ordered like suffixes."""
    n = len(text)
    key, width = text.astype(np.uint64), 1
    for step in (1, 2, 4, 8, 5):  # widths 2, 4, 8, 16, 21
        more = np.zeros(n, np.uint64)
        more[: max(0, n - width)] = key[width:] >> np.uint64(3 * (width - step))
        key = key << np.uint64(3 * step) | more
        width += step
    return key


def suffix_array(text: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text ordered by the first `depth` symbols (0 to 7) of their suffixes; `key`: packed_prefixes.

    The first sort takes 21 symbols at once; then ranks are doubled, and only suffixes that are still tied are
    sorted again.
    """
    n = len(text)
    order = np.argsort(key)
    have = PACKED
    if depth <= have or not n:
        return order
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    while True:
        # A suffix's rank is the place of the first of its equals, so ranks of separated suffixes stay.
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if have >= depth or not len(tied):
            return order
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = first, -1
        after = rank[np.minimum(order[tied] + have, n)]
        again = np.lexsort((after, first[tied]))
        order[tied] = order[tied][again]
        apart = (first[tied][again][1:] != first[tied][again][:-1]) | (after[again][1:] != after[again][:-1])
        fresh[tied] = np.concatenate([[True], apart])
        have *= 2


def common_prefixes(text: np.ndarray, key: np.ndarray, order: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """Letters, up to `most`, that each suffix of the array shares with the one before it; `run`: letters before its end."""
    n = len(text)
    x = key[order]
    x[1:] ^= x[:-1].copy()
    x[:1] = np.iinfo(np.uint64).max >> 1
    # The highest differing bit, found without rounding up, tells the first differing symbol.
    bits = np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1]
    out = np.minimum((3 * PACKED - bits) // 3, run).astype(np.int64)
    if most > PACKED and n:
        ended = np.append(text, END)
        live = np.flatnonzero((x == 0) & (run > PACKED))
        for j in range(PACKED, most):
            live = live[(ended[np.minimum(order[live] + j, n)] == ended[np.minimum(order[live - 1] + j, n)]) & (run[live] > j)]
            out[live] = j + 1
    return out


def earlier_of_record(record: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the nearest earlier place of the same record, or -1."""
    own = record[order].astype(np.uint16 if len(record) and record[-1] < 1 << 16 else np.uint32)
    by = np.argsort(own, kind="stable")
    out = np.full(len(order), -1, np.int64)
    same = own[by[1:]] == own[by[:-1]]
    out[by[1:][same]] = by[:-1][same]
    return out


def intervals(prefix: np.ndarray, earlier: np.ndarray, n: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place in the suffix array, occurrences, records) of every word of n letters. `valid`: per place of the suffix
    array, whether n letters begin there; all suffixes of an interval are alike in this."""
    begins = prefix < n
    begins[:1] = True
    number = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    length = np.diff(np.append(starts, len(prefix)))
    again = (earlier >= 0) & (number[earlier] == number)
    repeated = np.bincount(number[again], minlength=len(starts))
    keep = valid[starts]
    return starts[keep], length[keep], (length - repeated)[keep]


#: Letters by their order; every other one ends a word and equals nothing, as the end of a record does.
_CODE = np.full(256, END, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i + 1


def _count_batches(lengths: Sequence[int], depth: int, text_bytes: int):
    def one(values: pa.Array) -> Iterator[pa.RecordBatch]:
        data = values.drop_null().cast(pa.large_binary())
        size = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1])
        begin = int(np.frombuffer(data.buffers()[1], np.int64)[data.offset]) if len(data) else 0
        raw = np.frombuffer(data.buffers()[2], np.uint8)[begin : begin + int(size.sum())] if size.sum() else np.empty(0, np.uint8)
        # Each record is followed by an end.
        record = np.repeat(np.arange(len(data)), size + 1)
        text = np.zeros(len(record), np.uint8)
        text[np.arange(len(raw)) + np.repeat(np.arange(len(data)), size)] = _CODE[raw]
        key = packed_prefixes(text)
        order = suffix_array(text, key, depth)
        ends = np.flatnonzero(text == END)
        ahead = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text))  # letters up to the next end
        run = ahead[order]
        prefix = common_prefixes(text, key, order, run, max(lengths))
        earlier = earlier_of_record(record, order)
        # The row without a word carries the number of rows.
        yield _rows(0, [None], [0], [len(values)])
        for n in lengths:
            at, occurrences, records = intervals(prefix, earlier, n, run >= n)
            code = np.zeros(len(at), np.int64)
            for j in range(n):
                code = code << 2 | (text[order[at] + j].astype(np.int64) - 1)
            yield _rows(n, code, occurrences, records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []
        size = 0
        for batch in batches:
            waiting.append(batch.column(0))
            size += batch.column(0).nbytes
            if size >= text_bytes:
                yield from one(pa.concat_arrays(waiting))
                waiting, size = [], 0
        if waiting:
            yield from one(pa.concat_arrays(waiting))

    return run


def _rows(n: int, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), n, np.int32)), *(pa.array(c, pa.int64()) for c in columns)], ["n", "word", "occurrences", "records"])


def word_counts(once: DataFrame, seq: str, lengths: Sequence[int] = (6,), text_bytes: int = 2 << 20) -> DataFrame:
    """n, word (two bits a letter), occurrences, records for one row per record, for all lengths from one suffix array
    per batch; the row with a null word and n = 0 has the number of rows.

    `text_bytes` bounds the text of one suffix array (a single longer record still is one text).
    """
    if not lengths or min(lengths) < 1 or max(lengths) > LONGEST:
        raise ValueError(f"words have 1 to {LONGEST} letters")
    return (
        once.select(seq)
        .mapInArrow(_count_batches(sorted(set(lengths)), max(PACKED, *lengths), text_bytes), _INTERVALS)
        .groupBy("n", "word")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def letters_of(word: str, n: str):
    """The letters of a word of n letters that is packed in two bits a letter."""
    digits = F.expr(f"transform(sequence(1, {n}), i -> substring('ACGT', 1 + cast(shiftright({word}, 2 * ({n} - i)) & 3 as int), 1))")
    return F.when(F.col(word).isNotNull(), F.array_join(digits, ""))


def marked_words(reads: DataFrame, n: int | Sequence[int] = 6, rare: str = "0.002", common: str = "0.1") -> DataFrame:
    """n, kmer, occurrences, reads, all_reads, mark for every word of n letters ACGT in `seq`, for one or more n.

    A read counts once however often it was delivered; `all_reads` counts reads with or without a sequence.
    `mark` is `rare` below the first share of all reads, `common` above the second, else null. Needs
    `read_id` and `seq`; a null, empty or short sequence has no words. An empty table gives an empty result.
    """
    once = delivered_once(reads.select("read_id", clean_seq("seq").alias("seq")), "read_id")
    # Written once, since the row without a word gives the number of reads.
    counts = materialize(word_counts(once, "seq", [n] if isinstance(n, int) else n))
    total = counts.filter(F.col("word").isNull()).agg(F.coalesce(F.max("records"), F.lit(0)).alias("n")).first()["n"]
    counts = counts.withColumn("all_reads", F.lit(total).cast("bigint"))
    mark = F.when(F.col("records") < F.lit(Decimal(rare)) * F.col("all_reads"), "rare").when(F.col("records") > F.lit(Decimal(common)) * F.col("all_reads"), "common")
    return counts.filter(F.col("word").isNotNull()).select("n", letters_of("word", "n").alias("kmer"), "occurrences", F.col("records").alias("reads"), "all_reads", mark.alias("mark"))
