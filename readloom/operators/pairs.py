"""Mates: overlap, adapters and corrections by overlap, insert size; the paired chain in one pass over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import kernels as K
from readloom.functions.ragged import Block, flat, matrix, to_strings
from readloom.operators.trim import cut_list, list_match, poly, trim_block, zero_past
from readloom.options import Options

#: Insert sizes from here on, and mates that don't overlap, count as this.
LARGEST_INSERT = 512


def insert_size(found: np.ndarray, offset: np.ndarray, size: np.ndarray, len1: np.ndarray, len2: np.ndarray) -> np.ndarray:
    return np.where(found, np.minimum(np.where(offset > 0, len1 + len2 - size, size), LARGEST_INSERT), LARGEST_INSERT)


def pair_blocks(s1, q1, s2, q2, step: int = 32) -> Iterator[tuple[Block, Block]]:
    """Pairs whose mates are of similar lengths, as two matrices."""
    n1, n2 = np.diff(s1[1]), np.diff(s2[1])
    key = -(-n1 // step) * 1_000_000 + -(-n2 // step)
    zero = np.zeros(len(n1), np.int64)
    for g in np.unique(key):
        rows = np.flatnonzero(key == g)
        w1, w2 = max(1, int(n1[rows].max(initial=0))), max(1, int(n2[rows].max(initial=0)))
        yield (
            Block(rows, n1[rows], matrix(*s1, rows, zero, n1, w1), matrix(*q1, rows, zero, n1, w1)),
            Block(rows, n2[rows], matrix(*s2, rows, zero, n2, w2), matrix(*q2, rows, zero, n2, w2)),
        )


def _rows_to_strings(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """Strings from (row numbers, matrix, lengths) of blocks that cover all rows."""
    length = np.zeros(n, np.int64)
    for rows, _, size in parts:
        length[rows] = size
    offsets = np.concatenate([[0], np.cumsum(length)])
    text = np.empty(offsets[-1], np.uint8)
    for rows, m, size in parts:
        at = np.arange(m.shape[1])
        inside = at < size[:, None]
        text[(offsets[rows][:, None] + at)[inside]] = m[inside]
    return to_strings(text, offsets)


_NUMBERS = ("overlapped", "offset", "overlap", "differences", "insert_size", "corrected", "adapter_bases1", "adapter_bases2", "adapter_reads", "code1", "code2", "code")


def _chain(o: Options, adapters: tuple[str, str], listed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s1, q1, s2, q2 = (flat(batch.column(i)) for i in range(4))
            num = {k: np.zeros(n, np.int64) for k in _NUMBERS}
            parts: dict[str, list] = {k: [] for k in ("s1", "q1", "s2", "q2")}
            for one, two in pair_blocks(s1, q1, s2, q2):
                ok1, _, l1, b1, w1 = trim_block(one, o, 1)
                ok2, _, l2, b2, w2 = trim_block(two, o, 2)
                both = ok1 & ok2
                l1, l2 = poly(b1, l1, both, o), poly(b2, l2, both, o)
                rows = one.rows
                found = np.zeros(len(rows), bool)
                if o.trim_adapter or o.correct_overlap or o.insert_size:
                    found, offset, size, diff = K.overlap(b1, l1, b2, l2, o.overlap_differences, o.overlap_bases)
                    found &= both
                    offset, size, diff = (np.where(found, x, 0) for x in (offset, size, diff))
                    for k, v in (("overlapped", found), ("offset", offset), ("overlap", size), ("differences", diff), ("insert_size", insert_size(found, offset, size, l1, l2))):
                        num[k][rows] = v
                    if o.correct_overlap:
                        num["corrected"][rows] = K.correct_by_overlap(b1, w1, l1, b2, w2, l2, offset, size, o.phred)
                if o.trim_adapter:
                    short = found & (offset < 0) & (size > 0)
                    num["adapter_bases1"][rows] += np.where(short, (l1 - size) + (l2 - size), 0)
                    num["adapter_reads"][rows] += np.where(short, 2, 0)
                    l1, l2 = np.where(short, size, l1), np.where(short, size, l2)
                    zero_past(b1, l1)
                    zero_past(b2, l2)
                    for m, (b, own) in enumerate(((b1, adapters[0]), (b2, adapters[1])), 1):
                        now = l1 if m == 1 else l2
                        taken = np.zeros(len(rows), np.int64)
                        work = b.copy()
                        if own:
                            cut, _, taken = K.cut_adapter(work, now, np.frombuffer(own.encode(), np.uint8))
                            use = both & ~short
                            taken = np.where(use, taken, 0)
                            now = np.where(use, cut, now)
                            work = np.where(use[:, None], work, b)
                        if listed:
                            cut, more = cut_list(work, now, listed, list_match(listed))
                            now, taken = np.where(both, cut, now), taken + np.where(both, more, 0)
                        num[f"adapter_bases{m}"][rows] += taken
                        num["adapter_reads"][rows] += taken > 0
                        zero_past(b, now)
                        if m == 1:
                            l1 = now
                        else:
                            l2 = now
                zero_past(w1, l1)
                zero_past(w2, l2)
                limits = (o.shortest, o.longest, o.low_quality, o.low_percent, o.most_n, o.phred)
                c1, c2 = K.filter_code(b1, w1, l1, ok1, *limits), K.filter_code(b2, w2, l2, ok2, *limits)
                num["code1"][rows], num["code2"][rows], num["code"][rows] = c1, c2, np.maximum(c1, c2)
                for k, m, size_ in (("s1", b1, l1), ("q1", w1, l1), ("s2", b2, l2), ("q2", w2, l2)):
                    parts[k].append((rows, m, size_))
            num["overlapped"] = num["overlapped"].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[4:], *(_rows_to_strings(p, n) for p in parts.values()), *(pa.array(v if v.dtype == bool else v.astype(np.int32)) for v in num.values())],
                [*batch.schema.names[4:], *parts, *num],
            )

    return run


def trim_pairs(pairs: DataFrame, options: Options = Options(), adapters: tuple[str, str] = ("", ""), listed: list[str] | None = None) -> DataFrame:
    """Pairs after trimming, poly tails, overlap analysis, correction, adapters and filtering, in this order.

    Needs s1, q1, s2, q2; all other columns are kept. Added: overlapped, offset, overlap, differences, insert_size,
    corrected, adapter_bases1, adapter_bases2, adapter_reads, code1, code2 and code, the larger of the two.
    A cut by overlap counts both mates' bases for mate 1.
    """
    keep = [c for c in pairs.columns if c not in ("s1", "q1", "s2", "q2")]
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep), "s1 string, q1 string, s2 string, q2 string, overlapped boolean", *(f"{k} int" for k in _NUMBERS[1:])])
    return pairs.select("s1", "q1", "s2", "q2", *keep).mapInArrow(_chain(options, adapters, list(listed or [])), schema)


def insert_sizes(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy("insert_size").agg(F.count(F.lit(1)).alias("pairs"))


def insert_peak(sizes: DataFrame) -> DataFrame:
    """The most frequent insert size below the largest; ties go to the smaller."""
    best = sizes.filter(F.col("insert_size") < LARGEST_INSERT).agg(F.max(F.struct("pairs", (-F.col("insert_size")).alias("s"))).alias("m"))
    return best.select((-F.col("m.s")).alias("peak"), F.col("m.pairs").alias("pairs"))


def pair_filter_summary(analysed: DataFrame) -> DataFrame:
    """Reads by result code of the pair; each pair counts twice."""
    return analysed.groupBy("code").agg((F.count(F.lit(1)) * 2).alias("reads"))
