"""Statistics of long reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.ragged import flat
from readloom.operators.stats import bases_from, with_quality_sum


def long_totals(reads: DataFrame, phred: int = 33) -> DataFrame:
    """One row: reads, bases, bases of quality 5, 10, 15 or more, mean and longest length."""
    q = {f"q{n}_bases": F.coalesce(F.sum(bases_from("qual", n, phred)), F.lit(0)).cast("bigint").alias(f"q{n}_bases") for n in (5, 10, 15)}
    return reads.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("bases"), *q.values(), F.round(F.avg(F.length("seq")), 6).alias("mean_length"), F.max(F.length("seq")).alias("max_length"))


def long_lengths(reads: DataFrame, step: int = 10) -> DataFrame:
    """Reads by length, in steps that end at multiples of `step`."""
    return reads.groupBy(F.ceil(F.length("seq") / step).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("reads"))


def _ends(size: int, phred: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size, 256), np.int64)
        quals = np.zeros((2, size), np.int64)
        for batch in batches:
            text, offsets = flat(batch.column(0))
            qual, qoffsets = flat(batch.column(1))
            length = np.diff(offsets)
            n = np.minimum(size, length)
            first = np.concatenate([[0], np.cumsum(n)])
            pos = np.arange(first[-1]) - np.repeat(first[:-1], n)
            same = np.repeat(np.diff(qoffsets) == length, n)
            for side in (0, 1):
                begin = np.repeat(length - n if side else np.zeros_like(n), n) + pos
                place = np.repeat(offsets[:-1], n) + begin
                np.add.at(counts[side], (pos, text[place]), 1)
                q = qual[(np.repeat(qoffsets[:-1], n) + begin)[same]].astype(np.int64) - phred
                quals[side] += np.bincount(pos[same], weights=q, minlength=size).astype(np.int64)
        side, pos = np.divmod(np.arange(2 * size), size)
        flat_counts = counts.reshape(2 * size, 256)
        yield pa.RecordBatch.from_arrays(
            [pa.array([("head", "tail")[s] for s in side], pa.string()), pa.array(pos.astype(np.int32)), *(pa.array(flat_counts[:, b]) for b in b"ATCG"), pa.array(quals.reshape(-1)), pa.array(flat_counts.sum(axis=1))],
            ["part", "pos", "a", "t", "c", "g", "q", "n"],
        )

    return run


def long_ends(reads: DataFrame, size: int = 100, phred: int = 33) -> DataFrame:
    """part (head, tail), pos, counts of A, T, C, G, quality_sum, bases, for the first and last `size` positions.

    A shorter read's tail counts from its own first position. Case matters; quality is not floored."""
    parts = reads.select("seq", "qual").mapInArrow(_ends(size, phred), "part string, pos int, a bigint, t bigint, c bigint, g bigint, q bigint, n bigint")
    return parts.groupBy("part", "pos").agg(*(F.sum(c).alias(c) for c in "atcg"), F.sum("q").alias("quality_sum"), F.sum("n").alias("bases")).filter("bases > 0")


def long_top(reads: DataFrame, k: int = 5) -> DataFrame:
    """The k best reads by mean quality and by length, earlier reads first in ties: list, place, read_id, length, mean_quality.

    Two top-k queries: every task keeps k rows and only those are merged."""
    sized = reads.withColumn("length", F.length("seq")).filter("length > 0")
    scored = with_quality_sum(sized, "read_id", "length", floor=False).withColumn("mean_quality", F.col("quality_sum") / F.col("length"))
    out = None
    for name, col in (("quality", "mean_quality"), ("length", "length")):
        best = scored.orderBy(F.desc(col), "read_id").limit(k)
        rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col(col)).alias("o"), "read_id", "length", "mean_quality"))).alias("r"))
        rows = rows.select(F.lit(name).alias("list"), F.posexplode("r").alias("p", "x")).select("list", (F.col("p") + 1).alias("place"), "x.read_id", "x.length", F.round("x.mean_quality", 6).alias("mean_quality"))
        out = rows if out is None else out.unionByName(rows)
    return out
