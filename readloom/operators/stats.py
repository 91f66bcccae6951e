"""Statistics of short reads. Counts of whole reads stay in the JVM; counts by base are made per Arrow batch with
numpy and only their sums shuffle: a few hundred rows per task instead of one row per base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.ragged import flat


def below(q: int, phred: int = 33) -> str:
    """The quality characters under q."""
    return "".join(map(chr, range(33, phred + q)))


def bases_from(qual: str, q: int, phred: int = 33) -> Column:
    """How many bases have quality q or more."""
    return F.length(F.translate(F.col(qual), below(q, phred), ""))


def gc_bases(seq: str) -> Column:
    return F.length(seq) - F.length(F.translate(F.col(seq), "GCgc", ""))


def totals(reads: DataFrame, phred: int = 33) -> DataFrame:
    """One row: reads, bases, q20, q30, gc bases, mean length, longest read."""
    return reads.agg(
        F.count(F.lit(1)).alias("reads"),
        F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("bases"),
        F.coalesce(F.sum(bases_from("qual", 20, phred)), F.lit(0)).cast("bigint").alias("q20_bases"),
        F.coalesce(F.sum(bases_from("qual", 30, phred)), F.lit(0)).cast("bigint").alias("q30_bases"),
        F.coalesce(F.sum(gc_bases("seq")), F.lit(0)).cast("bigint").alias("gc_bases"),
        F.round(F.avg(F.length("seq")), 6).alias("mean_length"),
        F.max(F.length("seq")).alias("max_length"),
    )


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("reads"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    """Reads by whole percent of G and C; empty reads have none."""
    percent = F.floor(gc_bases("seq") * 100 / F.length("seq")).cast("int")
    return reads.filter(F.length("seq") > 0).groupBy(percent.alias("gc_percent")).agg(F.count(F.lit(1)).alias("reads"))


def filter_code(seq: str, qual: str, trimmed_ok: Column | None = None, shortest: int = 15, longest: int = 500, low_quality: int = 15, low_percent: int = 40, most_n: int = 5, phred: int = 33) -> Column:
    """0 pass, 1 too many N, 2 too short, 3 too long, 4 too many bases of low quality; the first that applies in the order 2 (trimming failed), 3, 2, 4, 1."""
    n = F.length(seq)
    low = n - bases_from(qual, low_quality, phred)
    n_bases = n - F.length(F.translate(F.col(seq), "N", ""))
    code = F.when(n >= longest, 3).when((n == 0) | (n < shortest), 2).when(low * 100 > low_percent * n, 4).when(n_bases > most_n, 1).otherwise(0)
    return code if trimmed_ok is None else F.when(~trimmed_ok, 2).otherwise(code)


def filter_summary(coded: DataFrame) -> DataFrame:
    """Reads and bases by result code."""
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).cast("bigint").alias("bases"))


_LETTERS = np.array(["", "A", "", "C", "T", "", "N", "G"])


def _position_batches(phred: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, quals = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            text, offsets = flat(batch.column(0))
            qual, qoffsets = flat(batch.column(1))
            lengths = np.diff(offsets)
            pos = np.arange(len(text)) - np.repeat(offsets[:-1], lengths)
            key = pos * 8 + (text & 7)
            q = np.zeros(len(text), np.int64)
            same = np.diff(qoffsets) == lengths
            inside = np.repeat(same, lengths)
            q[inside] = np.maximum(qual[np.repeat(same, np.diff(qoffsets))].astype(np.int64) - phred, 0)
            n = np.bincount(key, minlength=len(counts))
            s = np.bincount(key, weights=q, minlength=len(counts)).astype(np.int64)
            n[: len(counts)] += counts
            s[: len(quals)] += quals
            counts, quals = n, s
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((seen // 8).astype(np.int32)), pa.array(_LETTERS[seen % 8].tolist(), pa.string()), pa.array(counts[seen]), pa.array(quals[seen])], ["pos", "base", "n", "q"])

    return run


def by_position(reads: DataFrame, phred: int = 33) -> DataFrame:
    """pos, base, n, quality_sum: bases and their quality (at least 0) at every position, without case."""
    parts = reads.select("seq", "qual").mapInArrow(_position_batches(phred), "pos int, base string, n bigint, q bigint")
    return parts.groupBy("pos", "base").agg(F.sum("n").alias("n"), F.sum("q").alias("quality_sum"))


def _quality_sums(phred: int, floor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qual, offsets = flat(batch.column(0))
            q = qual.astype(np.int64) - phred
            if floor:
                q = np.maximum(q, 0)
            sums = np.concatenate([[0], np.cumsum(q)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], [*batch.schema.names[1:], "quality_sum"])

    return run


def with_quality_sum(reads: DataFrame, *keep: str, phred: int = 33, floor: bool = True) -> DataFrame:
    """The kept columns and the sum of qualities of each read."""
    schema = ", ".join([*(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in keep), "quality_sum bigint"])
    return reads.select("qual", *keep).mapInArrow(_quality_sums(phred, floor), schema)


def mean_quality_histogram(reads: DataFrame, phred: int = 33) -> DataFrame:
    """Reads by the whole part of their mean quality; empty reads have none."""
    sums = with_quality_sum(reads.withColumn("length", F.length("seq")).filter("length > 0"), "length", phred=phred)
    return sums.groupBy(F.floor(F.col("quality_sum") / F.col("length")).cast("int").alias("mean_quality")).agg(F.count(F.lit(1)).alias("reads"))


_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i


def packed_words(text: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(two-bit code of the word of k letters at each place, whether all k are ACGT of one row)."""
    symbols = _CODE[text]
    n = len(text)
    code = np.zeros(n, np.int64)
    for j in range(k):
        part = np.zeros(n, np.int64)
        part[: max(0, n - j)] = symbols[j:] & 3
        code = code << 2 | part
    bad = np.concatenate([[0], np.cumsum(symbols == 4)])
    at = np.arange(n)
    valid = at + k <= np.repeat(offsets[1:], np.diff(offsets))
    valid[valid] = bad[at[valid] + k] == bad[at[valid]]
    return code, valid


def words_of(codes: np.ndarray, k: int) -> list[str]:
    shift = 2 * np.arange(k - 1, -1, -1)
    letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> shift) & 3]
    return [row.tobytes().decode() for row in letters]


def _word_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(4**k, np.int64)
        for batch in batches:
            code, valid = packed_words(*flat(batch.column(0)), k)
            counts += np.bincount(code[valid], minlength=4**k)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(words_of(seen, k), pa.string()), pa.array(counts[seen])], ["kmer", "n"])

    return run


def kmers(reads: DataFrame, k: int = 5) -> DataFrame:
    """Counts of words of k letters (k up to 10), windows with another letter left out; without case."""
    return reads.select("seq").mapInArrow(_word_batches(k), "kmer string, n bigint").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_range(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most"))
