"""Duplicate estimation: reads share a key of 12 bases; of each key the least word of 32 bases is followed.

Order of bases is A, T, C, G. The unsigned start that would underflow for reads of 32 to 36 bases starts at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(word: Column, size: int) -> Column:
    return (F.length(word) == size) & ~word.rlike("[^ATCG]")


def gc_byte(gc: Column, length: Column) -> Column:
    return F.floor(255.0 * gc / length + 0.5).cast("int")


def _gc(seq: str) -> Column:
    return F.length(seq) - F.length(F.translate(F.col(seq), "GC", ""))


def key_words_single(reads: DataFrame) -> DataFrame:
    """key12, word32, gc of every read of at least 32 bases with plain words."""
    start = F.greatest(F.lit(0), F.length("seq") - 37)
    rows = reads.filter(F.length("seq") >= 32).select(F.substring("seq", 1, 12).alias("key12"), F.substr(F.col("seq"), start + 1, F.lit(32)).alias("word32"), gc_byte(_gc("seq"), F.length("seq")).alias("gc"))
    return rows.filter(_plain(F.col("key12"), 12) & _plain(F.col("word32"), 32))


def key_words_pairs(pairs: DataFrame) -> DataFrame:
    """Key from mate 1, word from mate 2, GC of both."""
    rows = pairs.filter((F.length("s1") >= 32) & (F.length("s2") >= 32)).select(F.substring("s1", 1, 12).alias("key12"), F.substring("s2", 1, 32).alias("word32"), gc_byte(_gc("s1") + _gc("s2"), F.length("s1") + F.length("s2")).alias("gc"))
    return rows.filter(_plain(F.col("key12"), 12) & _plain(F.col("word32"), 32))


def followed_words(rows: DataFrame) -> DataFrame:
    """Per key: the least word, how often it occurs, its least GC. Two aggregations, so a hot key is one row per word
    before the second; both have partial states."""
    counted = rows.groupBy("key12", F.translate("word32", "ATCG", "0123").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("gc").alias("gc"))
    least = counted.groupBy("key12").agg(F.min(F.struct("w", "n", "gc")).alias("m"))
    return least.select("key12", F.translate("m.w", "0123", "ATCG").alias("word32"), F.col("m.n").alias("n"), F.col("m.gc").alias("gc"))


def duplicate_rate(followed: DataFrame) -> DataFrame:
    """One row: keys, reads counted, duplicates and their share."""
    return followed.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("reads"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.round(F.coalesce(F.sum(F.col("n") - 1) / F.sum("n"), F.lit(0.0)), 9).alias("rate"),
    )


def duplicate_histogram(followed: DataFrame, size: int = 32) -> DataFrame:
    """Keys and mean GC by number of copies; the last bin takes all from size - 1 on."""
    return followed.groupBy(F.least(F.col("n"), F.lit(size - 1)).alias("copies")).agg(F.count(F.lit(1)).alias("keys"), F.round(F.avg(F.col("gc") / 255.0), 9).alias("mean_gc"))
