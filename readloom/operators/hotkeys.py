"""Per-key results when a few keys hold most rows.

Algebraic aggregates only: every task folds its rows into a bounded hash table (Spark's partial
aggregate, which spills), so what shuffles is one small state per key and task, however hot the key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.common import clean_seq, materialize


def delivered_once(df: DataFrame, id_col: str, *cols: Column) -> DataFrame:
    """One row per id and content. Ids are spread evenly, so no key is hot here.

    A row delivered again repeats its content, hence distinct rows are distinct records. A null id is
    a value like any other: its rows count once per content.
    """
    return df.select(F.col(id_col).alias("__id"), *cols).distinct()


def key_totals(df: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """One row per key. All aggregates must be algebraic (count, sum, min, max): their states are merged."""
    return df.groupBy(key).agg(*aggregates)


def prefix_groups(reads: DataFrame, width: int = 12) -> DataFrame:
    """For every beginning of `width` letters: reads, bases, lengths, GC bases, share of all reads.

    Needs `read_id` and `seq`; other columns are ignored. Sequences are upper-cased and trimmed; reads
    with a null or shorter sequence have no beginning and count only in `all_reads`. An empty table
    gives an empty result. Share = reads / all distinct reads.
    """
    seq = F.col("__seq")
    long_enough = F.length(seq) >= width
    once = delivered_once(
        reads.select("read_id", clean_seq("seq").alias("__seq")),  # a projection of its own: computed once per row
        "read_id",
        F.when(long_enough, F.substring(seq, 1, width)).alias("key12"),
        F.when(long_enough, F.length(seq)).alias("__len"),
        F.when(long_enough, F.length(seq) - F.length(F.translate(seq, "GC", ""))).alias("__gc"),
    )
    totals = materialize(
        key_totals(
            once,
            "key12",
            [
                F.count(F.lit(1)).alias("n_reads"),
                F.sum("__len").alias("bases"),
                F.min("__len").alias("min_len"),
                F.max("__len").alias("max_len"),
                F.sum("__gc").alias("gc_bases"),
            ],
        )
    )
    # All reads, from the per-key states: reads without a beginning have the null key.
    everything = totals.agg(F.coalesce(F.sum("n_reads"), F.lit(0)).alias("n")).first()["n"]
    return (
        totals.filter(F.col("key12").isNotNull())
        .withColumn("all_reads", F.lit(everything).cast("bigint"))
        .withColumn("share", F.try_divide("n_reads", "all_reads"))
    )


def hot_prefixes(reads: DataFrame, width: int = 12, more_than: str = "0.03") -> DataFrame:
    """The beginnings that more than `more_than` of all reads have."""
    g = prefix_groups(reads, width)
    return g.filter(F.col("n_reads") > F.lit(Decimal(more_than)) * F.col("all_reads"))
