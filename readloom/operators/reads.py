"""Reads as operators want them: each once, without left-over line ends, with a quality for every base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENDS = "\r\n"


def line(col: str) -> Column:
    """Without CR and LF at the end; null becomes empty."""
    return F.rtrim(F.coalesce(F.col(col), F.lit("")), F.lit(_ENDS))


def quality(qual: str, seq: str) -> Column:
    """A missing quality is K for every base."""
    return F.when(F.col(qual).isNull(), F.repeat(F.lit("K"), F.length(line(seq)))).otherwise(line(qual))


def single_reads(df: DataFrame, *more: str) -> DataFrame:
    """read_id, seq and of name, strand, qual those asked for; each read once however often delivered.

    Only these columns are read and shuffled. A null sequence is an empty one, so no read is lost.
    """
    made = {"name": line("name"), "qual": quality("qual", "seq"), "strand": F.coalesce(line("strand"), F.lit("+"))} if more else {}
    return df.select("read_id", line("seq").alias("seq"), *(made[c].alias(c) for c in more)).distinct()


def read_pairs(df: DataFrame, *more: str) -> DataFrame:
    """read_id, s1, s2 and of name, q1, q2 those asked for; each pair once."""
    made = {"name": line("name"), "q1": quality("q1", "s1"), "q2": quality("q2", "s2")} if more else {}
    return df.select("read_id", line("s1").alias("s1"), line("s2").alias("s2"), *(made[c].alias(c) for c in more)).distinct()


def join_mates(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """The positional join of two files: mates have the same ordinal; a read without mate is left out."""
    a = r1.select("read_id", F.col("name"), F.col("seq").alias("s1"), F.col("qual").alias("q1"))
    b = r2.select("read_id", F.col("seq").alias("s2"), F.col("qual").alias("q2"))
    return a.join(b, "read_id")


def interleave(pairs: DataFrame) -> DataFrame:
    """Two rows a pair, mate 1 before mate 2: read_id, mate, name, seq, qual."""
    mates = F.array(*(F.struct(F.lit(m).alias("mate"), F.col(f"s{m}").alias("seq"), F.col(f"q{m}").alias("qual")) for m in (1, 2)))
    return pairs.select("read_id", "name", F.inline(mates)).select("read_id", "mate", "name", "seq", "qual")


def deinterleave(reads: DataFrame) -> DataFrame:
    """Pairs from one interleaved file: ordinals 2k and 2k + 1 are the mates of pair k. A read whose neighbour is missing, such as an
    odd last one, is left out. Both mates meet in one aggregation: one scan and one shuffle."""
    first = F.col("read_id") % 2 == 0
    of = lambda c, when, name: F.max(F.when(when, F.col(c))).alias(name)
    both = reads.groupBy(F.floor(F.col("read_id") / 2).alias("read_id")).agg(
        F.count(F.when(first, 1)).alias("__a"), F.count(F.when(~first, 1)).alias("__b"), of("name", first, "name"), of("seq", first, "s1"), of("qual", first, "q1"), of("seq", ~first, "s2"), of("qual", ~first, "q2")
    )
    return both.filter("__a > 0 AND __b > 0").drop("__a", "__b")


def fastq_lines(reads: DataFrame) -> DataFrame:
    """read_id and the record's four lines as one text."""
    return reads.select("read_id", F.concat_ws("\n", "name", "seq", "strand", "qual").alias("record"))


def bounded_head(reads: DataFrame, size: Column, most_rows: int, most_size: int) -> DataFrame:
    """The first reads in file order, up to and including the one that reaches either limit.

    read_id is the ordinal in the file, so the head lies below some id. The bound is searched in growing steps, each
    a filter on ids that reaches the scan: a long file is never read to its end. Then sums of blocks of ids come
    first and only the last block is sorted.
    """
    from pyspark.sql import Window as W

    bound, seen = 1 << 18, -1
    while True:
        below = reads.filter(F.col("read_id") < bound)
        n, total = below.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if n >= most_rows or total >= most_size:
            break
        # A step that found nothing new, and the first one, look whether anything is left at all.
        if seen in (-1, n) and (bound >= 1 << 58 or reads.filter(F.col("read_id") >= bound).limit(1).count() == 0):
            return reads
        bound, seen = bound << 4, n
    block = F.floor(F.col("read_id") / 65536)
    sums = below.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"))
    upto = W.orderBy("b")  # one row for each 65536 ids of the head
    sums = sums.withColumns({"n1": F.sum("n").over(upto), "s1": F.sum("s").over(upto)})
    last = sums.filter((F.col("n1") >= most_rows) | (F.col("s1") >= most_size)).orderBy("b").select("b", (F.col("n1") - F.col("n")).alias("n"), (F.col("s1") - F.col("s")).alias("s")).first()
    head = reads.filter(F.col("read_id") < last["b"] * 65536)
    edge = reads.filter((F.col("read_id") >= last["b"] * 65536) & (F.col("read_id") < (last["b"] + 1) * 65536))
    order = W.orderBy("read_id").rowsBetween(W.unboundedPreceding, -1)  # one block of ids
    counted = edge.withColumns({"__n": F.count(F.lit(1)).over(order) + last["n"], "__s": F.coalesce(F.sum(size).over(order), F.lit(0)) + last["s"]})
    return head.unionByName(counted.filter((F.col("__n") < most_rows) & (F.col("__s") < most_size)).drop("__n", "__s"))
