"""Queries over files: a table is written through a sink to the shared folder and read back through a source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import sinks
from readloom.common import scratch, table
from readloom.operators import correct, reads
from readloom.options import Options
from readloom.plans import pipeline
from readloom.queries.correct_sql import READY
from readloom.queries.sql import _CUT_BOTH, PE, SE, _code
from readloom.sources import fastq

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def named(spark: SparkSession, d: str) -> DataFrame:
    """Reads that a file can hold: a record begins with @."""
    return reads.single_reads(table(spark, d, "reads_se"), "name", "strand", "qual").filter(F.col("name").startswith("@") & F.col("strand").startswith("+"))


def named_pairs(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_pairs(table(spark, d, "reads_pe"), "name", "q1", "q2").filter(F.col("name").startswith("@"))


@query
def file_fastq(spark, d):
    """Ordered FASTQ, read back by ranges of 256 KiB: ordinals follow the order of the table's ids."""
    path = scratch(spark, "fastq")
    sinks.write_fastq(named(spark, d), path)
    return fastq.read_fastq(spark, path, 1 << 18)


@query
def file_gzip(spark, d):
    path = scratch(spark, "gzip")
    sinks.write_fastq(named(spark, d), path, gzip=True, level=1)
    return fastq.read_fastq(spark, path)


@query
def file_unordered(spark, d):
    """Without an order, over an output that is there already."""
    path = scratch(spark, "unordered")
    sinks.write_fastq(named(spark, d).limit(1), path)
    sinks.write_fastq(named(spark, d), path, keep_order=False, overwrite=True)
    return fastq.read_fastq(spark, path, 1 << 20).drop("read_id")


@query
def file_pairs(spark, d):
    path = scratch(spark, "pairs")
    sinks.write_pairs(named_pairs(spark, d), f"{path}/1", f"{path}/2")
    return fastq.read_pairs(spark, f"{path}/1", f"{path}/2", 1 << 18)


@query
def file_interleaved(spark, d):
    path = scratch(spark, "interleaved")
    sinks.write_interleaved(named_pairs(spark, d), path, gzip=True)
    return fastq.read_interleaved(spark, path)


@query
def file_fasta(spark, d):
    """Records of several lines of 60 letters, those of less than 200 letters left out on reading."""
    path = scratch(spark, "fasta")
    rows = table(spark, d, "fasta_records").select("gid", F.regexp_replace(F.coalesce("seq", F.lit("")), r"\s", "").alias("seq")).distinct()
    lines = F.concat(F.lit(">g"), F.col("gid"), F.lit(" of file\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    rows.orderBy("gid").select(lines).write.text(path)
    return fastq.read_fasta(spark, path, 200, 1 << 18).select("name", "comment", "seq")


@query
def file_adapters(spark, d):
    path = scratch(spark, "adapters")
    rows = table(spark, d, "adapters").select(F.concat_ws("\t", F.concat(F.lit("a"), F.col("ord")), F.upper(F.trim("seq")))).distinct()
    rows.coalesce(1).write.text(path)
    return fastq.read_adapters(spark, path)


@query
def file_broken(spark, d):
    """Records whose third line lost its + are told apart, with their reason."""
    path = scratch(spark, "broken")
    rows = named(spark, d)
    strand = F.when(F.col("read_id") % 10 == 3, F.lit("-")).otherwise(F.col("strand"))
    rows.orderBy("read_id").select(F.concat_ws("\n", "name", "seq", strand, "qual")).write.text(path)
    return fastq.broken_records(spark, path, 1 << 18).groupBy("reason").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("letters"))


@query
def file_snapshot(spark, d):
    """Prepared reads saved by one run and loaded by another that has no reads of its own."""
    path = scratch(spark, "snapshot")
    t = reads.single_reads(table(spark, d, "reads_se"), "qual")
    correct.ready_reads(t, Options(save_reads=path))
    return correct.ready_reads(t.limit(0), Options(load_reads=path))


@query
def run_files(spark, d):
    """A whole run from a file to a file: both ends cut, filtered, in order."""
    path = scratch(spark, "run")
    sinks.write_fastq(named(spark, d), f"{path}/in")
    pipeline.run(spark, Options(in_file1=f"{path}/in", out_file1=f"{path}/out", trim_adapter=False, cut5=True, cut3=True, front1=2, tail1=1))
    return fastq.read_fastq(spark, f"{path}/out", 1 << 18).select("name", "seq", "qual")


@query
def log_lines(spark, d):
    """The text of the log: totals, results of the filter, rate of duplicates."""
    o = Options(trim_adapter=False)
    t = pipeline.single(named(spark, d), o).tables
    text = sinks.summary_text(t["before_totals"], t["filter"], t["duplicates"], adapters=t["adapters"])
    return spark.createDataFrame([(x,) for x in text.splitlines() if not x.startswith(("mean", "duplication"))], "line string")


def oracle_sql() -> dict[str, str]:
    n = f"{SE}, n AS (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS ordinal FROM se WHERE starts_with(name, '@') AND starts_with(strand, '+'))"
    p = f"{PE}, n AS (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS ordinal FROM pe WHERE starts_with(name, '@'))"
    pairs = f"WITH {p} SELECT ordinal AS read_id, name, s1, q1, s2, q2 FROM n"
    ordered = f"WITH {n} SELECT ordinal AS read_id, name, seq, strand, qual FROM n"
    totals = ("reads", "count(*)"), ("bases", "sum(length(seq))"), ("max length", "max(length(seq))")
    codes = (0, "passed"), (1, "too many N"), (2, "too short"), (3, "too long"), (4, "low quality")
    gc = "sum(length(seq) - length(translate(seq, 'GCgc', '')))"
    below = lambda q: "'" + "".join(map(chr, range(33, 33 + q))).replace("'", "''") + "'"
    high = [(f"q{q} bases", f"sum(length(translate(qual, {below(q)}, '')))") for q in (20, 30)]
    lines = [f"SELECT '{k} ' || CAST({v} AS BIGINT) AS line FROM n" for k, v in (*totals, *high, ("gc bases", gc))]
    lines += [f"SELECT '{name} ' || count(*) FILTER ({_code('seq', 'qual')} = {code}) FROM n" for code, name in codes]
    return {
        "file_fastq": ordered,
        "file_gzip": ordered,
        "file_unordered": f"WITH {n} SELECT name, seq, strand, qual FROM n",
        "file_pairs": pairs,
        "file_interleaved": pairs,
        "file_fasta": "SELECT DISTINCT 'g' || gid AS name, 'of file' AS comment, regexp_replace(coalesce(seq, ''), '\\s', '', 'g') AS seq FROM fasta_records WHERE length(regexp_replace(coalesce(seq, ''), '\\s', '', 'g')) >= 200",
        "file_adapters": "SELECT DISTINCT 'a' || ord AS name, upper(trim(seq)) AS seq FROM adapters",
        "file_broken": f"WITH {n} SELECT 'separator' AS reason, count(*) AS records, CAST(sum(length(name) + length(seq) + length(qual) + 4) AS BIGINT) AS letters FROM n WHERE read_id % 10 = 3",
        "file_snapshot": f"WITH {READY} SELECT read_id, seq, qual FROM ready",
        "run_files": f"""WITH cut AS ({_CUT_BOTH}), names AS (WITH {n} SELECT read_id, name FROM n)
SELECT name, seq, qual FROM cut JOIN names USING (read_id) WHERE trimmed_ok AND {_code('seq', 'qual')} = 0""",
        "log_lines": f"WITH {n} " + " UNION ALL ".join(lines),
    }
