"""Whole runs: single reads, pairs and long reads, from files or tables to passed reads and report tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import sinks
from readloom.common import written
from readloom.operators import correct, detect, duplicate, longread, orp, pairs, stats, trim, umi
from readloom.options import Options
from readloom.sources import fastq


@dataclass
class Result:
    """Reads that passed, all reads with their result code, and the report's tables by name."""

    passed: DataFrame
    coded: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _position_tables(name: str, reads: DataFrame, o: Options) -> dict[str, DataFrame]:
    words = stats.kmers(reads)
    return {
        f"{name}_totals": stats.totals(reads, o.phred),
        f"{name}_positions": stats.by_position(reads, o.phred),
        f"{name}_lengths": stats.length_histogram(reads),
        f"{name}_gc": stats.gc_histogram(reads),
        f"{name}_mean_quality": stats.mean_quality_histogram(reads, o.phred),
        f"{name}_kmers": words,
        f"{name}_kmer_range": stats.kmer_range(words),
    }


def single(reads: DataFrame, options: Options = Options(), adapters: list[str] | None = None) -> Result:
    """Single reads (read_id, name, seq, strand, qual): statistics, duplicates, UMI, trimming, adapters, filter."""
    o = options.checked()
    if o.correct_reads:
        reads = written(correct.corrected_reads(reads, o), "corrected")
    tables = _position_tables("before", reads, o)
    tables["duplicates"] = duplicate.duplicate_rate(duplicate.followed_words(duplicate.key_words_single(reads)))
    adapter = o.adapter1
    if o.trim_adapter and not adapter and o.detect_single:
        adapter = detect.detect_adapter(reads, o.tail1)
    marked = umi.add_umi(reads, o.umi_location, o.umi_length, o.umi_prefix, o.umi_skip) if o.umi else reads
    # Written once: the passed reads, the counts and the statistics after filtering all read it.
    coded = written(trim.trim_single(marked, o, adapter, adapters), "single")
    passed = coded.filter("code = 0").select(*reads.columns)
    tables["filter"] = stats.filter_summary(coded)
    tables["adapters"] = trim.trimmed_adapters(coded, least=o.adapter_length_limit)
    tables |= _position_tables("after", passed, o)
    if o.overrepresented:
        tables["overrepresented_before"] = orp.overrepresented(reads, o.overrepresented_sampling)
        tables["overrepresented_after"] = orp.overrepresented(passed, o.overrepresented_sampling)
    return Result(passed, coded, tables)


def paired(reads: DataFrame, options: Options = Options(), adapters: list[str] | None = None) -> Result:
    """Pairs (read_id, name, s1, q1, s2, q2)."""
    from dataclasses import replace

    o = replace(options, front2=options.front1 or options.front2, tail2=options.tail1 or options.tail2).checked()
    mate = lambda df, m: df.select("read_id", F.col(f"s{m}").alias("seq"), F.col(f"q{m}").alias("qual"))
    tables = {}
    for m in (1, 2):
        tables |= _position_tables(f"before{m}", mate(reads, m), o)
    tables["duplicates"] = duplicate.duplicate_rate(duplicate.followed_words(duplicate.key_words_pairs(reads)))
    own = [o.adapter1, o.adapter2]
    if o.trim_adapter and o.detect_paired:
        own = [a or detect.detect_adapter(mate(reads, m), t) for a, m, t in zip(own, (1, 2), (o.tail1, o.tail2))]
    marked = umi.add_umi_pairs(reads, o.umi_location, o.umi_length, o.umi_prefix, o.umi_skip) if o.umi else reads
    coded = written(pairs.trim_pairs(marked, o, (own[0], own[1]), adapters), "paired")
    passed = coded.filter("code = 0").select("read_id", "name", "s1", "q1", "s2", "q2")
    tables["filter"] = pairs.pair_filter_summary(coded)
    if o.insert_size:
        sizes = pairs.insert_sizes(coded)
        tables |= {"insert_sizes": sizes, "insert_peak": pairs.insert_peak(sizes)}
    for m in (1, 2):
        tables |= _position_tables(f"after{m}", mate(passed, m), o)
        if o.overrepresented:
            tables[f"overrepresented_before{m}"] = orp.overrepresented(mate(reads, m), o.overrepresented_sampling)
            tables[f"overrepresented_after{m}"] = orp.overrepresented(mate(passed, m), o.overrepresented_sampling)
    return Result(passed, coded, tables)


def long(reads: DataFrame, options: Options = Options()) -> Result:
    """Long reads (read_id, seq, qual): statistics only."""
    o = options
    return Result(reads, reads, {"totals": longread.long_totals(reads, o.phred), "ends": longread.long_ends(reads, phred=o.phred), "lengths": longread.long_lengths(reads), "top": longread.long_top(reads)})


def run(spark: SparkSession, options: Options) -> Result:
    """A run from the options' files to the options' files."""
    o = options.checked()
    listed = trim.adapter_list(fastq.read_adapters(spark, o.adapter_file)) if o.adapter_file else None
    if o.long_reads:
        return long(fastq.read_fastq(spark, o.in_file1), o)
    if o.paired:
        source = fastq.read_interleaved(spark, o.in_file1) if o.interleaved_in else fastq.read_pairs(spark, o.in_file1, o.in_file2)
        result = paired(source, o, listed)
        if o.print_overrepresented:
            for name in (n for n in result.tables if n.startswith("overrepresented_")):
                sinks.save_snapshot(result.tables[name], f"{o.out_file1.rstrip('/')}_{name}", o.overwrite)
        gz = o.out_file1.endswith(".gz")
        if o.out_file1 and o.interleaved_out:
            sinks.write_interleaved(result.passed, o.out_file1, o.keep_order, gz, o.overwrite, o.compress_level)
        elif o.out_file1 and o.out_file2:
            sinks.write_pairs(result.passed, o.out_file1, o.out_file2, o.keep_order, gz, o.overwrite, o.compress_level)
        return result
    result = single(fastq.read_fastq(spark, o.in_file1), o, listed)
    if o.print_overrepresented:
        for when in ("before", "after"):
            sinks.save_snapshot(result.tables[f"overrepresented_{when}"], f"{o.out_file1.rstrip('/')}_overrepresented_{when}", o.overwrite)
    if o.out_file1:
        sinks.write_fastq(result.passed, o.out_file1, o.keep_order, o.out_file1.endswith(".gz"), o.overwrite, o.compress_level)
    return result
