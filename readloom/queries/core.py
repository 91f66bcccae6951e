"""Queries of the core by name. Each reads its whole tables; their SQL is in `sql`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.common import table
from readloom.operators import badrows, correct, detect, duplicate, hotkeys, longread, orp, pairs, reads, stats, trim, umi
from readloom.options import Options
from readloom.plans import pipeline
from readloom.queries import correct_sql, files, run_sql, sql

__all__ = ["oracle_sql", "queries"]

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Nothing but what a query switches on.
PLAIN = Options(trim_adapter=False, insert_size=False)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _ALL | files.queries()


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | correct_sql.oracle_sql() | run_sql.oracle_sql() | files.oracle_sql()


def se(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return reads.single_reads(table(spark, d, "reads_se"), *more)


def pe(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return reads.read_pairs(table(spark, d, "reads_pe"), *more)


def lr(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return reads.single_reads(table(spark, d, "long_reads").withColumn("strand", F.lit("+")), *more)


def first_adapter(spark: SparkSession, d: str) -> str:
    return table(spark, d, "adapters").filter("ord = 0").select(F.upper("seq")).first()[0]


# --- unparsable records, hot keys -----------------------------------------------------------------------


@query
def p3_found(spark, d):
    return badrows.bad_records(badrows.parse_records(table(spark, d, "raw_reads"))).select("raw_id", "reason")


@query
def p3_loaded(spark, d):
    return badrows.good_records(badrows.parse_records(table(spark, d, "raw_reads"))).select("raw_id", "name", "seq", "qual")


@query
def p4_found(spark, d):
    return hotkeys.hot_prefixes(table(spark, d, "reads_se")).select("key12")


@query
def p4_groups(spark, d):
    return hotkeys.prefix_groups(table(spark, d, "reads_se")).select("key12", "n_reads", "bases", "min_len", "max_len", "gc_bases")


# --- statistics of short reads --------------------------------------------------------------------------


@query
def totals(spark, d):
    return stats.totals(se(spark, d, "qual"))


@query
def q20_q30(spark, d):
    return stats.totals(se(spark, d, "qual")).select("q20_bases", "q30_bases", F.round(F.try_divide("q20_bases", "bases"), 9).alias("q20_share"), F.round(F.try_divide("q30_bases", "bases"), 9).alias("q30_share"))


@query
def gc_content(spark, d):
    return se(spark, d).agg(F.sum(stats.gc_bases("seq")).alias("gc_bases"), F.round(F.try_divide(F.sum(stats.gc_bases("seq")), F.sum(F.length("seq"))), 9).alias("gc_share"))


@query
def length_hist(spark, d):
    return stats.length_histogram(se(spark, d))


@query
def gc_hist(spark, d):
    return stats.gc_histogram(se(spark, d))


@query
def mean_quality_hist(spark, d):
    return stats.mean_quality_histogram(se(spark, d, "qual"))


@query
def position_bases(spark, d):
    return stats.by_position(se(spark, d, "qual")).select("pos", "base", "n")


@query
def position_quality(spark, d):
    return stats.by_position(se(spark, d, "qual")).select("pos", "base", "quality_sum")


@query
def kmer5(spark, d):
    return stats.kmers(se(spark, d))


@query
def kmer5_minmax(spark, d):
    return stats.kmer_range(stats.kmers(se(spark, d)))


@query
def max_length(spark, d):
    """The longest read among the first 262,144 reads; that head is what sampling by file order means."""
    return se(spark, d).filter(F.col("read_id") < 262_144).agg(F.max(F.length("seq")).alias("max_length"))


@query
def every_20th(spark, d):
    """The sample that the scan for over-represented sequences looks at."""
    return se(spark, d).filter(F.col("read_id") % 20 == 0)


# --- filters --------------------------------------------------------------------------------------------


@query
def filter_codes(spark, d):
    return se(spark, d, "qual").select("read_id", stats.filter_code("seq", "qual").alias("code"))


@query
def filter_summary(spark, d):
    return stats.filter_summary(se(spark, d, "qual").withColumn("code", stats.filter_code("seq", "qual")))


@query
def pair_filter(spark, d):
    coded = pe(spark, d, "q1", "q2").select(F.greatest(stats.filter_code("s1", "q1"), stats.filter_code("s2", "q2")).alias("code"))
    return pairs.pair_filter_summary(coded)


# --- trimming -------------------------------------------------------------------------------------------


def _trimmed(spark, d, **options) -> DataFrame:
    return trim.trim_single(se(spark, d, "qual"), replace(PLAIN, **options)).select("read_id", "seq", "qual", "trimmed_ok")


@query
def trim_fixed(spark, d):
    return _trimmed(spark, d, front1=5, tail1=3)


@query
def cut_5(spark, d):
    return _trimmed(spark, d, cut5=True)


@query
def cut_3(spark, d):
    return _trimmed(spark, d, cut3=True)


@query
def cut_both(spark, d):
    return _trimmed(spark, d, cut5=True, cut3=True, front1=2, tail1=1)


@query
def polyg(spark, d):
    return _trimmed(spark, d, poly_g=True).select("read_id", "seq")


@query
def polyx(spark, d):
    return _trimmed(spark, d, poly_x=True).select("read_id", "seq")


@query
def adapter_seq_trim(spark, d):
    cut = trim.trim_single(se(spark, d, "qual"), replace(PLAIN, trim_adapter=True), first_adapter(spark, d))
    return cut.select("read_id", "seq", F.col("adapter_bases").alias("removed"))


@query
def adapter_list_trim(spark, d):
    listed = trim.adapter_list(table(spark, d, "adapters"))
    return trim.trim_single(se(spark, d, "qual"), replace(PLAIN, trim_adapter=True), adapters=listed).select("read_id", "seq", F.col("adapter_bases").alias("removed"))


@query
def adapter_list(spark, d):
    return table(spark, d, "adapters").select(F.upper(F.trim("seq")).alias("seq")).distinct().orderBy("seq")


@query
def adapter_counts(spark, d):
    cut = trim.trim_single(se(spark, d, "qual"), replace(PLAIN, trim_adapter=True), first_adapter(spark, d))
    return trim.trimmed_adapters(cut)


# --- mates ----------------------------------------------------------------------------------------------


@query
def mate_join(spark, d):
    p = pe(spark, d, "name", "q1", "q2")
    side = lambda m: p.select("read_id", "name", F.col(f"s{m}").alias("seq"), F.col(f"q{m}").alias("qual"))
    return reads.join_mates(side(1), side(2))


@query
def interleave(spark, d):
    return reads.interleave(pe(spark, d, "name", "q1", "q2"))


@query
def deinterleave(spark, d):
    """The single reads taken as one interleaved file."""
    return reads.deinterleave(se(spark, d, "name", "qual"))


@query
def fastq_lines(spark, d):
    return reads.fastq_lines(se(spark, d, "name", "strand", "qual"))


@query
def missing_quality(spark, d):
    return table(spark, d, "reads_se").filter("qual IS NULL").select("read_id", reads.quality("qual", "seq").alias("qual")).distinct()


@query
def revcomp(spark, d):
    return pe(spark, d).select("read_id", F.translate(F.reverse("s2"), "ACGTacgt", "TGCATGCA").alias("rc2"))


def _analysed(spark, d, **options) -> DataFrame:
    return pairs.trim_pairs(pe(spark, d, "q1", "q2"), replace(PLAIN, **options))


@query
def overlap_full(spark, d):
    return _analysed(spark, d, insert_size=True).select("read_id", "overlapped", "offset", "overlap", "differences")


@query
def insert_size_hist(spark, d):
    return pairs.insert_sizes(_analysed(spark, d, insert_size=True))


@query
def insert_peak(spark, d):
    return pairs.insert_peak(pairs.insert_sizes(_analysed(spark, d, insert_size=True)))


@query
def adapter_overlap_trim(spark, d):
    return _analysed(spark, d, trim_adapter=True).select("read_id", "s1", "s2", F.col("adapter_bases1").alias("removed"))


@query
def overlap_correct(spark, d):
    return _analysed(spark, d, correct_overlap=True).select("read_id", "s1", "q1", "s2", "q2", "corrected")


# --- UMI ------------------------------------------------------------------------------------------------


def _umi(location: str, length: int = 0, prefix: str = "", skip: int = 0):
    def run(spark, d):
        return umi.add_umi(se(spark, d, "name", "qual"), location, length, prefix, skip)

    return run


def _umi_pairs(location: str, length: int = 0, prefix: str = "", skip: int = 0):
    def run(spark, d):
        return umi.add_umi_pairs(pe(spark, d, "name", "q1", "q2"), location, length, prefix, skip)

    return run


_ALL |= {
    "umi_index1": _umi("index1"),
    "umi_read1": _umi("read1", 8, "UMI", 2),
    "umi_per_index": _umi("per_index"),
    "umi_per_read": _umi("per_read", 8),
    "umi_pair_index1": _umi_pairs("index1", prefix="X"),
    "umi_pair_index2": _umi_pairs("index2"),
    "umi_pair_read2": _umi_pairs("read2", 6, "", 1),
    "umi_pair_per_index": _umi_pairs("per_index"),
    "umi_pair_per_read": _umi_pairs("per_read", 6),
}


# --- duplicates -----------------------------------------------------------------------------------------


@query
def dup_se(spark, d):
    return duplicate.followed_words(duplicate.key_words_single(se(spark, d)))


@query
def dup_pe(spark, d):
    return duplicate.followed_words(duplicate.key_words_pairs(pe(spark, d)))


@query
def dup_rate(spark, d):
    return duplicate.duplicate_rate(duplicate.followed_words(duplicate.key_words_single(se(spark, d))))


@query
def dup_hist(spark, d):
    return duplicate.duplicate_histogram(duplicate.followed_words(duplicate.key_words_single(se(spark, d))))


# --- over-represented sequences, adapter detection ------------------------------------------------------


@query
def hot_sequences(spark, d):
    return orp.hot_sequences(orp.head_reads(se(spark, d)))


@query
def overrepresented(spark, d):
    """With how many hits start at each position, as text."""
    starts = F.concat_ws(",", F.transform(F.map_entries("starts"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))))
    return orp.overrepresented(se(spark, d)).select("word", "n", starts.alias("starts"))


@query
def adapter_seeds(spark, d):
    head = reads.bounded_head(se(spark, d), F.length("seq"), detect.HEAD_READS, detect.HEAD_BASES)
    return detect.top_seeds(detect.seed_counts(head))


@query
def adapter_detect(spark, d):
    return spark.createDataFrame([(detect.detect_adapter(se(spark, d)),)], "adapter string")


# --- long reads -----------------------------------------------------------------------------------------


@query
def tgs_totals(spark, d):
    return longread.long_totals(lr(spark, d, "qual"))


@query
def tgs_head_tail(spark, d):
    return longread.long_ends(lr(spark, d, "qual"))


@query
def tgs_length_hist(spark, d):
    return longread.long_lengths(lr(spark, d))


@query
def tgs_top5(spark, d):
    return longread.long_top(lr(spark, d, "qual"))


# --- FASTA ----------------------------------------------------------------------------------------------


@query
def fasta_min_length(spark, d):
    t = table(spark, d, "fasta_records").select("gid", F.regexp_replace(F.coalesce("seq", F.lit("")), r"\s", "").alias("seq")).distinct()
    return t.filter(F.length("seq") >= 200).select("gid", F.length("seq").alias("length"))


# --- error correction -----------------------------------------------------------------------------------


@query
def plain_bases(spark, d):
    return correct.prepared(se(spark, d, "qual")).select("read_id", "seq", "ambiguous")


@query
def quality_bins(spark, d):
    return se(spark, d, "qual").select("read_id", correct.quality_bin("qual", 2).alias("two_bits"), correct.quality_bin("qual", 1).alias("one_bit"))


def _signatures(spark, d) -> DataFrame:
    ready = correct.prepared(se(spark, d, "qual"))
    k = correct.word_length(ready.agg(F.max(F.length("seq"))).first()[0] or 0)
    return correct.signatures(ready, k)


@query
def cand_bucket_sizes(spark, d):
    return correct.bucket_sizes(_signatures(spark, d)).groupBy("n").agg(F.count(F.lit(1)).alias("buckets"))


@query
def cand_pairs(spark, d):
    return correct.candidate_pairs(_signatures(spark, d))


@query
def cand_paired(spark, d):
    return correct.paired_flags(correct.candidate_pairs(_signatures(spark, d))).filter("paired")


@query
def align(spark, d):
    return correct.alignments(se(spark, d, "qual"))


@query
def align_mates(spark, d):
    """Reads 2i and 2i + 1 taken as mates: candidates whose mates are candidates of each other stay."""
    return correct.alignments(se(spark, d, "qual"), Options(pair_mode="PE"))


def millionths(values: str) -> Column:
    """An array of numbers as text, in whole millionths."""
    return F.concat_ws(",", F.transform(values, lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")))


@query
def consensus(spark, d):
    return correct.consensus_columns(se(spark, d, "qual"), as_text=True)


@query
def correction_features(spark, d):
    """Positions that differ from the consensus at a tenfold coverage, where anchors that are not of high quality occur."""
    found = correct.correction_features(se(spark, d, "qual"), Options(correction_type=2, coverage=10))
    return found.withColumn("features", millionths("features"))


@query
def corrections(spark, d):
    return correct.corrections(se(spark, d, "qual"), Options(correct_candidates=True))


@query
def corrections_sparse(spark, d):
    """At a tenfold coverage: also anchors that are not of high quality are corrected, where they can be."""
    return correct.corrections(se(spark, d, "qual"), Options(correct_candidates=True, coverage=10))


@query
def region_splits(spark, d):
    """With the candidates of each group as text."""
    found = correct.region_splits(se(spark, d, "qual"), Options(coverage=10))
    return found.withColumn("candidates", F.concat_ws(",", F.col("candidates").cast("array<string>")))


@query
def corrected_reads(spark, d):
    return correct.corrected_reads(se(spark, d, "name", "qual"), Options(correct_candidates=True, quality_labels=True))


# --- whole runs -----------------------------------------------------------------------------------------


@query
def pipeline_se(spark, d):
    o = Options(cut5=True, cut3=True, poly_g=True, poly_x=True)
    return pipeline.single(se(spark, d, "name", "strand", "qual"), o, trim.adapter_list(table(spark, d, "adapters"))).passed


@query
def pipeline_se_report(spark, d):
    o = Options(cut5=True, cut3=True, poly_g=True, poly_x=True)
    t = pipeline.single(se(spark, d, "name", "strand", "qual"), o).tables
    return t["before_totals"].withColumn("when", F.lit("before")).unionByName(t["after_totals"].withColumn("when", F.lit("after")))


@query
def pipeline_pe(spark, d):
    o = Options(in_file2="pairs", in_file1="pairs", correct_overlap=True, poly_g=True)
    return pipeline.paired(pe(spark, d, "name", "q1", "q2"), o).passed


@query
def pipeline_tgs(spark, d):
    return pipeline.long(lr(spark, d, "qual")).tables["totals"]
