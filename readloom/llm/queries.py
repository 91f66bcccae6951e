"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.common import table, written
from readloom.llm import frequent, mixing, neardup, packing, residue, split, words


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chunks(table(spark, d, "fasta_chunks"), table(spark, d, "fasta_records"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The first two pieces of a chunk tell; their bases needn't move for that."""
    return split.oversized_chunks(split.split_chunks(table(spark, d, "fasta_chunks"), table(spark, d, "fasta_records"), texts=False))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_sequences(table(spark, d, "reads_se")).select("seq")


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Whether the guaranteed interval holds the exact count, beside that count."""
    found = frequent.frequent_sequences(table(spark, d, "reads_se"))
    return found.select("seq", "n", F.col("n").between(F.col("n_low"), F.col("n_high")).alias("inside"), "certain")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return words.marked_words(table(spark, d, "reads_se")).filter(F.col("mark").isNotNull()).select("kmer", "mark")


def p5_words(spark: SparkSession, d: str) -> DataFrame:
    return words.marked_words(table(spark, d, "reads_se")).select("kmer", "occurrences", "reads", "mark")


def p5_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Words of 1 to 12 letters from one suffix array per batch, summed up by length."""
    counted = words.marked_words(table(spark, d, "reads_se"), range(1, 13))
    one = F.when(F.col("reads") == 1, 1)
    return counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"), F.sum("occurrences").alias("occurrences"), F.sum("reads").alias("reads"), F.max("reads").alias("most_reads"), F.count(one).alias("in_one_read"), F.count(F.when(F.col("mark") == "common", 1)).alias("common"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_reads(table(spark, d, "long_reads")).pairs().select(F.col("id_a").alias("read_id_a"), F.col("id_b").alias("read_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_reads(table(spark, d, "long_reads")).groups()


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per scheme the conditions of a packing: every document placed as a whole or in consecutive parts, none split that
    fits, no container over its capacity, and but for one container at least 97 % filled."""
    placed = written(p7_packed(spark, d), "placed")
    capacity = placed.groupBy("scheme").agg(F.max("capacity").alias("largest"))
    parts = placed.groupBy("scheme", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"), F.countDistinct("part").alias("different"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    whole = (F.col("parts") == F.col("last") + 1) & (F.col("parts") == F.col("different")) & (F.col("end") == F.col("tokens"))
    unsplit = (F.col("parts") == 1) | (F.col("tokens") > F.col("largest"))
    of_docs = parts.join(F.broadcast(capacity), "scheme").groupBy("scheme").agg(F.count(F.lit(1)).alias("documents"), F.every(whole).alias("whole"), F.every(unsplit).alias("split_only_if_larger"))
    of_bins = placed.groupBy("scheme", "container").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c")).groupBy("scheme").agg(F.every(F.col("t") <= F.col("c")).alias("within_capacity"), (F.sum("t") + F.max("c") >= 0.97 * F.sum("c")).alias("well_filled"))
    return of_docs.join(of_bins, "scheme")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "source_weights")).selection()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether the share reached is within two points of its target, and the repeat limit kept."""
    r = mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "source_weights")).report()
    return r.select("source", "target_share", (F.abs(F.col("share") - F.col("target_share")) < 0.02).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("limit_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.judged(table(spark, d, "documents")).filter(residue.is_residue()).select("doc_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean_documents(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_intervals, p5_found, p5_words, p5_lengths, p6_found, p6_groups, p7_packed, p7_fill, p8_selection, p8_shares, p9_found, p9_clean)}


_CLEAN = "upper(trim(seq, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
_ONCE = f"once AS (SELECT DISTINCT read_id, {_CLEAN} AS seq FROM reads_se)"
_LENGTHS = f"""WITH {_ONCE},
 total AS (SELECT count(*) AS all_reads FROM (SELECT DISTINCT read_id FROM reads_se)),
 places AS (SELECT read_id, n, substr(seq, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS kmer FROM (SELECT read_id, seq, n, unnest(range(1, length(seq) - n + 2)) AS i FROM once, (SELECT unnest(range(1, 13)) AS n))),
 words AS (SELECT n, kmer, count(*) AS occurrences, count(DISTINCT read_id) AS reads FROM places WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY n, kmer)
SELECT CAST(n AS INTEGER) AS n, count(*) AS words, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(reads) AS BIGINT) AS reads, max(reads) AS most_reads, count(*) FILTER (reads = 1) AS in_one_read, count(*) FILTER (reads * 10 > all_reads) AS common FROM words, total GROUP BY n"""
_WORDS = f"""{_ONCE},
 total AS (SELECT count(*) AS n FROM (SELECT DISTINCT read_id FROM reads_se)),
 places AS (SELECT read_id, substr(seq, CAST(i AS BIGINT), 6) AS kmer FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM once)),
 words AS (SELECT kmer, count(*) AS occurrences, count(DISTINCT read_id) AS reads FROM places WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY kmer),
 marked AS (SELECT kmer, occurrences, reads, CASE WHEN reads * 500 < n THEN 'rare' WHEN reads * 10 > n THEN 'common' END AS mark FROM words, total)"""


_SIMILAR = f"""once AS (SELECT DISTINCT read_id, {_CLEAN} AS seq FROM long_reads WHERE seq IS NOT NULL),
 w AS (SELECT DISTINCT read_id, substr(seq, CAST(i AS BIGINT), 12) AS k FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 10)) AS i FROM once) WHERE NOT regexp_matches(substr(seq, CAST(i AS BIGINT), 12), '[^ACGT]')),
 n AS (SELECT read_id, count(*) AS n FROM w GROUP BY read_id),
 p AS (SELECT a.read_id AS x, b.read_id AS y, count(*) AS c FROM w AS a JOIN w AS b ON a.k = b.k AND a.read_id < b.read_id GROUP BY ALL),
 similar_reads AS (SELECT x, y FROM p JOIN n AS nx ON nx.read_id = x JOIN n AS ny ON ny.read_id = y WHERE c * 10 >= 6 * (nx.n + ny.n - c))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """WITH recs AS (SELECT DISTINCT gid, file_no, length(regexp_replace(coalesce(seq, ''), '[^A-Za-z]', '', 'g')) AS n FROM fasta_records),
 chunks AS (SELECT DISTINCT chunk_id, file_no, coalesce(chunk_start, chunk_end - nseqs + 1) AS s, coalesce(chunk_end, chunk_start + nseqs - 1) AS e, max_bases FROM fasta_chunks),
 running AS (SELECT chunk_id, gid, max_bases, sum(n) OVER (PARTITION BY chunk_id ORDER BY gid) AS upto FROM chunks JOIN recs ON recs.file_no = chunks.file_no AND gid BETWEEN s AND e)
SELECT chunk_id, min(gid) AS gid FROM running WHERE upto > max_bases GROUP BY chunk_id""",
        # The cuts one after another; chunks of these tables are one segment each.
        "p1_pieces": """WITH RECURSIVE recs AS (SELECT DISTINCT gid, file_no, regexp_replace(coalesce(seq, ''), '[^A-Za-z]', '', 'g') AS b FROM fasta_records),
 chunks AS (SELECT DISTINCT chunk_id, file_no, coalesce(chunk_start, chunk_end - nseqs + 1) AS s, coalesce(chunk_end, chunk_start + nseqs - 1) AS e, CAST(max_bases AS BIGINT) AS m, least(greatest(0, coalesce(CAST(halo AS BIGINT), 0)), max_bases - 1) AS h FROM fasta_chunks),
 laid AS (SELECT chunk_id, m, h, gid, b, CAST(sum(length(b)) OVER (PARTITION BY chunk_id ORDER BY gid) AS BIGINT) AS upto FROM chunks JOIN recs ON recs.file_no = chunks.file_no AND gid BETWEEN s AND e WHERE b <> ''),
 whole AS (SELECT chunk_id, m, h, string_agg(b, '' ORDER BY gid) AS text, list(upto ORDER BY gid) AS ends, list(gid ORDER BY gid) AS gids FROM laid GROUP BY chunk_id, m, h),
 cut AS (SELECT chunk_id, 0 AS piece, CAST(0 AS BIGINT) AS fresh, coalesce(list_max(list_filter(ends, lambda x: x <= m)), least(m, length(text))) AS stop FROM whole
   UNION ALL SELECT c.chunk_id, piece + 1, stop, coalesce(list_max(list_filter(ends, lambda x: x > stop AND x <= stop + m - h)), least(stop + m - h, length(text))) FROM cut AS c JOIN whole AS w ON w.chunk_id = c.chunk_id WHERE stop < length(text))
SELECT c.chunk_id, CAST(0 AS BIGINT) AS segment, piece, greatest(0, fresh - h) AS start, fresh, CAST(stop - greatest(0, fresh - h) AS INTEGER) AS n_bases, gids[len(list_filter(ends, lambda x: x <= fresh)) + 1] AS first_gid, gids[len(list_filter(ends, lambda x: x <= stop - 1)) + 1] AS last_gid,
 substr(text, greatest(0, fresh - h) + 1, stop - greatest(0, fresh - h)) AS bases FROM cut AS c JOIN whole AS w ON w.chunk_id = c.chunk_id""",
        "p2_found": f"WITH {_ONCE} SELECT seq FROM once WHERE seq <> '' GROUP BY seq ORDER BY count(*) DESC LIMIT 20",
        "p2_intervals": f"WITH {_ONCE}, c AS (SELECT seq, count(*) AS n FROM once WHERE seq <> '' GROUP BY seq) SELECT seq, n, true AS inside, true AS certain FROM c WHERE n >= (SELECT min(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 20))",
        "p6_found": f"WITH {_SIMILAR} SELECT x AS read_id_a, y AS read_id_b FROM similar_reads",
        # Classes of equal sequences, links between their least reads, and what can be reached along links.
        "p6_groups": f"""WITH RECURSIVE {_SIMILAR},
 class AS (SELECT read_id AS id, min(read_id) OVER (PARTITION BY seq) AS class_id, count(*) OVER (PARTITION BY seq) AS copies FROM once),
 link AS (SELECT x AS a, y AS b FROM similar_reads WHERE x IN (SELECT class_id FROM class) AND y IN (SELECT class_id FROM class)),
 both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reached AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reached AS r JOIN both_ways AS w ON w.a = r.b),
 root AS (SELECT a, min(b) AS root FROM reached GROUP BY a), degree AS (SELECT a, count(*) AS links FROM both_ways GROUP BY a)
SELECT id, class_id, copies, coalesce(links, 0) AS links, coalesce(root, class_id) AS group_id FROM class LEFT JOIN root ON root.a = class_id LEFT JOIN degree ON degree.a = class_id""",
        "p7_fill": """WITH schemes AS (SELECT DISTINCT budget_name AS scheme FROM token_budgets UNION SELECT 'joint')
SELECT scheme, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, true AS whole, true AS split_only_if_larger, true AS within_capacity, true AS well_filled FROM schemes""",
        "p8_shares": "SELECT lower(trim(source)) AS source, target_share, true AS reached, true AS limit_kept FROM source_weights",
        "p5_found": f"WITH {_WORDS} SELECT kmer, mark FROM marked WHERE mark IS NOT NULL",
        "p5_lengths": _LENGTHS,
        "p5_words": f"WITH {_WORDS} SELECT kmer, occurrences, reads, mark FROM marked",
    }
