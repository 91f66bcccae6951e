"""Reads and reports to files; Spark's commit protocol replaces temporary names and renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The codec's names of the levels 1 to 9.
_LEVELS = ("BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def _save(records: DataFrame, path: str, order: list[str] | None, gzip: bool, overwrite: bool, level: int) -> None:
    rows = records.orderBy(*order) if order else records
    writer = rows.select("record").write.mode("overwrite" if overwrite else "errorifexists")
    if gzip:
        writer = writer.option("compression", "gzip").option("zlib.compress.level", _LEVELS[level - 1])
    writer.text(path)


def record(name: str = "name", seq: str = "seq", strand: str | None = None, qual: str = "qual"):
    return F.concat_ws("\n", F.col(name), F.col(seq), F.col(strand) if strand else F.lit("+"), F.col(qual))


def write_fastq(reads: DataFrame, path: str, keep_order: bool = True, gzip: bool = False, overwrite: bool = False, level: int = 4) -> None:
    """Four lines a read; in order the part files follow each other by read_id."""
    strand = "strand" if "strand" in reads.columns else None
    _save(reads.select("read_id", record(strand=strand).alias("record")), path, ["read_id"] if keep_order else None, gzip, overwrite, level)


def write_pairs(pairs: DataFrame, path1: str, path2: str, keep_order: bool = True, gzip: bool = False, overwrite: bool = False, level: int = 4) -> None:
    for m, path in ((1, path1), (2, path2)):
        _save(pairs.select("read_id", record(seq=f"s{m}", qual=f"q{m}").alias("record")), path, ["read_id"] if keep_order else None, gzip, overwrite, level)


def write_interleaved(pairs: DataFrame, path: str, keep_order: bool = True, gzip: bool = False, overwrite: bool = False, level: int = 4) -> None:
    """Both mates of a pair after one another in one file."""
    both = F.concat_ws("\n", record(seq="s1", qual="q1"), record(seq="s2", qual="q2"))
    _save(pairs.select("read_id", both.alias("record")), path, ["read_id"] if keep_order else None, gzip, overwrite, level)


def save_snapshot(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Prepared reads, signatures or candidates, to go on from later."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def name_prefix(path: str) -> str:
    """The file's name without folders and endings, for the names of outputs."""
    name = path.rstrip("/").rpartition("/")[2]
    for ending in (".gz", ".fastq", ".fq", ".fasta", ".fa"):
        name = name.removesuffix(ending)
    return name


def summary_text(totals: DataFrame, codes: DataFrame | None = None, duplicates: DataFrame | None = None, insert_peak: DataFrame | None = None, adapters: DataFrame | None = None, most_adapters: int = 1000) -> str:
    """The totals (one row), the filter's counts, the rate of duplicates, the peak of insert sizes and the adapters that were
    trimmed as lines of text. Of more than `most_adapters` adapters the most frequent are listed, and the number of the rest."""
    lines = [f"{k.replace('_', ' ')} {v}" for k, v in totals.first().asDict().items()]
    names = {0: "passed", 1: "too many N", 2: "too short", 3: "too long", 4: "low quality"}
    if codes is not None:
        found = {r["code"]: r["reads"] for r in codes.collect()}
        lines += [f"{text} {found.get(code, 0)}" for code, text in names.items()]
    if duplicates is not None:
        lines.append(f"duplication rate {duplicates.first()['rate']}")
    if insert_peak is not None:
        peak = insert_peak.first()
        lines.append(f"insert size peak {peak['peak'] if peak else 'none'}")
    if adapters is not None:
        lines += [f"adapter {r['adapter']} {r['n']}" for r in adapters.orderBy(F.desc("n"), "adapter").limit(most_adapters).collect()]
        more = adapters.count() - most_adapters
        lines += [f"and {more} more adapters"] if more > 0 else []
    return "\n".join(lines)


def summary_html(tables: dict[str, DataFrame], most_rows: int = 1000) -> str:
    """A plain page of the report's tables. Of a table of more than `most_rows` rows the first are shown, and how many there are."""
    import html

    parts = []
    for title, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(most_rows).collect())
        shown = df.limit(most_rows + 1).count()
        more = f"<p>The first {most_rows} of {df.count()} rows</p>" if shown > most_rows else ""
        parts.append(f"<h2>{html.escape(title)}</h2>{more}<table><tr>{head}</tr>{rows}</table>")
    return "<!doctype html><meta charset='utf-8'><title>Read quality</title>" + "".join(parts)
