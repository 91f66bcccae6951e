"""Records that cannot be parsed, kept apart with the reason while all others load.

Records are assembled quote-aware and parsed in `mapInArrow`: delimited text with Python's strict csv
reader, so that broken quoting and a wrong number of columns surface as structural failures before any
field is interpreted; only then the typed constructors of header, sequence and quality run.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are tested.
REASONS = ("quoting", "columns", "separator", "header", "seq", "qual", "length")

_BASES = re.compile(r"[ACGTNacgtn]+")
_QUAL = re.compile(r"[!-~]*")
_HEADER = re.compile(r"@\S")
_LINE = re.compile(r"\r\n|\n")
csv.field_size_limit(2**31 - 1)


class BadRecord(ValueError):
    """A record that cannot be taken; its only argument is the reason."""


def split_csv(text: str) -> list[str]:
    """The fields of one comma-separated record; a quoted field may span lines.

    Raises BadRecord("quoting") where the text is not a list of fields each of which is quoted with inner
    quotes doubled, or free of quotes, commas and line ends.
    """
    try:
        rows = list(csv.reader(assemble(text), strict=True, doublequote=True))
    except csv.Error:
        raise BadRecord("quoting") from None
    if len(rows) > 1:
        raise BadRecord("quoting")
    fields = rows[0] if rows else []
    fields = fields or [""]
    # The strict reader accepts a quote inside an unquoted field; what the fields say must give the text back.
    at = 0
    for i, value in enumerate(fields):
        if i:
            at += 1  # the comma
        if text.startswith('"', at):
            at += len(value) + value.count('"') + 2
        else:
            if '"' in value or "\n" in value or "\r" in value:
                raise BadRecord("quoting")
            at += len(value)
    if at != len(text):
        raise BadRecord("quoting")
    return fields


def assemble(text: str) -> Iterator[str]:
    """The text's lines with their ends, as the csv reader wants them; it joins the lines of a quoted field."""
    start = 0
    for m in _LINE.finditer(text):
        yield text[start : m.end()]
        start = m.end()
    if start < len(text):
        yield text[start:]


def parse_record(fmt: str | None, payload: str | None) -> tuple[str, str, str]:
    """(name, seq, qual) of one record, or BadRecord with the first reason that applies."""
    text = payload or ""
    if text.endswith("\r\n"):
        text = text[:-2]
    elif text.endswith("\n"):
        text = text[:-1]
    if fmt == "csv":
        fields = split_csv(text)
    elif fmt == "tsv":
        fields = text.split("\t")
    elif fmt == "fastq":
        fields = _LINE.split(text)
    else:
        raise BadRecord("columns")
    if len(fields) != (4 if fmt == "fastq" else 3):
        raise BadRecord("columns")
    if fmt == "fastq":
        if not fields[2].startswith("+"):
            raise BadRecord("separator")
        del fields[2]
    name, seq, qual = fields
    if not _HEADER.match(name):
        raise BadRecord("header")
    if not _BASES.fullmatch(seq):
        raise BadRecord("seq")
    if not _QUAL.fullmatch(qual):
        raise BadRecord("qual")
    if len(seq) != len(qual):
        raise BadRecord("length")
    return name, seq, qual


_PARSED = "`__key` bigint, fmt string, payload string, name string, seq string, qual string, reason string"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"name": [], "seq": [], "qual": [], "reason": []}
        kept: list[str | None] = []
        for fmt, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            try:
                got, why = parse_record(fmt, payload), None
            except BadRecord as e:
                got, why = (None, None, None), e.args[0]
            for k, v in zip(("name", "seq", "qual"), got):
                out[k].append(v)
            out["reason"].append(why)
            kept.append(payload if why else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.string()), pa.array(kept, pa.string()), *(pa.array(v, pa.string()) for v in out.values())],
            ["__key", "fmt", "payload", *out],
        )


def parse_records(raw: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """Every row with name, seq, qual, or with `reason` (null where it loads), without a shuffle.

    Needs the id, `fmt` (fastq, tsv, csv) and `payload`; other columns are ignored. A record delivered
    several times is parsed each time; `good_records` and `bad_records` keep one. A null payload is an empty one; an unknown or null `fmt` fails with
    `columns`. An empty table gives an empty result.
    """
    rows = raw.select(F.col(id_col).cast("bigint").alias("__key"), F.col("fmt").cast("string").alias("fmt"), F.col("payload").cast("string").alias("payload"))
    return rows.mapInArrow(_parse_batches, _PARSED).withColumnRenamed("__key", id_col)


def good_records(parsed: DataFrame) -> DataFrame:
    """The records that load, each once: only what loads is shuffled to find repeats."""
    return parsed.filter(F.col("reason").isNull()).drop("reason", "payload").distinct()


def bad_records(parsed: DataFrame) -> DataFrame:
    """The records that fail, each once, with the reason and what was delivered; the others aren't shuffled."""
    return parsed.filter(F.col("reason").isNotNull()).drop("name", "seq", "qual").distinct()
