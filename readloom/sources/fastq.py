"""FASTQ and FASTA files as a Spark data source, cut into byte ranges that are read independently.

A range owns the records that begin in it and reads past its end to finish the last one. Files in blocks of gzip (BGZF) are
cut at their blocks, other gzip files can't be cut and are one range each. Paths may be local or any that pyarrow's file
systems know. Columns: file_no, split_no, offset (in the file's text, or the range's for BGZF), idx (in the range), name, seq,
strand, qual, reason (FASTA: comment instead of the last three). Lines that make no record have a reason and their text as name.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.common import broadcast_if_small, ship, written
from readloom.functions.ragged import sliced

FASTQ_SCHEMA = "file_no int, split_no int, offset bigint, idx bigint, name string, seq string, strand string, qual string, reason string"
FASTA_SCHEMA = "file_no int, split_no int, offset bigint, idx bigint, name string, comment string, seq string"
_BATCH = 8192
#: Bytes that are parsed at a time.
_BLOCK = 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    file_no: int
    split_no: int
    begin: int
    end: int
    bgzf: bool = False


def _file(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _paths(path: str) -> list[str]:
    """The files of a comma-separated list of files and folders, in order."""
    from pyarrow import fs

    out = []
    for p in filter(None, (x.strip() for x in path.split(","))):
        system, inner = _file(p)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            prefix = p[: len(p) - len(inner)] if "://" in p else ""
            out += sorted(prefix + i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        else:
            out.append(p)
    return out


class _Lines:
    """Lines of a file from a place on, with the offset at which each begins; CR and LF at their ends removed."""

    def __init__(self, stream, at: int) -> None:
        self.stream, self.at = stream, at
        self.kept: list[tuple[int, bytes]] = []

    def next(self) -> tuple[int, bytes] | None:
        if self.kept:
            return self.kept.pop(0)
        raw = self.stream.readline()
        if not raw:
            return None
        begin = self.at
        self.at += len(raw)
        return begin, raw.rstrip(b"\r\n")

    def back(self, lines: list[tuple[int, bytes]]) -> None:
        self.kept = lines + self.kept


def _open(r: Range) -> _Lines:
    system, inner = _file(r.path)
    if inner.endswith(".gz"):
        return _Lines(io.BufferedReader(system.open_input_stream(inner, compression="gzip"), 1 << 20), 0)
    f = system.open_input_file(inner)
    if r.begin == 0:
        return _Lines(io.BufferedReader(f, 1 << 20), 0)
    # From the byte before: if that ends a line, the range begins with a line of its own.
    f.seek(r.begin - 1)
    stream = io.BufferedReader(f, 1 << 20)
    skipped = stream.readline()
    return _Lines(stream, r.begin - 1 + len(skipped))


#: How a block of a BGZF file begins: gzip with an extra field that tells the block's size (fixed value of the format).
_BGZF_HEAD, _BGZF_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


def _bgzf_size(head: bytes) -> int:
    """Size of the block that begins with these 18 bytes, or 0."""
    if len(head) < 18 or head[:4] != _BGZF_HEAD or head[12:16] != _BGZF_FIELD:
        return 0
    return int.from_bytes(head[16:18], "little") + 1


def is_bgzf(path: str) -> bool:
    system, inner = _file(path)
    with system.open_input_file(inner) as f:
        return _bgzf_size(f.read(18)) > 0


class _Blocks:
    """Text of the BGZF blocks that begin in a range and of those after it. `limit` is the place in this text at which the first
    block past the range begins, once it is known."""

    def __init__(self, r: Range) -> None:
        system, inner = _file(r.path)
        self.file, self.end = system.open_input_file(inner), r.end
        self.at, self.made, self.limit = r.begin, 0, 1 << 62
        if r.begin:
            # A block is at most 64 KiB; its begin is confirmed by the block that follows it.
            self.file.seek(r.begin)
            window = self.file.read(1 << 17)
            found = -1
            while True:
                found = window.find(_BGZF_HEAD, found + 1)
                if found < 0:
                    self.at = 1 << 62
                    break
                size = _bgzf_size(window[found : found + 18])
                if size and (found + size == len(window) or _bgzf_size(window[found + size : found + size + 18])):
                    self.at = r.begin + found
                    break

    def read(self, size: int) -> bytes:
        parts, n = [], 0
        while n < size:
            if self.at >= self.end and self.limit == 1 << 62:
                self.limit = self.made
            if self.at == 1 << 62:
                break
            self.file.seek(self.at)
            head = self.file.read(18)
            if not (length := _bgzf_size(head)):
                break
            text = zlib.decompress(head + self.file.read(length - 18), 31)
            self.at += length
            self.made += len(text)
            n += len(text)
            parts.append(text)
        return b"".join(parts)


class _Plain:
    """Bytes of a file from the one before the range on, or of a whole gzip file."""

    limit = 1 << 62

    def __init__(self, r: Range) -> None:
        system, inner = _file(r.path)
        if inner.endswith(".gz"):
            self.file = system.open_input_stream(inner, compression="gzip")
        else:
            self.file = system.open_input_file(inner)
            self.file.seek(max(0, r.begin - 1))

    def read(self, size: int) -> bytes:
        return self.file.read(size)


def _begins(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, letter: bytes) -> np.ndarray:
    """Which lines begin with the letter."""
    out = ends > starts
    out[out] = text[starts[out]] == letter[0]
    return out


def _next_record(at_sign: np.ndarray, plus: np.ndarray, line: int) -> int:
    """The first line from this one on that begins a record: @ whose next line doesn't begin with @ and next but one begins
    with +. (A quality line may begin with @, but then the next line is a name.) -1 if none is known yet."""
    found = np.flatnonzero(at_sign[line:-2] & ~at_sign[line + 1 : -1] & plus[line + 2 :])
    return line + int(found[0]) if len(found) else -1


def fastq_batches(r: Range) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(places, [name, seq, strand, qual, reason]) of the records that begin in the range, many at a time.

    Lines are found by their ends in a whole block of bytes, four make a record. Where a line that should begin a record
    does not, or the third does not begin with +, the lines up to the next record are one row with a reason: header,
    separator, or truncated at the file's end. Empty lines between records are skipped.
    """
    stream = _Blocks(r) if r.bgzf else _Plain(r)
    kept, base = b"", 0 if r.bgzf or not r.begin else r.begin - 1
    synced = r.begin == 0
    first_line = not synced  # what stands before the first line end belongs to the range before
    while True:
        data = stream.read(_BLOCK)
        raw = kept + data
        text = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(text == 10)
        if not data and len(raw) and raw[-1:] != b"\n":
            ends = np.append(ends, len(raw))
        starts = np.concatenate([[0], ends + 1])[: len(ends)]
        stops = ends.copy()
        while True:
            cr = stops > starts
            cr[cr] = text[stops[cr] - 1] == 13
            if not cr.any():
                break
            stops[cr] -= 1
        at_sign, plus = _begins(text, starts, stops, b"@"), _begins(text, starts, stops, b"+")
        line = 0
        if first_line and len(ends):
            line, first_line = 1, False
        # A BGZF range owns the record that begins with the first block after it, other ranges end before that place.
        last = stream.limit if r.bgzf else r.end - 1
        done = False
        while not done and line < len(ends):
            if not synced:
                found = _next_record(at_sign, plus, line)
                if found < 0:
                    line = len(ends) if not data else line
                    break
                line, synced = found, True
            n = (len(ends) - line) // 4
            good = at_sign[line : line + 4 * n : 4] & plus[line + 2 : line + 4 * n : 4]
            n = n if good.all() else int(np.flatnonzero(~good)[0])
            if n:
                heads = starts[line : line + 4 * n : 4] + base
                own = int(np.searchsorted(heads, last, side="right"))
                done = own < n
                if own:
                    rows = line + 4 * np.arange(own)
                    yield heads[:own], [*(sliced(text, np.zeros(own + 1, np.int64), starts[rows + j], stops[rows + j] - starts[rows + j]) for j in range(4)), pa.nulls(own, pa.string())]
                line += 4 * n
                continue
            if line + 4 > len(ends) and data:
                break  # the record may go on in the next block
            if stops[line] == starts[line]:
                line += 1
                continue
            # The next range begins at the first record it is sure of, so what is broken before that belongs to this one.
            done = starts[line] + base > last
            found = _next_record(at_sign, plus, line + 1)
            if found < 0 and data:
                done = False
                break
            reason = "header" if not at_sign[line] else "truncated" if line + 4 > len(ends) else "separator"
            stop = found if found >= 0 else len(ends)
            lines = raw[starts[line] : stops[stop - 1]].decode("utf-8", "replace")
            yield np.array([starts[line] + base]), [pa.array([lines]), *(pa.nulls(1, pa.string()) for _ in range(3)), pa.array([reason])]
            line = stop
        if done or not data:
            return
        used = int(starts[line]) if line < len(ends) else int(ends[-1]) + 1 if len(ends) else 0
        kept, base = raw[used:], base + used


def fasta_records(r: Range) -> Iterator[tuple[int, str, str | None, str]]:
    """Records that begin in the range: name up to the first space, comment after it, the lines of the sequence joined."""
    lines = _open(r)
    begin, head, parts = -1, "", []

    def record():
        name, _, comment = head.partition(" ")
        return begin, name, comment or None, "".join(parts)

    while (x := lines.next()) is not None:
        at, raw = x
        if raw[:1] == b">":
            if begin >= 0:
                yield record()
            begin, head, parts = at, raw[1:].decode("utf-8", "replace"), []
            if at >= r.end:
                return
        elif begin >= 0:
            parts.append(raw.decode("utf-8", "replace").strip())
    if begin >= 0:
        yield record()


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fasta: bool) -> None:
        self.path = options["path"]
        self.size = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))
        self.fasta = fasta

    def partitions(self) -> list[Range]:
        out = []
        for no, p in enumerate(_paths(self.path)):
            system, inner = _file(p)
            size = system.get_file_info(inner).size
            blocks = not self.fasta and inner.endswith(".gz") and is_bgzf(p)
            whole = inner.endswith(".gz") and not blocks
            step = max(1, size) if whole else max(1, self.size)
            for k, begin in enumerate(range(0, max(1, size), step)):
                out.append(Range(p, no, k, begin, 1 << 62 if whole else begin + step, blocks))
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if not self.fasta:
            at = 0
            for places, columns in fastq_batches(partition):
                n = len(places)
                good = columns[-1].is_null().to_numpy(zero_copy_only=False)
                idx = at + np.cumsum(good) - 1  # only records count
                at += int(good.sum())
                own = [pa.array(np.full(n, partition.file_no, np.int32)), pa.array(np.full(n, partition.split_no, np.int32)), pa.array(places.astype(np.int64)), pa.array(idx.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, *columns], ["file_no", "split_no", "offset", "idx", "name", "seq", "strand", "qual", "reason"])
            return
        names = ["offset", "name", "comment", "seq"]
        kinds = [pa.int64(), *[pa.string()] * (len(names) - 1)]
        source = fasta_records(partition)
        idx, rows = 0, []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.file_no] * n, pa.int32()), pa.array([partition.split_no] * n, pa.int32()), columns[0], pa.array(range(idx - n, idx), pa.int64()), *columns[1:]],
                ["file_no", "split_no", "offset", "idx", *names[1:]],
            )

        for row in source:
            rows.append(row)
            idx += 1
            if len(rows) == _BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "readloom_fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "readloom_fasta"

    def schema(self) -> str:
        return FASTA_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastaSource)


def numbered(df: DataFrame, column: str = "read_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Add the ordinal in file order, over all files. The rows are written once, so files are decoded once; the records of each
    byte range are counted there, and their running total (one row per range) is joined back."""
    from pyspark.sql import Window as W

    rows = written(df, "records")
    counts = rows.groupBy("file_no", "split_no").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(W.orderBy("file_no", "split_no")) - F.col("n")
    counts = counts.select("file_no", "split_no", first.alias("first"))
    return rows.join(broadcast_if_small(counts, counts.count(), broadcast_rows), ["file_no", "split_no"]).withColumn(column, F.col("first") + F.col("idx"))


def _fastq(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    register(spark)
    return spark.read.format("readloom_fastq").option("splitBytes", split_bytes).load(path)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """read_id, name, seq, strand, qual of one or more files in order; lines that make no record are in `broken_records`."""
    return numbered(_fastq(spark, path, split_bytes).filter("reason IS NULL")).select("read_id", "name", "seq", "strand", "qual")


def broken_records(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """file_no, offset, reason, text of the lines that make no record: header, separator or truncated."""
    return _fastq(spark, path, split_bytes).filter("reason IS NOT NULL").select("file_no", "offset", "reason", F.col("name").alias("text"))


def read_pairs(spark: SparkSession, path1: str, path2: str, split_bytes: int = 128 << 20) -> DataFrame:
    """read_id, name, s1, q1, s2, q2 of two files whose records correspond."""
    from readloom.operators.reads import join_mates

    return join_mates(read_fastq(spark, path1, split_bytes), read_fastq(spark, path2, split_bytes))


def read_interleaved(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    from readloom.operators.reads import deinterleave

    return deinterleave(read_fastq(spark, path, split_bytes))


def read_fasta(spark: SparkSession, path: str, least: int = 0, split_bytes: int = 128 << 20) -> DataFrame:
    """gid, name, comment, seq; sequences shorter than `least` are left out."""
    register(spark)
    df = spark.read.format("readloom_fasta").option("splitBytes", split_bytes).load(path)
    return numbered(df, "gid").filter(F.length("seq") >= least).select("gid", "name", "comment", "seq")


def read_adapters(spark: SparkSession, path: str) -> DataFrame:
    """name, seq from a text of names and sequences separated by white space."""
    words = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\s+").alias("w"))
    pairs = words.select(F.posexplode(F.expr("transform(sequence(0, cast(size(w) / 2 as int) - 1), i -> struct(element_at(w, 2 * i + 1) as name, element_at(w, 2 * i + 2) as seq))")))
    return pairs.select("pos", "col.name", "col.seq").orderBy("seq").drop("pos")
