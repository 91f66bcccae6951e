"""Adapter detection from the head of the file: frequent seeds, extended along what nearly all their reads share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.common import materialize, written
from readloom.functions.ragged import flat
from readloom.operators.reads import bounded_head
from readloom.operators.stats import packed_words, words_of

#: Known adapters and the limits of detection.
KNOWN = ("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT", "GATCGTCGGACTGTAGAACTCTGAACGTGTAGA")
HEAD_READS = 262_144
HEAD_BASES = 151 * 262_144
LEAST_READS = 10_000
SEED = 10
FIRST_POSITION = 20
LONGEST = 60
LONGEST_BEFORE = 150
TOP = 10
FOLD = 20
DOMINANT = 0.95
OBSERVED = 50


def _seeds(trim_tail: int):
    shift = max(1, trim_tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(4**SEED, np.int64)
        for batch in batches:
            text, offsets = flat(batch.column(0))
            code, valid = packed_words(text, offsets, SEED)
            length = np.diff(offsets)
            pos = np.arange(len(text)) - np.repeat(offsets[:-1], length)
            valid &= (pos >= FIRST_POSITION) & (pos <= np.repeat(length, length) - SEED - shift)
            counts += np.bincount(code[valid], minlength=4**SEED)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(words_of(seen, SEED), pa.string()), pa.array(counts[seen])], ["seed", "n"])

    return run


def seed_counts(head: DataFrame, trim_tail: int = 0) -> DataFrame:
    """seed, n: words of 10 bases from position 20 on, without the last base and the tail to trim; low complexity, much GC
    and a beginning of GGGG are left out."""
    counts = head.select(F.upper("seq").alias("seq")).mapInArrow(_seeds(trim_tail), "seed string, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    of = lambda letters: SEED - F.length(F.translate("seed", letters, ""))
    simple = (of("A") >= 6) | (of("C") >= 6) | (of("G") >= 6) | (of("T") >= 6)
    return counts.filter(~simple & (of("GC") < 8) & ~F.col("seed").startswith("GGGG"))


def top_seeds(counts: DataFrame, k: int = TOP) -> DataFrame:
    # Ties go to the later seed in the order A, T, C, G.
    return counts.orderBy(F.desc("n"), F.desc(F.translate("seed", "ATCG", "0123"))).limit(k)


def dominant_path(texts: list[str], counts: np.ndarray) -> tuple[str, bool]:
    """Along the letters that nearly all of the texts share from their beginning; whether the end is for want of observations."""
    width = max(map(len, texts), default=0)
    letters = np.array([t.encode().ljust(width + 1, b"\0") for t in texts], f"S{width + 1}").view(np.uint8).reshape(len(texts), -1) if texts else np.zeros((0, 1), np.uint8)
    on = np.arange(len(texts))
    path = ""
    while True:
        column = letters[on, len(path)] if len(path) <= width else np.zeros(0, np.uint8)
        by = np.bincount(column, weights=counts[on], minlength=256) if len(column) else np.zeros(256)
        by[0] = 0  # texts that end here
        total = by.sum()
        if total < OBSERVED:
            return path, True
        letter = int(by.argmax())
        if by[letter] / total < DOMINANT:
            return path, False
        on = on[column == letter]
        path += chr(letter)


def _contexts(seeds: list[str], shift: int):
    """What follows each occurrence of a seed, and what precedes it backwards, counted per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, str, str], int] = {}
            for seq in batch.column(0).to_pylist():
                for i, seed in enumerate(seeds):
                    at = seq.find(seed, FIRST_POSITION)
                    while 0 <= at <= len(seq) - SEED - shift:
                        for side, text in (("after", seq[at + SEED : len(seq) - shift][:LONGEST]), ("before", seq[max(0, at - LONGEST_BEFORE) : at][::-1])):
                            counts[i, side, text] = counts.get((i, side, text), 0) + 1
                        at = seq.find(seed, at + 1)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["seed", "side", "text", "n"])

    return run


def _paths(table: pa.Table) -> pa.Table:
    path, leaf = dominant_path(table["text"].to_pylist(), table["n"].to_numpy().astype(float))
    return pa.table({"seed": pa.array(table["seed"][:1].to_pylist(), pa.int32()), "side": table["side"][:1].to_pylist(), "path": [path], "leaf": [leaf]})


def extensions(head: DataFrame, seeds: list[str], shift: int) -> dict[tuple[int, str], tuple[str, bool]]:
    """(seed, side) -> dominant path and whether it ended for want of observations, for all seeds in one pass over the head.

    A side's texts come from the head, whose size is fixed, and meet counted.
    """
    rows = head.select("seq").mapInArrow(_contexts(seeds, shift), "seed int, side string, text string, n bigint").groupBy("seed", "side", "text").agg(F.sum("n").alias("n"))
    found = rows.groupBy("seed", "side").applyInArrow(_paths, "seed int, side string, path string, leaf boolean").collect()
    return {(r["seed"], r["side"]): (r["path"], r["leaf"]) for r in found}


def detect_adapter(reads: DataFrame, trim_tail: int = 0, least_reads: int = LEAST_READS) -> str:
    """The adapter of the reads (read_id in file order, seq), or an empty string.

    Only the head of the file is looked at, whose size is a fixed value; it is written once, and two passes over it count
    the seeds and then what stands around the most frequent of them.
    """
    head = written(bounded_head(reads.select("read_id", F.upper("seq").alias("seq")), F.length("seq"), HEAD_READS, HEAD_BASES), "head")
    if head.count() < least_reads:
        return ""
    counts = materialize(seed_counts(head, trim_tail))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    seeds = []
    for r in top_seeds(counts).collect():
        if r["n"] < 10 or r["n"] * 4**SEED < total * FOLD:
            break
        if sum(a != b for a, b in zip(r["seed"], r["seed"][1:])) >= 3:
            seeds.append(r["seed"])
    found = extensions(head, seeds, max(1, trim_tail)) if seeds else {}
    for i, seed in enumerate(seeds):
        (after, leaf1), (before, leaf2) = (found.get((i, side), ("", True)) for side in ("after", "before"))
        adapter = (before[::-1] + seed + after)[:LONGEST]
        known = next((k for k in KNOWN if adapter.startswith(k)), None)
        if known:
            return known
        if leaf1 and leaf2:
            return adapter
    return ""
