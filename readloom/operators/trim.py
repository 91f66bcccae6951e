"""Trimming and filtering of single reads: the whole chain in one pass over Arrow batches.

Reads of similar length form a matrix and every step works on all of them at once; nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import kernels as K
from readloom.functions.ragged import Block, blocks, flat, sliced
from readloom.options import Options


def adapter_list(adapters: DataFrame, most: int = 10_000) -> list[str]:
    """The list's distinct sequences, upper case and sorted; a list is small and its size is checked."""
    rows = adapters.select(F.upper(F.trim("seq")).alias("s")).filter("s IS NOT NULL AND s <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} adapters")
    return sorted(r["s"] for r in rows)


def list_match(adapters: list[str]) -> int:
    """Bases that must match: more if the list is long."""
    return 6 if len(adapters) > 256 else 5 if len(adapters) > 16 else 4


def zero_past(b: np.ndarray, length: np.ndarray) -> None:
    b[np.arange(b.shape[1]) >= length[:, None]] = 0


def cut_list(b: np.ndarray, length: np.ndarray, adapters: list[str], match: int) -> tuple[np.ndarray, np.ndarray]:
    """Each adapter of the list in turn: (new length, bases removed, counted once)."""
    now, any_cut = length, np.zeros(len(length), bool)
    for a in adapters:
        now, _, removed = K.cut_adapter(b, now, np.frombuffer(a.encode(), np.uint8), match)
        any_cut |= removed > 0
    return now, np.where(any_cut, length - now, 0)


def shifted(block: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = begin[:, None] + np.arange(block.shape[1])
    out = np.take_along_axis(block, np.minimum(at, block.shape[1] - 1), axis=1)
    zero_past(out, length)
    return out


def trim_block(block: Block, o: Options, mate: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fixed and quality trimming of one block: (ok, first base, length, bases, quals), the matrices shifted to the first base."""
    front, tail = (o.front1, o.tail1) if mate == 1 else (o.front2, o.tail2)
    n = len(block.rows)
    ok, begin, length = np.ones(n, bool), np.zeros(n, np.int64), block.lengths.copy()
    if front or tail or o.cut5 or o.cut3:
        ok, first, kept = K.trim_ends(block.bases, block.quals, block.lengths, front, tail, o.cut5, o.cut3, o.cut_window, o.cut_quality, o.phred)
        begin, length = np.where(ok, first, 0), np.where(ok, kept, block.lengths)
    b, q = shifted(block.bases, begin, length), shifted(block.quals, begin, length)
    return ok, begin, length, b, q


def poly(b: np.ndarray, length: np.ndarray, ok: np.ndarray, o: Options) -> np.ndarray:
    now = length
    if o.poly_g:
        now = np.where(ok, K.trim_poly_g(b, now, o.poly_length), now)
        zero_past(b, now)
    if o.poly_x:
        now = np.where(ok, K.trim_poly_x(b, now, o.poly_length), now)
        zero_past(b, now)
    return now


def _chain(o: Options, adapter: str, adapters: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, qual = flat(batch.column(0)), flat(batch.column(1))
            n = batch.num_rows
            size = np.diff(seq[1])
            res = {k: np.zeros(n, np.int64) for k in ("begin", "length", "removed", "pos", "code")}
            good = np.ones(n, bool)
            for block in blocks(seq, qual, np.zeros(n, np.int64), size):
                ok, begin, length, b, q = trim_block(block, o)
                length = poly(b, length, ok, o)
                removed, pos = np.zeros(len(ok), np.int64), np.full(len(ok), -1000, np.int64)
                if o.trim_adapter and (adapter or adapters):
                    before = length
                    now = length
                    if adapter:
                        now, pos, removed = K.cut_adapter(b, now, np.frombuffer(adapter.encode(), np.uint8))
                    if adapters:
                        now, more = cut_list(b, now, adapters, list_match(adapters))
                        removed = removed + more
                    # reads whose trimming failed go on unchanged
                    length, removed, pos = np.where(ok, now, before), np.where(ok, removed, 0), np.where(ok, pos, -1000)
                zero_past(b, length)
                zero_past(q, length)
                code = K.filter_code(b, q, length, ok, o.shortest, o.longest, o.low_quality, o.low_percent, o.most_n, o.phred)
                for k, v in (("begin", begin), ("length", length), ("removed", removed), ("pos", pos), ("code", code)):
                    res[k][block.rows] = v
                good[block.rows] = ok
            new_seq, new_qual = sliced(*seq, res["begin"], res["length"]), sliced(*qual, res["begin"], res["length"])
            cut = sliced(*seq, res["begin"] + res["length"], np.where(res["removed"] > 0, size - res["begin"] - res["length"], 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], new_seq, new_qual, pa.array(good), pa.array(res["code"].astype(np.int32)), pa.array(res["removed"]), pa.array(res["pos"].astype(np.int32)), cut],
                [*batch.schema.names[2:], "seq", "qual", "trimmed_ok", "code", "adapter_bases", "adapter_pos", "after"],
            )

    return run


def trim_single(reads: DataFrame, options: Options = Options(), adapter: str = "", adapters: list[str] | None = None) -> DataFrame:
    """Reads after trimming, poly tails, one adapter, the adapter list and filtering, in this order.

    Needs seq and qual of equal length; all other columns are kept. Added: trimmed_ok, code (see filter_code),
    adapter_bases (removed, as counted), adapter_pos (of the single adapter, -1000 if not found), after (what stood
    behind the kept bases if an adapter was cut). Reads whose trimming failed keep their bases and get code 2.
    """
    keep = [c for c in reads.columns if c not in ("seq", "qual")]
    schema = ", ".join([*(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in keep), "seq string, qual string, trimmed_ok boolean, code int, adapter_bases bigint, adapter_pos int, after string"])
    return reads.select("seq", "qual", *keep).mapInArrow(_chain(options, adapter, list(adapters or [])), schema)


def trimmed_adapters(cut: DataFrame, column: str = "after", least: int = 0, share: float = 0.01) -> DataFrame:
    """How often each trimmed sequence was cut, of those that make up more than `share` of all: adapter, n."""
    rows = cut.filter((F.col("adapter_bases") > 0) & (F.length(column) >= least))
    counts = rows.groupBy(F.col(column).alias("adapter")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).filter(F.col("n") > share * F.col("total")).drop("total")
