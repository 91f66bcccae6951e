"""Links between reads and the sequences they need, as arrays of numbers that move in few large rows.

A row of a table of arrays holds, for one part, a kind and up to four arrays. Hashes meet by hash, pairs by the larger read
(a pair and the pair of its mates in the same part), so that each is kept once; then every read learns all its neighbours.
Reads with the same smallest neighbour form a group. Groups are spread over the parts, and a sequence moves once to each part
that needs it, however many pairs it belongs to there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.common import count_written, drop_written, written
from readloom.functions.ragged import flat

ARRAYS = "part int, kind int, a binary, b binary, c binary, d binary"
_NAMES = ["part", "kind", "a", "b", "c", "d"]
LIST, WANTED, READS = 0, 1, 2

#: Reads whose hashes are sent together; hashes in a part, about.
_TOGETHER, _HASHES = 1 << 17, 4_000_000
#: Pairs that a task holds before it takes out those found again, and about how many a part of the anchors has.
_HELD, _ALIGNED = 1 << 22, 1_000_000

_FACTORS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in _FACTORS:
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def place(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


# --- arrays in rows ------------------------------------------------------------------------------------


def _bytes(x: np.ndarray) -> bytes:
    """Numbers from 0 in 1, 2 or 4 bytes if they fit; the first byte tells how many."""
    if x.dtype.kind == "i" and x.dtype.itemsize > 1:
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        size = 8 if low < 0 or high >= 1 << 32 else 4 if high >= 1 << 16 else 2 if high >= 1 << 8 else 1
        x = x.astype(f"u{size}" if size < 8 else np.int64)
    return bytes([x.dtype.itemsize]) + np.ascontiguousarray(x).tobytes()


def _array(b: bytes, unsigned: bool = False) -> np.ndarray:
    out = np.frombuffer(b, f"u{b[0]}" if unsigned or b[0] < 8 else np.int64, offset=1)
    return out if unsigned else out.astype(np.int64)


def rising(x: np.ndarray) -> bytes:
    """Numbers that don't fall, as the first and the differences."""
    return np.int64(x[0]).tobytes() + _bytes(np.diff(x))


def risen(rows: list[list[bytes]], column: int) -> np.ndarray:
    parts = [np.concatenate([np.frombuffer(r[column][:8], np.int64), _array(r[column][8:])]).cumsum() for r in rows]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def row(part: int, kind: int, *arrays: np.ndarray | bytes) -> tuple:
    return (part, kind, *(x if isinstance(x, bytes) else _bytes(x) for x in arrays), *[None] * (4 - len(arrays)))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], _NAMES)


def send(parts: int, part: np.ndarray, kind: int, *arrays: np.ndarray, sort: bool = False) -> Iterator[pa.RecordBatch]:
    """One row for each part that gets something, in the order given. With `sort`, the first array doesn't fall."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(ends)):
        first, *rest = (x[order[ends[p] : ends[p + 1]]] for x in arrays)
        rows.append(row(int(p), kind, rising(first) if sort else first, *rest))
    yield batch(rows)


def received(batches: Iterator[pa.RecordBatch]) -> dict[int, list[list[bytes]]]:
    out: dict[int, list[list[bytes]]] = {}
    for b in batches:
        for _, kind, *arrays in zip(*(c.to_pylist() for c in b.columns)):
            out.setdefault(kind, []).append(arrays)
    return out


def joined(rows: list[list[bytes]], column: int, unsigned: bool = False) -> np.ndarray:
    return np.concatenate([_array(r[column], unsigned) for r in rows]) if rows else np.empty(0, np.int64)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, ordered by a, then b."""
    if not len(a):
        return a, b
    table = None
    if min(a.min(), b.min()) < 0 or max(a.max(), b.max()) >= 1 << 32:
        table = np.unique(np.concatenate([a, b]))
        a, b = np.searchsorted(table, a), np.searchsorted(table, b)
    key = np.sort(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    a, b = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (a, b) if table is None else (table[a], table[b])


# --- links ---------------------------------------------------------------------------------------------


def _few(order: np.ndarray, h: np.ndarray, limit: int) -> np.ndarray:
    """Of each hash the first limit + 1 rows, which tell that its bucket is too large."""
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return order[np.arange(len(s)) - start <= limit]


def _send_hashes(least: Callable, maps: range, parts: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held])
            for n, m in enumerate(maps):
                h = np.concatenate([x[n] for _, x in held])
                take = _few(np.argsort(h), h, limit)
                yield from send(parts, ((h[take] & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32), m, h[take], ids[take])
            held.clear()

        for b in batches:
            ids, h = least(b, maps)
            if len(ids):
                held.append((ids, h))
            if sum(len(i) for i, _ in held) >= _TOGETHER:
                yield from sent()
        if held:
            yield from sent()

    return run


def _send_stored(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, maps, h = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            h = h.astype(np.int64).view(np.uint64)
            for m in np.unique(maps):
                own = maps == m
                yield from send(parts, ((h[own] & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32), int(m), h[own], ids[own].astype(np.int64))

    return run


def bucket_pairs(h: np.ndarray, ids: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller, larger) of all pairs in buckets of no more than `limit` reads."""
    order = np.argsort(h)
    s, ids = h[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.concatenate([start, [len(s)]]))
    for n in np.unique(size[(size > 1) & (size <= limit)]):
        own = ids[start[size == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        step = max(1, _HELD // len(i))
        for at in range(0, len(own), step):
            x, y = own[at : at + step][:, i].ravel(), own[at : at + step][:, j].ravel()
            yield np.minimum(x, y), np.maximum(x, y)


def _pairs(parts: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for rows in received(batches).values():
            for x, y in bucket_pairs(joined(rows, 0, True), joined(rows, 1), limit):
                x, y = x[x != y], y[x != y]
                a.append(x)
                b.append(y)
                held += len(x)
                if held > max(_HELD, len(a[0])):
                    once = unique_pairs(np.concatenate(b), np.concatenate(a))
                    b, a, held = [once[0]], [once[1]], 0
        if a:
            large, small = unique_pairs(np.concatenate(b), np.concatenate(a))
            yield from send(parts, place(large >> 1, parts), 0, large, small, sort=True)

    return run


def mates_linked(large: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Whether the mates of a pair are a pair too (mates are reads 2i and 2i + 1)."""
    table = np.unique(np.concatenate([large, small]))
    n = len(table)

    def code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(table, x), np.searchsorted(table, y)
        known = (table[np.minimum(i, n - 1)] == x) & (table[np.minimum(j, n - 1)] == y)
        return np.where(known, i * n + j, -1)

    x, y = large ^ 1, small ^ 1
    other = code(np.maximum(x, y), np.minimum(x, y))
    return (other >= 0) & np.isin(other, code(large, small))


def _once(mates: bool = False):
    """Different pairs of a part, and with `mates` whether those of their mates are pairs too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for b in batches:
                part = b.column(0)[0].as_py() if b.num_rows else part
                yield b

        rows = received(seen()).get(0, [])
        if rows:
            large, small = unique_pairs(risen(rows, 0), joined(rows, 1))
            yield batch([row(part, 0, rising(large), small, *([mates_linked(large, small).astype(np.int64)] if mates else []))])

    return run


def _directed(parts: int, mates: bool):
    """Each pair to the parts of both reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in ([r] for r in received(iter([b])).get(0, [])):
                large, small, more = risen(rows, 0), joined(rows, 1), [joined(rows, 2)] if mates else []
                yield from send(parts, place(large, parts), 0, large, small, *more, sort=True)
                by = np.argsort(small, kind="stable")
                large, small, more = large[by], small[by], [x[by] for x in more]
                yield from send(parts, place(small, parts), 0, small, large, *more, sort=True)

    return run


def _lists(parts: int, mates: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = received(batches).get(0, [])
        if not rows:
            return
        x, y = risen(rows, 0), joined(rows, 1)
        order = np.lexsort((y, x)) if min(x.min(), y.min()) < 0 or max(x.max(), y.max()) >= 1 << 32 else np.argsort(x << 32 | y)
        x, y = x[order], y[order]
        start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        own, counts = x[start], np.diff(np.concatenate([start, [len(x)]]))
        block = place(np.minimum(own, y[start]), parts)
        each = np.repeat(block, counts)
        paired = joined(rows, 2)[order] if mates else None
        by = np.argsort(block, kind="stable")
        by_each = np.argsort(each, kind="stable")
        ends, ends_each = np.searchsorted(block[by], np.arange(parts + 1)), np.searchsorted(each[by_each], np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(ends)):
            few, all_of = by[ends[p] : ends[p + 1]], by_each[ends_each[p] : ends_each[p + 1]]
            out.append(row(int(p), LIST, own[few], counts[few], y[all_of], *([paired[all_of]] if mates else [])))
        yield batch(out)
        want, block_of = unique_pairs(np.concatenate([y, own]), np.concatenate([each, block]).astype(np.int64))
        yield from send(parts, place(want, parts), WANTED, want, block_of, sort=True)

    return run


def packed(text: np.ndarray) -> np.ndarray:
    """Bases 0 to 3, four a byte."""
    padded = np.zeros(-(-len(text) // 4) * 4, np.uint8)
    padded[: len(text)] = text
    four = padded.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


def unpacked(b: np.ndarray, n: int) -> np.ndarray:
    return (b[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n]


_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def _rows(offsets: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Places of the letters of some rows."""
    n = np.diff(offsets)[take]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1][take] - (ends - n), n)


def _send_texts(parts: int, part: np.ndarray, ids: np.ndarray, text: np.ndarray, offsets: np.ndarray, quals: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(ends)):
        take = order[ends[p] : ends[p + 1]]
        at = _rows(offsets, take)
        out.append(row(int(p), READS, ids[take], np.diff(offsets)[take], packed(text[at]), *([quals[at]] if quals is not None else [])))
    if out:
        yield batch(out)


def _send_reads(parts: int, quals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, offsets = flat(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield from _send_texts(parts, place(ids, parts), ids, _CODE[text], offsets, flat(b.column(2))[0] if quals else None)

    return run


class Reads:
    """Reads of a part in order of their ids: bases 0 to 3 in one text with offsets, and qualities if they count."""

    def __init__(self, rows: list[list[bytes]], quals: bool) -> None:
        ids, length = joined(rows, 0), joined(rows, 1)
        sizes = [int(_array(r[1]).sum()) for r in rows]
        text = np.concatenate([unpacked(_array(r[2], True), n) for r, n in zip(rows, sizes)]) if rows else np.empty(0, np.uint8)
        self.ids, order = np.unique(ids, return_index=True)
        offsets = np.concatenate([[0], np.cumsum(length)])
        at = _rows(offsets, order)
        self.length = length[order]
        self.text, self.offsets = text[at], np.concatenate([[0], np.cumsum(self.length)])
        self.quals = joined(rows, 3, True)[at] if quals and rows else None

    @cached_property
    def both_ways(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Bases and qualities of all reads, and after them those of the reverse complements from the last read to the first."""
        return np.concatenate([self.text, 3 - self.text[::-1]]), None if self.quals is None else np.concatenate([self.quals, self.quals[::-1]])

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def _deliver(parts: int, quals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = received(batches)
        if got.get(WANTED) and got.get(READS):
            reads = Reads(got[READS], quals)
            want, block = unique_pairs(risen(got[WANTED], 0), joined(got[WANTED], 1))
            i = reads.at(want)
            known = reads.ids[np.minimum(i, len(reads.ids) - 1)] == want
            i, block = i[known], block[known]
            at = _rows(reads.offsets, i)
            offsets = np.concatenate([[0], np.cumsum(reads.length[i])])
            yield from _send_texts(parts, block, reads.ids[i], reads.text[at], offsets, reads.quals[at] if quals else None)

    return run


def number_of_parts(ready: DataFrame, reads: int, maps: int) -> int:
    return max(int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reads * maps // _HASHES))


def grouped(ready: DataFrame, parts: int, limit: int, source: Callable[[range], tuple[DataFrame, Callable]], maps: int, rounds: int, mates: bool, quals: bool) -> DataFrame:
    """Arrays by part: lists of neighbours (LIST) and all sequences they need (READS).

    `source` gives for some maps a table and what makes hashes of it. The maps are gone through in rounds, so that no more
    than a part of their hashes is on disk at once."""
    route = lambda df, n=parts: df.repartitionById(n, "part")
    spark = ready.sparkSession
    step, before = -(-maps // rounds), count_written()
    links = None
    for first in range(0, maps, step):
        table, hashes = source(range(first, min(maps, first + step)))
        pairs = route(table.mapInArrow(hashes, ARRAYS)).mapInArrow(_pairs(parts, limit), ARRAYS)
        found = written(route(pairs).mapInArrow(_once(), ARRAYS), "links")
        links = found if links is None else links.unionByName(found)
    once = written(route(links).mapInArrow(_once(mates), ARRAYS), "links")
    drop_written(spark, before, -1)  # what the rounds found
    size = once.agg(F.coalesce(F.sum(F.length("b")), F.lit(0))).first()[0]
    blocks = max(parts, -(-size // (2 * _ALIGNED)))  # 4 bytes a pair, which is aligned from both sides
    lists = written(route(once.mapInArrow(_directed(blocks, mates), ARRAYS), blocks).mapInArrow(_lists(blocks, mates), ARRAYS), "lists")
    drop_written(spark, before, -1)  # the links, which are in the lists
    texts = ready.select("read_id", "seq", *(["qual"] if quals else [])).mapInArrow(_send_reads(blocks, quals), ARRAYS)
    moved = route(lists.filter(F.col("kind") == WANTED).unionByName(texts), blocks).mapInArrow(_deliver(blocks, quals), ARRAYS)
    return route(lists.filter(F.col("kind") == LIST).unionByName(moved), blocks)


def stored(maps_of: DataFrame, parts: int, maps: range) -> tuple[DataFrame, Callable]:
    return maps_of.filter(F.col("map").between(maps[0], maps[-1])).select("read_id", "map", "hash"), _send_stored(parts)
