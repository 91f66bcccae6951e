"""Filling containers with texts: variable-capacity best fit.

Texts are spread evenly over groups of bounded size and each group is packed by itself, so only a few containers
per group are less full than they could be. In a group items come in falling size. Each goes to the open
container with the least room that holds it; if none does, a container is opened, of the permitted size that costs least
per token it will hold, as far as what is still to come can fill it. At last every container is made as small as
its contents allow, and the contents of the worst filled ones are packed again into whatever sizes cost less, the best
filling of each found by dynamic programming over subset sums.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.common import written
from readloom.llm.tokens import token_counts

#: So many of the worst filled containers are packed again, together.
REPACKED = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
#: Items that are packed again at a time; subset sums take time in proportion to items times capacity.
MOST_ITEMS = 2048


def least_cost(size: int, to_come: int, capacities: Sequence[int]) -> int:
    """The capacity to open for an item: least capacity per token it will hold if what is to come (the item and all smaller
    ones) fills it as far as it can; of equal ones the largest, which leaves most ways to fill it."""
    return min((c for c in capacities if c >= size), key=lambda c: (c / max(1, min(c, to_come)), -c))


def best_fit(sizes: Sequence[int], capacities: Sequence[int]) -> list[int]:
    """Container number of each item; items must be in falling order and at most the largest capacity."""
    rooms: list[int] = []  # distinct rooms of open containers, rising
    holders: dict[int, list[int]] = {}
    bins, to_come = 0, int(sum(sizes))
    out = []
    for size in sizes:
        i = bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            number = holders[room].pop()
            if not holders[room]:
                del holders[room]
                rooms.pop(i)
        else:
            room = least_cost(size, to_come, capacities)
            number, bins = bins, bins + 1
        room -= size
        to_come -= size
        if room in holders:
            holders[room].append(number)
        else:
            holders[room] = [number]
            insort(rooms, room)
        out.append(number)
    return out


def fullest(sizes: Sequence[int], capacities: Sequence[int]) -> list[list[int]]:
    """Per capacity the items (by place) that fill it as far as can be; sums are bits of whole numbers."""
    mask = (1 << (capacities[-1] + 1)) - 1
    sums = [1]
    for s in sizes:
        sums.append((sums[-1] | sums[-1] << s) & mask)
    out = []
    for c in capacities:
        rest = (sums[-1] & ((1 << (c + 1)) - 1)).bit_length() - 1
        chosen = []
        for i in range(len(sizes) - 1, -1, -1):
            if not sums[i] >> rest & 1:  # without this item the sum can't be reached
                chosen.append(i)
                rest -= sizes[i]
        out.append(chosen)
    return out


def packed_again(sizes: list[int], capacities: Sequence[int]) -> list[tuple[int, list[int]]]:
    """(capacity, items) of containers for these items, each time the one that costs least per token, filled as far as can be."""
    left = list(range(len(sizes)))
    out = []
    while left:
        own = [sizes[i] for i in left]
        ways = fullest(own, capacities)
        costs = [(c / max(1, sum(own[i] for i in w)), -c, c, w) for c, w in zip(capacities, ways) if w or not sum(own)]
        *_, capacity, way = min(costs, key=lambda x: x[:2])
        taken = set(way) | {i for i, s in enumerate(own) if s == 0}
        out.append((capacity, [left[i] for i in sorted(taken)]))
        left = [x for i, x in enumerate(left) if i not in taken]
    return out


def pack(sizes: np.ndarray, capacities: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, capacity of each container), with little total capacity."""
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    allowed = np.asarray(capacities)
    container = np.empty(len(sizes), np.int64)
    container[order] = best_fit(sizes[order].tolist(), capacities)
    filled = np.bincount(container, weights=sizes).astype(np.int64)
    shrunk = allowed[np.searchsorted(allowed, filled)]
    worst = np.argsort(filled - shrunk, kind="stable")  # the most unused first
    best = None
    for n in REPACKED:
        again = worst[:n]
        items = np.flatnonzero(np.isin(container, again))
        if len(items) > MOST_ITEMS:
            break
        new = packed_again(sizes[items].tolist(), capacities)
        gain = shrunk[again].sum() - sum(c for c, _ in new)
        if gain > 0 and (best is None or gain > best[0]):
            best = gain, again, items, new
        if n >= len(worst):
            break
    if best is None:
        return container, shrunk
    _, again, items, new = best
    number = np.cumsum(~np.isin(np.arange(len(shrunk)), again)) - 1  # the others keep their order
    kept = np.delete(shrunk, again)
    container = number[container]
    for i, (_, own) in enumerate(new):
        container[items[own]] = len(kept) + i
    return container, np.append(kept, [c for c, _ in new])


_PLACED = "scheme string, doc_id bigint, part int, first_token bigint, tokens bigint, container bigint, capacity int"


def _pack_groups(schemes: list[tuple[str, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0), b.column(1), b.column(2)) for b in batches]
        if not got:
            return
        group, ids, tokens = (np.concatenate([np.asarray(x[i].to_numpy(zero_copy_only=False)) for x in got]) for i in range(3))
        for g in np.unique(group):
            mine = group == g
            rank = np.argsort(ids[mine], kind="stable")  # the same result however rows arrive
            own, size = ids[mine][rank], tokens[mine][rank]
            for name, capacities in schemes:
                most = capacities[-1]
                # Only what exceeds the largest capacity is split, into full parts and a rest.
                parts = np.maximum(1, -(-size // most))
                item = np.repeat(np.arange(len(own)), parts)
                part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = part * most
                length = np.minimum(most, size[item] - first)
                container, capacity = pack(length, capacities)
                for at in range(0, len(item), 50_000):
                    s = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(item[s]), pa.string()),
                            pa.array(own[item[s]], pa.int64()),
                            pa.array(part[s].astype(np.int32), pa.int32()),
                            pa.array(first[s], pa.int64()),
                            pa.array(length[s], pa.int64()),
                            pa.array((int(g) << 32) + container[s], pa.int64()),
                            pa.array(capacity[container[s]].astype(np.int32), pa.int32()),
                        ],
                        ["scheme", "doc_id", "part", "first_token", "tokens", "container", "capacity"],
                    )

    return run


def pack_documents(docs: DataFrame, budgets: DataFrame, group_rows: int = 20_000, vocabulary: str | None = None) -> DataFrame:
    """Containers of every document: scheme, doc_id, part, first_token, tokens, container, capacity.

    One scheme per row of `budgets` (budget_name, capacity) packs into containers of that capacity alone;
    the scheme `joint` may use all capacities. A text is split only if it exceeds the (largest) capacity, into
    parts of consecutive tokens. Container numbers are unique within a scheme. Needs `doc_id` and `text`;
    repeated rows count once; a null or empty text takes no room but has a place; budgets that are null or
    not positive are left out. Without documents or budgets the result is empty.

    `group_rows` bounds what one task packs at a time; the number of groups follows the number of documents. More groups
    cost capacity: the last containers of each are not full.
    """
    spark = SparkSession.active()
    rows = budgets.select("budget_name", F.col("capacity").cast("int")).filter("capacity > 0").distinct().orderBy("capacity", "budget_name").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 token budgets")
    if not rows:
        return spark.createDataFrame([], _PLACED)
    schemes = [(r[0], [r[1]]) for r in rows] + [("joint", sorted({r[1] for r in rows}))]
    sized = written(token_counts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"], vocabulary=vocabulary).distinct(), "tokens")
    groups = max(1, -(-sized.count() // group_rows))
    keyed = sized.filter(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), "doc_id", "tokens")
    return keyed.repartition(groups, "group").mapInArrow(_pack_groups(schemes), _PLACED)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per scheme: containers, tokens, total capacity and the share of it that is filled."""
    per = placed.groupBy("scheme", "container").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    return per.groupBy("scheme").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.sum("capacity").alias("capacity"),
        (F.sum("tokens") / F.sum("capacity")).alias("filled"),
    )
