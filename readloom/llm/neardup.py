"""Near-duplicate records by circulant MinHash, banding and exact verification.

Two permutations make all signature coordinates: the first scatters a record's words over the universe, the
second is shifted circularly by one place per coordinate, and the least value over the words is kept. Because
neighbouring coordinates read neighbouring entries of the second permutation, a word's values for all
coordinates are one contiguous slice. Records sharing a band become candidates, those whose signatures agree too little
are dropped, and the rest are verified on their word sets. Records with the same sequence form a class that is
represented once. A band that very many records share would make all their pairs candidates; its records are instead
joined exactly by the rarest of their words, of which similar records must share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.common import broadcast_if_small, clean_seq, delivered_once, materialize, written

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i

#: Ids that are broadcast at most (8 bytes each); more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000

#: Rows of a class or bucket beyond which its join work is spread over several tasks.
HOT = 2000
#: Records of a band beyond which they are joined by their rarest words instead.
HOT_BAND = 2000
#: Rarity of words is counted in 2^18 slots, whatever the number of words: that much is sent to the driver and the tasks.
SLOT_BITS = 18


def word_set(seq: bytes, k: int) -> np.ndarray:
    """The distinct words of k consecutive letters ACGT, two bits a letter, sorted."""
    a = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    words, bad = np.zeros(n, np.uint32), np.zeros(n, bool)
    for j in range(k):
        part = a[j : j + n]
        words = words << np.uint32(2) | (part & 3)
        bad |= part == 4
    return np.unique(words[~bad])


@cache
def _second_permutation(bits: int, seed: int, coordinates: int) -> np.ndarray:
    """Of the universe of 2^bits words, continued at its end by its beginning; made once per Python worker."""
    size = 1 << bits
    p = np.arange(size + coordinates, dtype=np.uint32)
    np.random.default_rng(seed).shuffle(p[:size])
    p[size:] = p[:coordinates]
    return p


def _first_permutation(words: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Odd multiplications and shifts, each of which is a bijection of the universe."""
    mask = np.uint32((1 << bits) - 1)
    x = words
    for factor in (0x9E3779B1, 0x85EBCA6B):
        x = x * np.uint32((factor ^ (seed << 1)) & 0xFFFFFFFF | 1) & mask
        x = x ^ x >> np.uint32(bits // 2)
    return x


def signature(words: np.ndarray, coordinates: int, k: int, seed: int = 1) -> np.ndarray:
    second = np.lib.stride_tricks.sliding_window_view(_second_permutation(2 * k, seed, coordinates), coordinates)
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    places = _first_permutation(words, 2 * k, seed)
    for at in range(0, len(places), 4096):
        np.minimum(least, second[places[at : at + 4096]].min(axis=0), out=least)
    return least


def _sketched(bands: int, rows: int, k: int):
    """Per record its bands and its sketch: one byte of every coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(7).integers(1, 1 << 62, rows, dtype=np.int64) | 1
        for batch in batches:
            ids, keys, sketches = [], [], []
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_set(seq.as_buffer().to_pybytes(), k)
                if len(words):
                    sig = signature(words, bands * rows, k)
                    with np.errstate(over="ignore"):
                        h = (sig.reshape(bands, rows).astype(np.int64) * weights).sum(axis=1) * np.int64(0x9E3779B97F4A7C1) + np.arange(bands)
                        keys.append(h ^ h >> np.int64(29))
                    # Least values are small numbers, so their low bits are the ones that differ.
                    sketches.append((sig & 255).astype(np.uint8).tobytes())
                    ids.append(i)
            if ids:
                buckets = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys), pa.int64()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), buckets, pa.array(sketches, pa.binary())], ["id", "buckets", "sketch"])

    return run


def least_agreement(coordinates: int, threshold: float, sigmas: float = 5.0) -> float:
    """Share of equal sketch bytes below which a pair is dropped: `sigmas` standard deviations under what is expected at the
    threshold, so that fewer than one in a million of the pairs there is lost."""
    expected = threshold + (1 - threshold) / 256
    return expected - sigmas * (expected * (1 - expected) / coordinates) ** 0.5


def _agreeing(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
                yield pa.RecordBatch.from_arrays([c.filter(pa.array((a == b).mean(axis=1) >= least)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _slots(words: np.ndarray) -> np.ndarray:
    return ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for seq in batch.column(1):
                counts += np.bincount(_slots(word_set(seq.as_buffer().to_pybytes(), k)), minlength=1 << SLOT_BITS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["slot", "n"])

    return run


def _rarest(k: int, threshold: Fraction, counts: np.ndarray):
    """Of each record the words of its prefix in the order of rarity: of two records with similarity of the threshold or more,
    the prefixes share a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, sizes = [], [], []
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = word_set(seq.as_buffer().to_pybytes(), k)
                if len(own):
                    first = len(own) - -(-len(own) * threshold.numerator // threshold.denominator) + 1
                    order = np.lexsort((own, counts[_slots(own)]))[:first]
                    words.append(own[order])
                    ids.append(np.full(first, i, np.int64))
                    sizes.append(np.full(first, len(own), np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(words).astype(np.int64)), pa.array(np.concatenate(sizes))], ["id", "word", "size"])

    return run


def _verify(k: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sim = [], [], []
            kept: tuple[int | None, np.ndarray | None] = (None, None)
            for ia, ib, sa, sb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if kept[0] != ia:
                    kept = ia, word_set(sa.as_buffer().to_pybytes(), k)
                wa, wb = kept[1], word_set(sb.as_buffer().to_pybytes(), k)
                both = len(np.intersect1d(wa, wb, assume_unique=True))
                either = len(wa) + len(wb) - both
                if either and both * threshold.denominator >= threshold.numerator * either:
                    a.append(ia)
                    b.append(ib)
                    sim.append(both / either)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    return run


def spread_self_join(rows: DataFrame, key: str, value: str, size: str | None = None, ratio: float = 0.0, counts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of values that share a key, each once; with `size` only those whose sizes are within the ratio.
    `counts` (key, n) of the keys to join, if they are known already.

    Keys with one row are dropped first. A key with many rows is cut into blocks of HOT: its left rows go to
    their block's task, its right rows to each, so that no task takes more than HOT rows times the key's.
    """
    counted = counts if counts is not None else rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.filter("n > 1").select(key, F.col("n").alias("__n"))
    shared = materialize(rows.join(sizes, key))
    blocks = F.ceil(F.col("__n") / HOT).cast("int")
    more = lambda name: [F.col(size).alias(name)] if size else []
    left = shared.select(key, F.col(value).alias("a"), *more("sa"), F.pmod(F.xxhash64(value), blocks).cast("int").alias("__block"))
    right = shared.select(key, F.col(value).alias("b"), *more("sb"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__block"))
    pairs = left.join(right, [key, "__block"]).filter(F.col("a") < F.col("b"))
    if size:
        pairs = pairs.filter((F.col("sa") >= F.col("sb") * ratio - 1e-9) & (F.col("sb") >= F.col("sa") * ratio - 1e-9))
    return pairs.select("a", "b").distinct()


class NearDuplicates:
    """Classes of equal sequences and the links between their representatives.

    Needs the id (a whole number) and the text column; other columns are ignored. Rows with a null id or text
    are left out; texts without a word of `k` letters ACGT are classes of their own and have no links. Rows
    delivered again count once. An empty table gives empty results.

    members: id, class_id (least id with the same text), copies; links: a, b, similarity, for each two
    representatives a < b whose similarity reaches the threshold. With 68 bands of 4 coordinates a pair at
    0.6 is found with probability 1 - (1 - 0.6^4)^68, which is more than 0.9999; more similar pairs surer. Pairs of records
    that meet only in bands of more than HOT_BAND records are found exactly, without making the pairs of the band.
    `counts` tells candidates, those whose signatures agree, hot bands and their records; it costs a job.
    """

    def __init__(self, df: DataFrame, id_col: str, text: str, k: int = 12, threshold: float = 0.6, bands: int = 68, rows: int = 4) -> None:
        exact = Fraction(str(threshold))
        once = delivered_once(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).dropna(), "id")
        once = once.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
        # Written once: most of what follows reads just the numbers.
        once = written(once, "texts")
        classes = once.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
        # Only classes with copies are joined back, each with 16 salts: a hot class's members meet it in 16 tasks.
        copied = classes.filter(F.col("copies") > 1).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        ids = once.select("id", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("salt"))
        self.members = materialize(ids.join(copied, ["h1", "h2", "salt"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies")))
        self.texts = once.select("id", F.col("text").cast("binary").alias("text"))
        copies = self.members.filter(F.col("id") != F.col("class_id")).select("id")
        leaders = self.texts.join(broadcast_if_small(copies, copies.count(), BROADCAST_IDS), "id", "left_anti")
        # Written once: bucket sizes and joins read it, and signatures are the costly part.
        sketched = written(leaders.mapInArrow(_sketched(bands, rows, k), "id bigint, buckets array<bigint>, sketch binary"), "sketches")
        banded = sketched.select("id", F.explode("buckets").alias("bucket"))
        counts = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
        hot = counts.filter(F.col("n") > HOT_BAND)
        n_hot = hot.count()
        crowded = None
        if n_hot:
            small = broadcast_if_small(hot.select("bucket"), n_hot, BROADCAST_IDS)
            crowded = materialize(banded.join(small, "bucket", "left_semi").select("id").distinct())
        self._candidates = spread_self_join(banded, "bucket", "id", counts=counts.filter(F.col("n") <= HOT_BAND))
        if crowded is not None:
            self._candidates = self._candidates.unionByName(self._by_rarest(leaders, crowded, k, exact)).distinct()
        self._candidates = materialize(self._candidates)
        sketch = lambda c: sketched.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
        with_sketches = self._candidates.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sa", "sb")
        pairs = materialize(with_sketches.mapInArrow(_agreeing(least_agreement(bands * rows, threshold)), "a bigint, b bigint"))
        self._agreed, self._hot, self._crowded = pairs, hot, crowded
        # Only texts of some pair move to their partners.
        paired = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        texts = self.texts.join(broadcast_if_small(paired, paired.count(), BROADCAST_IDS), "id")
        with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        with_both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        self.links = materialize(with_both.mapInArrow(_verify(k, exact), "a bigint, b bigint, similarity double"))
        self.k = k

    @staticmethod
    def _by_rarest(leaders: DataFrame, crowded: DataFrame, k: int, threshold: Fraction) -> DataFrame:
        """Pairs of the crowded records that can reach the threshold: their prefixes share a word and their sizes fit."""
        docs = written(leaders.join(broadcast_if_small(crowded, crowded.count(), BROADCAST_IDS), "id"), "crowded").select("id", "text")
        slots = docs.mapInArrow(_slot_counts(k), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for r in slots.collect():  # at most 2^SLOT_BITS rows
            counts[r["slot"]] = r["n"]
        prefixes = written(docs.mapInArrow(_rarest(k, threshold, counts), "id bigint, word bigint, size int"), "prefixes")
        return spread_self_join(prefixes, "word", "id", "size", float(threshold))

    def counts(self) -> dict[str, int]:
        return {"candidates": self._candidates.count(), "agreeing": self._agreed.count(), "hot_bands": self._hot.count(), "crowded": self._crowded.count() if self._crowded is not None else 0, "links": self.links.count()}

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of all similar records, copies expanded; asked for only where the result is pairs."""
        m = self.members.select("id", "class_id")
        across = self.links.select("a", "b").join(m.select(F.col("class_id").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("class_id").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
        worded = self.texts.filter(F.col("text").cast("string").rlike(f"[ACGT]{{{self.k}}}")).select(F.col("id").alias("class_id"))
        copies = self.members.filter(F.col("copies") > 1).select("id", "class_id").join(worded, "class_id")
        inside = spread_self_join(copies, "class_id", "id").toDF("x", "y")
        return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self, max_rounds: int = 50) -> DataFrame:
        """One row per record: id, class_id, copies, links (of its class), group_id (least class of its component)."""
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
        root = components(both, max_rounds)
        per_class = degree.join(root, "a").select(F.col("a").alias("class_id"), "links", F.col("root").alias("group_id"))
        return self.members.join(per_class, "class_id", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))


def components(both: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, root) of every node, root the least node of its component, by hooking and pointer jumping.

    `both` has each link in both directions. Every round takes the least root among the neighbours and then
    the root's root, so the rounds grow with the logarithm of the longest path. Each is written to the shared
    folder, and only the number of changes comes to the driver.
    """
    both = materialize(both)
    root = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(root.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b").groupBy("a").agg(F.min("rb").alias("near"))
        hooked = root.join(near, "a").select("a", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # The old root hooks to the least root any of its nodes saw, and every node jumps to its root's root.
        hooks = hooked.groupBy("old").agg(F.min("root").alias("jump"))
        moved = hooked.join(hooks, "old").select("a", "old", F.least("root", "jump").alias("root"))
        jump = moved.select(F.col("a").alias("root"), F.col("root").alias("next"))
        after = materialize(moved.join(jump, "root", "left").select("a", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = after.filter(F.col("old") != F.col("root")).limit(1).count()
        root = after.select("a", "root")
        if not changed:
            return root
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def similar_reads(reads: DataFrame) -> NearDuplicates:
    """Reads compared as written, in one direction: words of 12 letters, similarity 0.6 or more."""
    return NearDuplicates(reads.select("read_id", clean_seq("seq").alias("seq")), "read_id", "seq")
