"""Error correction of reads: minhash candidates, shifted Hamming alignment, consensus of the aligned reads.

Reads that share a minhash in any map are candidates of each other. Every read is in turn the anchor: its candidates
are aligned in both directions without gaps, those that agree too little are dropped, the rest form columns, reads of
another genomic region are taken out, and the consensus corrects the anchor. Candidates, alignment and columns are
bounded per anchor by the limit on buckets, which belongs to the method: larger buckets are repeats.

Anchors with a common smallest neighbour are worked on together (`neighbours`): a sequence moves once to each part that needs
it, each unordered pair of a part is aligned once for both sides as bit planes, and what the limits on mismatches leave is
piled up where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.common import broadcast_if_small, materialize, written
from readloom.functions import kernels as K
from readloom.functions.ragged import flat, matrix, to_strings
from readloom.operators import neighbours as N
from readloom.operators.forest import Forest
from readloom.options import Options

_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_INDEX = np.full(256, 4, np.int64)
_INDEX[_LETTERS] = np.arange(4)

#: Put before the label in a name.
LABEL = " corrected:q="

# --- reads as the corrector sees them ------------------------------------------------------------------


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, offsets = flat(batch.column(0))
        text = np.where((text >= 97) & (text <= 122), text - 32, text).astype(np.uint8)
        other = _INDEX[text] == 4
        # The n-th other letter of a read becomes A, C, G, T in turn.
        nth = np.cumsum(other)
        first = np.repeat(np.concatenate([[0], nth])[offsets[:-1]], np.diff(offsets))
        text[other] = _LETTERS[(nth[other] - 1 - first[other]) % 4]
        ambiguous = np.diff(np.concatenate([[0], nth])[offsets]) > 0
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], to_strings(text, offsets), pa.array(ambiguous)], [*batch.schema.names[1:], "seq", "ambiguous"])


def prepared(reads: DataFrame) -> DataFrame:
    """read_id, qual, seq in upper case with plain bases only, and whether it had others. The replacement counts by
    read, not over all reads, so it doesn't depend on their order."""
    return reads.select("seq", "read_id", "qual").mapInArrow(_prepare, "read_id bigint, qual string, seq string, ambiguous boolean")


def quality_bin(qual: str, bits: int, phred: int = 33):
    """Quality in 1 bit (13) or 2 bits (4, 13, 20) as the least quality of its bin; 8 bits keep it."""
    if bits == 8:
        return F.col(qual)
    steps = (13,) if bits == 1 else (4, 13, 20)
    out = F.col(qual)
    low = phred
    source, target = "", ""
    for s in [*steps, 93]:
        for c in range(low, min(phred + s, 126) + 1):
            source += chr(c)
            target += chr(low)
        low = phred + s + 1
    return F.translate(out, source, target)


def quality_weight(qual: np.ndarray, phred: int = 33) -> np.ndarray:
    return np.maximum(0.001, 1 - 10 ** (-(qual.astype(np.float64) - phred) / 10))


def overlap_weight(mismatches: np.ndarray, overlap: np.ndarray, ratio: float) -> np.ndarray:
    return 1 - np.sqrt(mismatches / np.maximum(1, overlap * ratio))


# --- candidates ----------------------------------------------------------------------------------------


def word_length(longest: int) -> int:
    return 20 if longest < 160 else 32


def _canonical(text: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(smaller of each word and its reverse complement, as numbers; words per row)."""
    n = len(text)
    code = np.append(_INDEX[text].astype(np.uint64) & np.uint64(3), np.zeros(k, np.uint64))
    # Words of 1, 2, 4, ... bases, and what k needs of them.
    forward, reverse, size = np.zeros_like(code), np.zeros_like(code), 0
    f, r, j = code, np.uint64(3) - code, 1
    ahead = lambda x, by: np.append(x[by:], np.zeros(by, np.uint64))
    while j <= k:
        if k & j:
            forward, reverse = forward << np.uint64(2 * j) | ahead(f, size), reverse | ahead(r, size) << np.uint64(2 * size)
            size += j
        if 2 * j <= k:
            f, r = f << np.uint64(2 * j) | ahead(f, j), r | ahead(r, j) << np.uint64(2 * j)
        j *= 2
    forward, reverse = forward[:n], reverse[:n]
    valid = np.arange(n) + k <= np.repeat(offsets[1:], np.diff(offsets))
    return np.minimum(forward, reverse)[valid], np.maximum(0, np.diff(offsets) - k + 1)


_mixed = N.mixed
_MAP_STEP = 0x9E3779B97F4A7C15
#: Letters whose words are mixed at once, so that they stay in the cache.
_CACHED = 1 << 15


def _least_hashes(k: int):
    """Gives for a batch of seq, read_id the ids of reads with words, and their least hash in each of some maps."""
    mask = np.uint64((1 << 2 * k) - 1 if k < 32 else (1 << 64) - 1)

    def run(batch: pa.RecordBatch, maps: range) -> tuple[np.ndarray, np.ndarray]:
        different = batch.column(0).dictionary_encode()  # frequent sequences are hashed once
        text, offsets = flat(different.dictionary)
        counts = np.maximum(0, np.diff(offsets) - k + 1)
        has = np.flatnonzero(counts)
        out = np.empty((len(maps), len(has)), np.uint64)
        done = 0
        while done < len(has):
            # Some reads whose words stay in the cache.
            to = max(done + 1, int(np.searchsorted(offsets[has], offsets[has[done]] + _CACHED)))
            first, last = has[done], has[to - 1] + 1
            own, words_of = _canonical(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], k)
            words_of = words_of[words_of > 0]
            starts = np.cumsum(words_of) - words_of
            x, y = np.empty_like(own), np.empty_like(own)
            for n, m in enumerate(maps):
                np.add(own, np.uint64(m * _MAP_STEP & (1 << 64) - 1), out=x)
                for shift, factor in N._FACTORS:
                    np.right_shift(x, np.uint64(shift), out=y)
                    np.bitwise_xor(x, y, out=x)
                    np.multiply(x, np.uint64(factor), out=x)
                np.right_shift(x, np.uint64(31), out=y)
                np.bitwise_xor(x, y, out=x)
                if k < 32:
                    np.bitwise_and(x, mask, out=x)
                np.minimum.reduceat(x, starts, out=out[n, done:to])
            done = to
        place = np.full(len(counts) + 1, -1)
        place[has] = np.arange(len(has))
        which = place[different.indices.fill_null(len(counts)).to_numpy(zero_copy_only=False)]
        own = np.flatnonzero(which >= 0)
        return batch.column(1).to_numpy(zero_copy_only=False)[own].astype(np.int64), out[:, which[own]]

    return run


def _signatures(k: int, maps: int):
    mask = np.uint64((1 << 2 * k) - 1 if k < 32 else (1 << 64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = flat(batch.column(0))
            words, counts = _canonical(text, offsets, k)
            has = np.flatnonzero(counts)
            if not len(has):
                continue
            starts = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
            ids = batch.column(1).to_numpy(zero_copy_only=False)[has]
            for m in range(maps):
                with np.errstate(over="ignore"):
                    h = np.minimum.reduceat(_mixed(words + np.uint64(m) * np.uint64(0x9E3779B97F4A7C15)) & mask, starts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), m, np.int32)), pa.array(h.view(np.int64))], ["read_id", "map", "hash"])

    return run


def signatures(reads: DataFrame, k: int, maps: int = 48) -> DataFrame:
    """read_id, map, hash: per map the least hash of the read's canonical words; short reads have none."""
    return reads.select("seq", "read_id").mapInArrow(_signatures(k, maps), "read_id bigint, map int, hash bigint")


def bucket_limit(coverage: int) -> int:
    return max(10, int(2.5 * coverage))


def bucket_sizes(sigs: DataFrame) -> DataFrame:
    return sigs.groupBy("map", "hash").agg(F.count(F.lit(1)).alias("n"))


def candidate_links(sigs: DataFrame, coverage: int = 30, broadcast_rows: int = 1_000_000) -> DataFrame:
    """a, b (a < b): reads that share a bucket, each pair once. `sigs` is read twice.

    Buckets of more reads than the limit are emptied before anything is collected: their sizes come from partial
    counts, so a hot bucket never meets in one task.
    """
    large = materialize(bucket_sizes(sigs).filter(F.col("n") > bucket_limit(coverage)).select("map", "hash"))
    kept = sigs.join(broadcast_if_small(large, large.count(), broadcast_rows), ["map", "hash"], "left_anti")
    buckets = kept.groupBy("map", "hash").agg(F.collect_list("read_id").alias("ids")).filter(F.size("ids") > 1)
    firsts = buckets.select("ids", F.explode("ids").alias("a"))
    return firsts.select("a", F.explode("ids").alias("b")).filter("a < b").distinct()


def both_ways(links: DataFrame) -> DataFrame:
    """read_id, candidate: each of a pair is the other's candidate."""
    ends = F.array(F.struct(F.col("a").alias("read_id"), F.col("b").alias("candidate")), F.struct(F.col("b").alias("read_id"), F.col("a").alias("candidate")))
    return links.select(F.inline(ends))


def candidate_pairs(sigs: DataFrame, coverage: int = 30) -> DataFrame:
    return both_ways(candidate_links(written(sigs, "signatures"), coverage))


def paired_flags(pairs: DataFrame) -> DataFrame:
    """Candidates whose mate is a candidate of the anchor's mate (mates are reads 2i and 2i + 1)."""
    mate = lambda c: F.col(c).bitwiseXOR(F.lit(1))
    mates = pairs.select(mate("read_id").alias("read_id"), mate("candidate").alias("candidate"), F.lit(True).alias("p"))
    return pairs.join(mates, ["read_id", "candidate"], "left").select("read_id", "candidate", F.coalesce("p", F.lit(False)).alias("paired"))


# --- alignment -----------------------------------------------------------------------------------------


#: The two bits of a base and a third one that tells that there is one.
_BITS = np.zeros(256, np.uint8)
_BITS[_LETTERS] = np.arange(4) | 4


def _planes(rows: np.ndarray, width: int) -> np.ndarray:
    """Three bit planes of rows of bases (0 past their length), 64 columns a word, words before rows."""
    words = -(-width // 64)
    code = np.zeros((len(rows), words * 64), np.uint8)
    code[:, : rows.shape[1]] = _BITS[rows]
    packed = np.stack([np.packbits(code & bit, axis=1, bitorder="little").view(np.uint64) for bit in (2, 1, 4)])
    return np.ascontiguousarray(packed.transpose(0, 2, 1))


def _shift(planes: np.ndarray) -> None:
    """Drop the first column."""
    carry = planes[:, 1:] << np.uint64(63)
    planes >>= np.uint64(1)
    planes[:, :-1] |= carry


def align(a: np.ndarray, la: np.ndarray, c: np.ndarray, lc: np.ndarray, ratio: float, least: int, least_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best shift of c along a: (valid, shift, overlap, mismatches). The score is mismatches plus bases outside the
    overlap; the first of equal scores wins in the order 0, 1, 2, ..., -1, -2, ... Rows hold A, C, G, T and 0 past their length.

    Columns are compared by 64 as bits, and a shift moves the bits of one side by one place.
    """
    width = max(a.shape[1], c.shape[1])
    return _align_planes(_planes(a, width), la, _planes(c, width), lc, width, ratio, least, least_ratio)


def _align_planes(plane_a: np.ndarray, la: np.ndarray, plane_c: np.ndarray, lc: np.ndarray, width: int, ratio: float, least: int, least_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(la)
    total = la + lc
    need = np.maximum(least, (la * least_ratio).astype(np.int64))
    best, shift = total.copy(), -lc
    over, wrong = np.zeros(n, np.int64), np.zeros(n, np.int64)
    allowed_of = (np.arange(width + 1) * ratio).astype(np.int64)

    def compare(s: int, left: np.ndarray, right: np.ndarray, may: np.ndarray, overlap: np.ndarray) -> None:
        allowed = allowed_of[np.maximum(overlap, 0)]
        may &= (allowed > 0) & (total - 2 * overlap < best)
        if not may.any():
            return
        differ = ((left[0] ^ right[0]) | (left[1] ^ right[1])) & left[2] & right[2]
        miss = np.bitwise_count(differ).sum(axis=0, dtype=np.int64)
        score = miss + total - 2 * overlap
        rows = np.flatnonzero(may & (miss < allowed) & (score < best))
        best[rows], shift[rows], over[rows], wrong[rows] = score[rows], s, overlap[rows], miss[rows]

    compare(0, plane_a, plane_c, np.ones(n, bool), np.minimum(la, lc))
    moved = plane_a.copy()
    for s in range(1, int((la - need).max(initial=0)) + 1):
        _shift(moved)
        compare(s, moved, plane_c, s <= la - need, np.minimum(la - s, lc))
    moved = plane_c.copy()
    for s in range(1, int((lc - need).max(initial=0)) + 1):
        _shift(moved)
        compare(-s, plane_a, moved, s <= lc - need, np.minimum(la, lc - s))
    return shift != -lc, shift, over, wrong


def orient(forward: tuple, reverse: tuple, la: np.ndarray, most: float, least: int, least_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(usable, reverse complement): the smaller share of mismatches, then the longer overlap, then the reverse."""
    need = np.maximum(least, (la * least_ratio).astype(np.int64))
    (v1, _, o1, m1), (v2, _, o2, m2) = forward, reverse
    ok1, ok2 = v1 & (o1 >= need), v2 & (o2 >= need)
    r1, r2 = m1 / np.maximum(1, o1), m2 / np.maximum(1, o2)
    take2 = ok2 & (~ok1 | (r2 < r1) | ((r2 == r1) & (o1 <= o2)))
    ratio = np.where(take2, r2, r1)
    return (ok1 | ok2) & (ratio < most), take2


def reverse_rows(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Reverse complements of rows of bases, 0 past their length."""
    out = K.reverse_complement(rows, length)
    out[np.arange(out.shape[1]) >= length[:, None]] = 0
    return out


_ALIGNED = "read_id bigint, candidate bigint, reverse boolean, shift int, overlap int, mismatches int, kept boolean"


def _word(plane: np.ndarray, s: int) -> np.ndarray:
    """The first word of bits (words before rows) after s columns are dropped."""
    w, r = divmod(s, 64)
    if w >= len(plane):
        return np.zeros(plane.shape[1], np.uint64)
    if not r:
        return plane[w]
    out = plane[w] >> np.uint64(r)
    if w + 1 < len(plane):
        out |= plane[w + 1] << np.uint64(64 - r)
    return out


def _words(planes: np.ndarray, rows: np.ndarray, s: np.ndarray, at: int) -> np.ndarray:
    """A word of some rows of all planes after as many columns are dropped as `s` has for the row. The last word must be empty."""
    w, r = np.divmod(s, 64)
    w, last, r = w + at, planes.shape[1] - 1, r.astype(np.uint64)
    # A shift by 64 in two steps, since one of that many bits isn't defined.
    return planes[:, np.minimum(w, last), rows] >> r | planes[:, np.minimum(w + 1, last), rows] << np.uint64(1) << (np.uint64(63) - r)


def _windows(plane: np.ndarray, most: int) -> np.ndarray:
    """Of each read (bits, words before reads) the first word after 0, 1, ..., most columns are dropped."""
    out = np.empty((most + 1, plane.shape[1]), np.uint64)
    for s in range(most + 1):
        out[s] = _word(plane, s)
    return np.ascontiguousarray(out.T)


#: Masks of the first 0 to 64 columns.
_FIRST = np.append((np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1), ~np.uint64(0))
#: Words that are compared at once, so that they stay in the cache, and words of windows that are held.
_COMPARED, _WINDOWS = 1 << 14, 1 << 24


def _near_shifts(windows: np.ndarray, moved: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], la: np.ndarray, lc: np.ndarray, least: np.ndarray, near: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the side, rows, shifts from `first`) where reads (`moved` in `windows`, of length la) after so many columns are
    dropped may agree with those of a side (first words of reads, places of its reads): one of the two bits of the first 64 columns
    of the overlap, which rejects nearly all shifts, differs in fewer columns than `near` has for the overlap."""
    order = np.argsort((la * (lc.max(initial=0) + 1) + lc) * windows.shape[0] + moved)  # by lengths, then read, whose windows stay in the cache
    ends = np.append(np.flatnonzero(np.diff(la[order], prepend=-1)), len(order))
    for begin, end in zip(ends[:-1], ends[1:]):
        length = int(la[order[begin]])
        s = np.arange(first, length - int(least[order[begin:end]].min()) + 1)
        if not len(s):
            continue
        part = min(max(64, _COMPARED // len(s)), end - begin)
        short = int(np.searchsorted(s, length - 63))
        mask = _FIRST[length - s[short:]]
        cells = len(s) * part
        differs, counts, hits = np.empty(cells, np.uint64), np.empty(cells, np.uint8), np.zeros(-(-cells // 8) * 8, bool)
        for at in range(begin, end, part):
            rows = order[at : min(end, at + part)]
            n = len(rows)
            differ, count, hit = (x[: len(s) * n].reshape(n, len(s)) for x in (differs, counts, hits))
            hits[len(s) * n :] = False
            own = windows.take(moved[rows], axis=0)[:, first : first + len(s)]
            few = near[np.minimum(length - s, lc[rows[-1]])]
            inside = _FIRST[np.minimum(lc[rows], 64)] if lc[rows[0]] < 64 else None
            for side, (word, place) in enumerate(sides):
                np.bitwise_xor(own, word[place[rows], None], out=differ)
                np.bitwise_and(differ[:, short:], mask, out=differ[:, short:])
                if inside is not None:
                    np.bitwise_and(differ, inside[:, None], out=differ)
                np.bitwise_count(differ, out=count)
                np.less(count, few, out=hit)
                found = np.flatnonzero(hits.view(np.uint64))
                if len(found):
                    found = (found[:, None] * 8 + np.arange(8)).ravel()
                    row, shift = np.divmod(found[hits[found]], len(s))
                    yield side, rows[row], shift + first


def _align_both(planes: np.ndarray, turned: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray, width: int, o: Options) -> Iterator[tuple]:
    """Of pairs of reads by their places in bit planes (`turned`: the reverse complements) what `align` and `orient` find with i as
    anchor, then with j: (usable, reverse, shift, overlap, mismatches).

    Shift s of c along a is shift -s of a along c, and if one is turned, s + lc - la; so both sides need the same comparisons
    and differ in the order of equal scores and in the least overlap. Windows of all shifts are made once for each read.
    """
    la, lc = length[i], length[j]
    n, total = len(la), la + lc
    sides = ((la, lc), (lc, la))
    needs = [np.maximum(o.min_overlap, (x * o.min_overlap_ratio).astype(np.int64)) for x, _ in sides]
    least = np.minimum(*needs)
    allowed_of = (np.arange(width + 1) * o.max_mismatch_ratio).astype(np.int64)
    near = np.minimum(allowed_of, 255).astype(np.uint8)
    order = 4 * width
    none = np.iinfo(np.int64).max
    best = np.full((2, 2, n), none)
    left = max(0, int((lc - least).max()))
    hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    windows = _windows(planes[0], max(left, int((la - least).max())))
    for turn, rows, s in _near_shifts(windows, i, [(planes[0, 0], j), (turned[0, 0], j)], la, lc, least, near, 0):
        hits[turn].append((rows, s))
    for turn in (0, 1):
        windows = _windows(turned[0], left) if turn else windows
        for _, rows, s in _near_shifts(windows, j, [(planes[0, 0], i)], lc, la, least, near, 1):
            hits[turn].append((rows, -s))
    del windows

    # What was not rejected, with all columns.
    one, other_way = (np.concatenate([v[:2], np.zeros((2, 1, v.shape[2]), np.uint64)], axis=1) for v in (planes, turned))
    for of, some in enumerate(hits):
        if not some:
            continue
        rows, s = (np.concatenate([x[k] for x in some]) for k in (0, 1))
        x, y = la[rows], lc[rows]
        over = np.where(s >= 0, np.minimum(x - s, y), np.minimum(x, y + s))
        long = over >= least[rows]
        rows, s, over = rows[long], s[long], over[long]
        two = other_way if of else one
        miss = np.zeros(len(rows), np.int64)
        for w in range(-(-int(over.max(initial=0)) // 64)):
            p, q = _words(one, i[rows], np.maximum(s, 0), w), _words(two, j[rows], np.maximum(-s, 0), w)
            miss += np.bitwise_count(((p[0] ^ q[0]) | (p[1] ^ q[1])) & _FIRST[np.clip(over - 64 * w, 0, 64)])
        good = miss < allowed_of[over]
        rows, s, over, miss = rows[good], s[good], over[good], miss[good]
        score = (miss + total[rows] - 2 * over) * order
        for side, other in enumerate((s, s + lc[rows] - la[rows] if of else -s)):
            enough = over >= needs[side][rows]
            np.minimum.at(best[side, of], rows[enough], (score + np.where(other >= 0, other, 2 * width - other))[enough])

    for side, (x, y) in enumerate(sides):
        ways = []
        for turn in (0, 1):
            key = best[side, turn]
            valid = key < none
            score, rank = np.divmod(np.where(valid, key, 0), order)
            s = np.where(rank < 2 * width, rank, 2 * width - rank)
            over = np.where(s >= 0, np.minimum(x - s, y), np.minimum(x, y + s))
            ways.append((valid, s, over, score - total + 2 * over))
        ok, rev = orient(*ways, x, 4 * o.error_factor, o.min_overlap, o.min_overlap_ratio)
        yield ok, rev, *(np.where(rev, ways[1][i], ways[0][i]) for i in (1, 2, 3))


def _align_pairs(reads: N.Reads, left: np.ndarray, right: np.ndarray, o: Options) -> list[np.ndarray]:
    """`_align_both` of pairs of reads by their places: five arrays of a row for each side."""
    out = [np.zeros((2, len(left)), t) for t in (bool, bool, np.int16, np.int16, np.int16)] if not len(reads.length) or reads.length.max() < 1 << 15 else [np.zeros((2, len(left)), t) for t in (bool, bool, np.int64, np.int64, np.int64)]
    size = -(-np.maximum(reads.length[left], reads.length[right]) // 64)
    for words in np.unique(size):
        own = np.flatnonzero(size == words)
        width = 64 * int(words)
        needed = np.zeros(len(reads.length), bool)
        needed[left[own]] = needed[right[own]] = True
        for rows in np.array_split(own, min(len(own), -(-int(needed.sum()) * width // _WINDOWS))):
            used, place = np.unique(np.concatenate([left[rows], right[rows]]), return_inverse=True)
            length = reads.length[used]
            texts = matrix(_LETTERS[reads.text], reads.offsets, used, np.zeros(len(reads.length), np.int64), reads.length, width)
            planes, turned = _planes(texts, width), _planes(reverse_rows(texts, length), width)
            for side, found in enumerate(_align_both(planes, turned, length, place[: len(rows)], place[len(rows) :], width, o)):
                for all_of, values in zip(out, found):
                    all_of[side, rows] = values
    return out


class Part:
    """A part of the anchors with their aligned candidates, ordered by anchor and candidate."""

    def __init__(self, batches: Iterator[pa.RecordBatch], o: Options) -> None:
        got = N.received(batches)
        lists = got.get(N.LIST, [])
        self.reads = N.Reads(got.get(N.READS, []), o.quality_scores)
        own, counts, other = (N.joined(lists, i) for i in range(3))
        paired = N.joined(lists, 3).astype(bool) if o.pair_mode == "PE" else None
        anchor, candidate = np.repeat(self.reads.at(own), counts), self.reads.at(other)
        order = np.argsort(anchor << 32 | candidate)
        anchor, candidate = anchor[order], candidate[order]
        key, pair = np.unique(np.minimum(anchor, candidate) << 32 | np.maximum(anchor, candidate), return_inverse=True)
        side = (anchor > candidate).astype(np.int64)
        ok, *found = (x[side, pair] for x in _align_pairs(self.reads, key >> 32, key & 0xFFFFFFFF, o))
        if o.fixed_reads:
            ok &= self.reads.ids[anchor] < o.fixed_reads
        self.anchor, self.candidate = anchor[ok], candidate[ok]
        self.flipped, self.shift, self.over, self.wrong = (x[ok] for x in found)
        ratio = self.wrong / np.maximum(1, self.over)
        if o.pair_mode == "PE":
            self.kept = paired[order][ok] | (ratio < o.error_factor)
            return
        limit = np.full(len(self.reads.ids), -1.0)
        for times in (4, 3, 2):
            under = np.bincount(self.anchor[ratio < times * o.error_factor], minlength=len(limit))
            limit[under >= o.coverage * o.coverage_factor] = times * o.error_factor
        self.kept = ratio < limit[self.anchor]

    def aligned(self) -> Iterator[pa.RecordBatch]:
        names = ["read_id", "candidate", "reverse", "shift", "overlap", "mismatches", "kept"]
        for at in range(0, len(self.anchor), 1 << 16):
            some = slice(at, at + (1 << 16))
            ids = [pa.array(self.reads.ids[x[some]]) for x in (self.anchor, self.candidate)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(self.flipped[some]), *(pa.array(x[some].astype(np.int32)) for x in (self.shift, self.over, self.wrong)), pa.array(self.kept[some])], names)

    def piles(self, o: Options, rows: int = 2_000) -> Iterator[Piled]:
        """Anchors with what is kept of their candidates, as many at once as make about so many rows."""
        at = np.flatnonzero(self.kept)
        first = np.flatnonzero(np.diff(self.anchor[at], prepend=-1))
        ends = np.append(first, len(at))
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + rows, "right")) - 1)
            yield Piled(self, at[ends[i] : ends[j]], ends[i : j + 1] - ends[i], o)
            i = j


def ready_reads(reads: DataFrame, o: Options) -> DataFrame:
    """Prepared reads, written once, since candidates, alignment and piles all read them; from and to a snapshot by option."""
    spark = reads.sparkSession
    ready = spark.read.parquet(o.load_reads) if o.load_reads else prepared(reads)
    if o.save_reads:
        ready.write.mode("overwrite" if o.overwrite else "errorifexists").parquet(o.save_reads)
        ready = spark.read.parquet(o.save_reads)
    if o.exclude_ambiguous:
        ready = ready.filter(~F.col("ambiguous"))
    return written(ready.select("read_id", "seq", quality_bin("qual", o.quality_bits, o.phred).alias("qual")), "ready")


def stored_signatures(ready: DataFrame, o: Options) -> DataFrame:
    """Signatures of prepared reads, written once; from and to a snapshot by option."""
    spark = ready.sparkSession
    if o.load_signatures:
        return spark.read.parquet(o.load_signatures)
    k = o.kmer_length or word_length(ready.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("m")).first()["m"])
    sigs = signatures(ready, k, o.hashmaps)
    if o.save_signatures:
        sigs.write.mode("overwrite" if o.overwrite else "errorifexists").parquet(o.save_signatures)
        return spark.read.parquet(o.save_signatures)
    return written(sigs, "signatures")


#: Rounds in which maps are gone through: their hashes are the largest that lies on disk.
_ROUNDS = 3


def grouped(ready: DataFrame, o: Options) -> DataFrame:
    """Arrays of anchors with their neighbours and all sequences they need, by part."""
    longest, reads = ready.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)), F.count(F.lit(1))).first()
    parts = N.number_of_parts(ready, reads, o.hashmaps)
    limit = bucket_limit(o.coverage)
    if o.load_signatures or o.save_signatures:
        sigs = stored_signatures(ready, o)
        source = lambda maps: N.stored(sigs, parts, maps)
    else:
        least = _least_hashes(o.kmer_length or word_length(longest))
        source = lambda maps: (ready.select("seq", "read_id"), N._send_hashes(least, maps, parts, limit))
    return N.grouped(ready, parts, limit, source, o.hashmaps, _ROUNDS, o.pair_mode == "PE", o.quality_scores)


def aligned_pairs(ready: DataFrame, o: Options) -> DataFrame:
    """read_id, candidate, reverse, shift, overlap, mismatches of every usable alignment, and `kept`: whether it agrees enough.

    In SE mode the limit adapts to the anchor: the first of 2, 3, 4 times the error rate under which enough candidates lie, or
    none; in PE mode candidates whose mates are candidates of each other stay, of others those under the error rate.
    """
    return grouped(ready, o).mapInArrow(lambda batches: Part(batches, o).aligned(), _ALIGNED)


# --- consensus -----------------------------------------------------------------------------------------


class Columns:
    """Aligned reads as columns: counts and weights of each base, consensus and its support."""

    def __init__(self, rows: list[np.ndarray], shifts: np.ndarray, weights: list[np.ndarray]) -> None:
        ends = np.array([len(r) for r in rows]) + shifts
        low = int(shifts.min())
        self.width = int(ends.max()) - low
        self.begin = -low  # first column of the anchor, which is the first row
        self.end = self.begin + len(rows[0])
        at = np.concatenate([np.arange(len(r)) + s - low for r, s in zip(rows, shifts)])
        base = _INDEX[np.concatenate(rows)]
        key = base * self.width + at
        self.counts = np.bincount(key, minlength=5 * self.width)[: 4 * self.width].reshape(4, self.width)
        # Rounded, so that no sum depends on the order of its parts.
        self.weights = np.bincount(key, weights=np.concatenate(weights), minlength=5 * self.width)[: 4 * self.width].reshape(4, self.width).round(9)
        self.coverage = self.counts.sum(axis=0)
        self.consensus = self.weights.argmax(axis=0)  # ties: A, C, G, T
        total = self.weights.sum(axis=0)
        self.support = np.divide(self.weights.max(axis=0), total, out=np.zeros(self.width), where=total > 0)


_NEAR = 1e-6


def quality_of(columns: Columns, o: Options) -> tuple[bool, bool]:
    """(consensus can be trusted, high quality) by support and coverage over the anchor's columns."""
    support = columns.support[columns.begin : columns.end]
    average, least = support.mean(), support.min()
    cover = columns.coverage[columns.begin : columns.end].min()
    e = o.error_factor
    good = average >= 1 - e - _NEAR and least >= 1 - 3 * e - _NEAR and cover >= o.coverage_factor / 6 * o.coverage - _NEAR
    if not good:
        return False, False
    # The least whole percent of errors that support allows, against half of those that are tolerated.
    percent = np.ceil(100 * (max(1 - average, (1 - least) / 3, 0) - _NEAR))
    return True, percent <= np.ceil(e * 100 - _NEAR) * 0.5 + _NEAR


def other_region(columns: Columns, rows: list[np.ndarray], shifts: np.ndarray, factors: np.ndarray, coverage: int) -> np.ndarray | None:
    """Which candidates lie in another region: they disagree with the anchor in its first column where another base
    than the consensus is frequent. None if the anchor equals the consensus or no column is such."""
    anchor = _INDEX[rows[0]]
    if (anchor == columns.consensus[columns.begin : columns.end]).all():
        return None
    counts = columns.counts[:, columns.begin : columns.end].copy()
    counts[columns.consensus[columns.begin : columns.end], np.arange(counts.shape[1])] = -1
    frequent = counts >= int(coverage * 0.3)
    hit = np.flatnonzero(frequent.any(axis=0))
    if not len(hit):
        return None
    col = int(hit[0])
    found = int(np.flatnonzero(frequent[:, col])[-1])
    bases = np.array([_INDEX[r[col - s]] if 0 <= col - s < len(r) else -1 for r, s in zip(rows[1:], shifts[1:])])
    wanted = bases == found if anchor[col] == found else bases != found
    gone = (bases >= 0) & ~wanted
    return np.zeros_like(gone) if (gone & (factors >= 0.90)).any() else gone


def selected_columns(rows: list[np.ndarray], shifts: np.ndarray, factors: np.ndarray, quals: list[np.ndarray] | None, o: Options) -> tuple[np.ndarray, Columns]:
    """(kept candidates, columns) after taking out candidates of another region; rows[0] is the anchor at shift 0."""
    keep = np.arange(len(rows) - 1)

    def build() -> Columns:
        use = [0, *(keep + 1)]
        scale = [1.0, *factors[keep]]
        weights = [f * (quality_weight(quals[i], o.phred) if quals else np.ones(len(rows[i]))) for i, f in zip(use, scale)]
        return Columns([rows[i] for i in use], np.array([0, *shifts[keep]]), weights)

    columns = build()
    for _ in range(5):
        gone = other_region(columns, [rows[0], *(rows[i + 1] for i in keep)], np.array([0, *shifts[keep]]), factors[keep], o.coverage)
        if gone is None or not gone.any():
            break
        keep = keep[~gone]
        columns = build()
    return keep, columns


def correct_anchor(rows: list[np.ndarray], shifts: np.ndarray, factors: np.ndarray, quals: list[np.ndarray] | None, o: Options, forest: Forest | None = None) -> tuple[np.ndarray, bool, np.ndarray, Columns]:
    """(corrected anchor, high quality, kept candidates, columns)."""
    keep, columns = selected_columns(rows, shifts, factors, quals, o)
    anchor = rows[0]
    if not len(keep):
        return anchor, False, keep, columns
    part = slice(columns.begin, columns.end)
    trusted, high = quality_of(columns, o)
    consensus = _LETTERS[columns.consensus[part]]
    if o.correction_type == 1 and forest is not None:
        return (consensus if high else forest.decide(consensus, anchor, anchor_features(columns, anchor, o))), high, keep, columns
    if trusted:
        return consensus, high, keep, columns
    own = columns.counts[_INDEX[anchor], np.arange(columns.begin, columns.end)]
    return np.where((columns.support[part] > 0.90) & (own <= 2), consensus, anchor), False, keep, columns


def _column_features(columns: Columns, row: np.ndarray, begin: int, o: Options) -> list[np.ndarray]:
    part = np.arange(begin, begin + len(row))
    base, top = _INDEX[row], columns.consensus[part]
    cover, weight = columns.coverage[part], columns.weights[:, part].sum(axis=0)
    own_n, own_w = columns.counts[base, part], columns.weights[base, part]
    top_n, top_w = columns.counts[top, part], columns.weights[top, part]
    support = columns.support[part]
    whole = lambda x: np.full(len(row), x)
    return [
        own_n / cover, own_w / weight, own_w / np.maximum(1, own_n), top_n / cover, support, top_w / np.maximum(1, top_n), weight / cover, cover / o.coverage, weight / o.coverage,
        whole(support.mean()), whole(support.min()), whole(cover.max() / o.coverage), whole(cover.min() / o.coverage),
    ]


def anchor_features(columns: Columns, anchor: np.ndarray, o: Options) -> np.ndarray:
    """13 features of every position: share, weight and mean weight of its own base and of the consensus, weight and
    coverage of the column, support and coverage of the whole anchor."""
    return np.stack(_column_features(columns, anchor, columns.begin, o), axis=1)


def candidate_features(columns: Columns, row: np.ndarray, begin: int, o: Options) -> np.ndarray:
    """The same over the candidate's columns, and how far it and the anchor cover each other."""
    end = begin + len(row)
    both = (min(columns.end, end) - max(columns.begin, begin)) / (max(columns.end, end) - min(columns.begin, begin))
    return np.stack([*_column_features(columns, row, begin, o), np.full(len(row), both)], axis=1)


class Piled:
    """Some anchors of a part with the candidates that agree with them, aligned."""

    def __init__(self, part: Part, at: np.ndarray, starts: np.ndarray, o: Options) -> None:
        self.o, self.reads, self.starts = o, part.reads, starts
        self.anchor, self.candidate = part.anchor[at[starts[:-1]]], part.candidate[at]
        self.ids, self.candidates = self.reads.ids[self.anchor].tolist(), self.reads.ids[self.candidate].tolist()
        self.length = self.reads.length[self.candidate]
        self.flipped, self.shift, self.over, self.wrong = part.flipped[at], *(x[at].astype(np.int64) for x in (part.shift, part.over, part.wrong))

    def kept(self, i: int) -> np.ndarray:
        return np.arange(self.starts[i], self.starts[i + 1])

    def pile(self, i: int, own: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray] | None, np.ndarray]:
        """(sequences, qualities if they count, weight factors) of anchor i and its candidates in its direction."""
        r = self.reads
        of = lambda x, c: x[r.offsets[c] : r.offsets[c + 1]]
        all_of = [(self.anchor[i], False), *zip(self.candidate[own], self.flipped[own])]
        rows = [_LETTERS[3 - of(r.text, c)[::-1] if turn else of(r.text, c)] for c, turn in all_of]
        factors = overlap_weight(self.wrong[own], self.over[own], self.o.max_mismatch_ratio)
        quals = [of(r.quals, c)[::-1] if turn else of(r.quals, c) for c, turn in all_of] if self.o.quality_scores else None
        return rows, quals, factors


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each row the numbers from its first on, one row after the other."""
    ends = np.cumsum(length)
    out = np.repeat(first - (ends - length), length)
    out += np.arange(len(out))
    return out


class Stacked:
    """`Columns` of all anchors of some piles after candidates of other regions are taken out, one beside the other."""

    def __init__(self, p: Piled, o: Options) -> None:
        self.p, self.o = p, o
        r, n = p.reads, len(p.anchor)
        self.keep = np.ones(len(p.candidate), bool)
        self.factors = overlap_weight(p.wrong, p.over, o.max_mismatch_ratio)
        self.owner = np.repeat(np.arange(n), np.diff(p.starts))
        # Rows: each anchor before its candidates.
        place = np.concatenate([p.starts[:-1] + np.arange(n), np.arange(len(p.candidate)) + self.owner + 1])
        sorted_by = np.empty_like(place)
        sorted_by[place] = np.arange(len(place))
        join = lambda a, c: np.concatenate([a, c])[sorted_by]
        self.row_owner = join(np.arange(n), self.owner)
        self.row_candidate = join(np.full(n, -1), np.arange(len(p.candidate)))
        read, turn = join(p.anchor, p.candidate), join(np.zeros(n, bool), p.flipped)
        self.row_shift, self.row_factor = join(np.zeros(n, np.int64), p.shift), join(np.ones(n), self.factors)
        self.row_length = r.length[read]
        self.row_starts = np.concatenate([[0], np.cumsum(self.row_length)])
        # Letters of all rows in the anchor's direction.
        text, quals = r.both_ways
        at = _runs(np.where(turn, len(text) - r.offsets[read + 1], r.offsets[read]), self.row_length)
        self.base = text[at]
        self.weight = quality_weight(quals[at], o.phred) if o.quality_scores else None
        self.anchor_rows = p.starts[:-1] + np.arange(n)
        self.anchor_length = r.length[p.anchor]
        self._build(np.arange(n))
        todo = np.arange(n)
        for _ in range(5):
            todo = todo[self._other_regions(todo)]
            if not len(todo):
                break
            self._build(todo)

    def _build(self, owners: np.ndarray) -> None:
        """Columns of some anchors; those of the others stay."""
        n = len(self.p.anchor)
        use = np.zeros(n, bool)
        use[owners] = True
        rows = np.flatnonzero(use[self.row_owner] & ((self.row_candidate < 0) | self.keep[self.row_candidate]))
        owner, shift, length = self.row_owner[rows], self.row_shift[rows], self.row_length[rows]
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.minimum.at(low, owner, shift)
        np.maximum.at(high, owner, shift + length)
        width = np.where(use, high - low, 0)
        starts = np.concatenate([[0], np.cumsum(width)])
        total = int(starts[-1])
        cells = _runs(self.row_starts[rows], length) if len(rows) < len(self.row_owner) else slice(None)
        key = _runs(starts[owner] - low[owner] + shift, length)
        key += np.multiply(self.base[cells], total, dtype=np.int64)
        weights = np.repeat(self.row_factor[rows], length)
        if self.weight is not None:
            weights *= self.weight[cells]
        counts = np.bincount(key, minlength=4 * total).reshape(4, total)
        weights = np.bincount(key, weights=weights, minlength=4 * total).reshape(4, total).round(9)
        if not use.all():
            # Put the new columns in the place of the old ones.
            source = np.where(np.repeat(use, np.where(use, width, self.width)), 1, 0).astype(bool)
            merged = np.where(use, width, self.width)
            old = N._rows(self.starts, np.flatnonzero(~use))
            both = []
            for was, new in ((self.counts, counts), (self.weights, weights)):
                out = np.empty((4, len(source)), was.dtype)
                out[:, source], out[:, ~source] = new, was[:, old]
                both.append(out)
            counts, weights = both
            low = np.where(use, low, -self.begin)
            width = merged
            starts = np.concatenate([[0], np.cumsum(width)])
        self.begin, self.width, self.starts, self.counts, self.weights = -low, width, starts, counts, weights
        self.consensus = weights.argmax(axis=0)
        sums = weights.sum(axis=0)
        self.support = np.divide(weights.max(axis=0), sums, out=np.zeros(len(sums)), where=sums > 0)
        self.coverage = counts.sum(axis=0)

    def _own(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns under some anchors, the anchors' bases, where each anchor starts)."""
        n = self.anchor_length[owners]
        starts = np.cumsum(n) - n
        nth = np.arange(n.sum()) - np.repeat(starts, n)
        return np.repeat(self.starts[owners] + self.begin[owners], n) + nth, self.base[np.repeat(self.row_starts[self.anchor_rows[owners]], n) + nth], starts

    def _other_regions(self, owners: np.ndarray) -> np.ndarray:
        """Take out candidates of other regions as `other_region` tells; of which of the anchors there were some."""
        columns, base, starts = self._own(owners)
        top = self.consensus[columns]
        counts = self.counts[:, columns]
        counts[top, np.arange(len(top))] = -1
        frequent = counts >= int(self.o.coverage * 0.3)
        differs = np.logical_or.reduceat(base != top, starts)
        some = np.flatnonzero(frequent.any(axis=0))
        of = np.searchsorted(starts, some, "right") - 1
        first = np.flatnonzero(np.diff(of, prepend=-1))
        hit, who = some[first], of[first]
        hit, who = hit[differs[who]], who[differs[who]]
        found = 3 - frequent[::-1, hit].argmax(axis=0)
        n = len(self.p.anchor)
        column, wanted, same = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
        column[owners[who]], wanted[owners[who]], same[owners[who]] = hit - starts[who], found, base[hit] == found
        rows = np.flatnonzero((self.row_candidate >= 0) & (column[self.row_owner] >= 0))
        rows = rows[self.keep[self.row_candidate[rows]]]
        place = column[self.row_owner[rows]] - self.row_shift[rows]
        inside = (place >= 0) & (place < self.row_length[rows])
        rows, place = rows[inside], place[inside]
        owner = self.row_owner[rows]
        gone = (self.base[self.row_starts[rows] + place] == wanted[owner]) != same[owner]
        rows, owner = rows[gone], owner[gone]
        stays = np.zeros(n, bool)
        stays[owner[self.row_factor[rows] >= 0.90]] = True
        rows = rows[~stays[owner]]
        self.keep[self.row_candidate[rows]] = False
        changed = np.zeros(n, bool)
        changed[self.row_owner[rows]] = True
        return changed[owners]

    def numbers(self) -> np.ndarray:
        """Kept candidates of each anchor."""
        return np.bincount(self.owner[self.keep], minlength=len(self.p.anchor))

    def quality(self) -> tuple[np.ndarray, np.ndarray]:
        """`quality_of` of all anchors."""
        o = self.o
        columns, _, starts = self._own(np.arange(len(self.p.anchor)))
        support = self.support[columns]
        average, least = np.add.reduceat(support, starts) / self.anchor_length, np.minimum.reduceat(support, starts)
        cover = np.minimum.reduceat(self.coverage[columns], starts)
        e = o.error_factor
        good = (average >= 1 - e - _NEAR) & (least >= 1 - 3 * e - _NEAR) & (cover >= o.coverage_factor / 6 * o.coverage - _NEAR)
        percent = np.ceil(100 * (np.maximum(np.maximum(1 - average, (1 - least) / 3), 0) - _NEAR))
        return good, good & (percent <= np.ceil(e * 100 - _NEAR) * 0.5 + _NEAR)


def _corrected(p: Piled, o: Options) -> pa.RecordBatch:
    """`correct_anchor` and the corrected candidates of all anchors at once, without forests."""
    x = Stacked(p, o)
    n = len(p.anchor)
    has = x.numbers() > 0
    trusted, high = x.quality()
    high &= has
    columns, base, _ = x._own(np.arange(n))
    each = np.repeat(np.arange(n), x.anchor_length)
    top, own = x.consensus[columns], x.counts[base, columns]
    take = has[each] & (trusted[each] | (x.support[columns] > 0.90) & (own <= 2))
    letters = [_LETTERS[np.where(take, top, base)]]
    ids, hq, shift, lengths = [p.reads.ids[p.anchor]], [high], [np.zeros(n, np.int64)], [x.anchor_length]
    if o.correct_candidates:
        begin = x.begin[x.owner] + p.shift
        near = np.flatnonzero(x.keep & high[x.owner] & (np.abs(p.shift) <= o.candidate_columns) & (begin + p.length <= x.begin[x.owner] + x.anchor_length[x.owner] + o.candidate_columns))
        length, turn = p.length[near], p.flipped[near]
        first = x.starts[x.owner[near]] + begin[near]
        nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(np.where(turn, first + length - 1, first), length) + np.repeat(np.where(turn, -1, 1), length) * nth
        letters.append(_LETTERS[np.where(np.repeat(turn, length), 3 - x.consensus[at], x.consensus[at])])
        for out, more in zip((ids, hq, shift, lengths), (p.reads.ids[p.candidate[near]], np.zeros(len(near), bool), p.shift[near], length)):
            out.append(more)
    ids, hq, shift, lengths = (np.concatenate(v) for v in (ids, hq, shift, lengths))
    kind = pa.DictionaryArray.from_arrays(pa.array((np.arange(len(ids)) >= n).astype(np.int8)), pa.array(["anchor", "candidate"])).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids), kind, pa.array(hq), pa.array(shift.astype(np.int32)), to_strings(np.concatenate(letters), np.concatenate([[0], np.cumsum(lengths)]))], ["read_id", "kind", "hq", "shift", "seq"])


def _correct_with(o: Options, forests: tuple[Forest | None, Forest | None]):
    def run(piles: Iterator[Piled]) -> Iterator[pa.RecordBatch]:
        for p in piles:
            out: dict[str, list] = {k: [] for k in ("read_id", "kind", "hq", "shift", "seq")}

            def add(*values, out=out) -> None:
                for k, v in zip(out, values):
                    out[k].append(v)

            for i in range(len(p.ids)):
                own = p.kept(i)
                if not len(own):
                    continue
                rows, quals, factors = p.pile(i, own)
                seq, high, keep, columns = correct_anchor(rows, p.shift[own], factors, quals, o, forests[0])
                add(p.ids[i], "anchor", high, 0, seq.tobytes().decode())
                if not (high and o.correct_candidates):
                    continue
                for j in keep:
                    c = own[j]
                    begin = columns.begin + p.shift[c]
                    end = begin + p.length[c]
                    if abs(p.shift[c]) <= o.candidate_columns and end <= columns.end + o.candidate_columns:
                        text = _LETTERS[columns.consensus[begin:end]]
                        if o.correction_type_candidates == 1 and forests[1] is not None:
                            text = forests[1].decide(text, rows[j + 1], candidate_features(columns, rows[j + 1], begin, o))
                        text = K._COMPLEMENT[text[::-1]] if p.flipped[c] else text
                        add(p.candidates[c], "candidate", False, int(p.shift[c]), text.tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(out["read_id"], pa.int64()), pa.array(out["kind"], pa.string()), pa.array(out["hq"], pa.bool_()), pa.array(out["shift"], pa.int32()), pa.array(out["seq"], pa.string())], list(out))

    return run


def _correct(o: Options, forests: tuple[Forest | None, Forest | None]):
    if any(f is not None for f in forests):
        return _correct_with(o, forests)
    return lambda piles: (_corrected(p, o) for p in piles)


def _joined_numbers(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Whole numbers of each row as text with commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x).cast(pa.string())), ",")


def _consensus(o: Options, as_text: bool = False):
    """Support and coverage as lists, or as text: whole millionths and numbers with commas."""

    def run(piles: Iterator[Piled]) -> Iterator[pa.RecordBatch]:
        for p in piles:
            x = Stacked(p, o)
            support = x.support.round(9)
            text = to_strings(_LETTERS[x.consensus], x.starts)
            if as_text:
                micro = support * 1_000_000
                low = np.floor(micro)
                lists = [_joined_numbers(low.astype(np.int64) + (micro - low >= 0.5), x.starts), _joined_numbers(x.coverage, x.starts)]
            else:
                starts = pa.array(x.starts, pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(support)), pa.ListArray.from_arrays(starts, pa.array(x.coverage.astype(np.int32)))]
            trusted, high = x.quality()
            names = ["read_id", "reads", "begin", "consensus", "support", "coverage", "trusted", "hq"]
            yield pa.RecordBatch.from_arrays([pa.array(p.reads.ids[p.anchor]), pa.array(x.numbers().astype(np.int32)), pa.array((-x.begin).astype(np.int32)), text, *lists, pa.array(trusted), pa.array(high)], names)

    return run


def _features(o: Options):
    def run(piles: Iterator[Piled]) -> Iterator[pa.RecordBatch]:
        for p in piles:
            out: dict[str, list] = {k: [] for k in ("read_id", "kind", "pos", "consensus", "features")}
            for i in range(len(p.ids)):
                own = p.kept(i)
                if not len(own):
                    continue
                rows, quals, factors = p.pile(i, own)
                keep, columns = selected_columns(rows, p.shift[own], factors, quals, o)
                found = []
                if not quality_of(columns, o)[1]:
                    found.append((p.ids[i], "anchor", rows[0], columns.begin, False, anchor_features(columns, rows[0], o)))
                for j in keep:
                    begin = columns.begin + p.shift[own[j]]
                    if begin >= columns.begin - o.candidate_columns and begin + p.length[own[j]] <= columns.end + o.candidate_columns:
                        found.append((p.candidates[own[j]], "candidate", rows[j + 1], begin, bool(p.flipped[own[j]]), candidate_features(columns, rows[j + 1], begin, o)))
                for read, kind, row, begin, flipped, values in found:
                    consensus = columns.consensus[begin : begin + len(row)]
                    for pos in np.flatnonzero(_INDEX[row] != consensus):
                        for k, v in zip(out, (read, kind, int(-pos - 1 if flipped else pos), chr(_LETTERS[consensus[pos]]), values[pos].tolist())):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["read_id"], pa.int64()), pa.array(out["kind"], pa.string()), pa.array(out["pos"], pa.int32()), pa.array(out["consensus"], pa.string()), pa.array(out["features"], pa.list_(pa.float64()))], list(out))

    return run


#: Share of a column that each of two bases holds where reads of two regions meet, and the most such columns of a pile.
_HALF, _MOST_SPLIT_COLUMNS = (0.4, 0.6), 16


def split_patterns(columns: Columns, rows: list[np.ndarray], shifts: np.ndarray) -> tuple[list[tuple[int, str, str]], dict[tuple, list[int]]]:
    """(split columns as (column, base, base), pattern -> candidates). A candidate's pattern tells for each split column which of
    its two bases it has, None if neither. Patterns that another one completes are joined to it, so only complete
    ones remain, each with all candidates that don't contradict it."""
    share = columns.counts / np.maximum(1, columns.coverage)
    near_half = (columns.counts >= 2) & (share >= _HALF[0] - _NEAR) & (share <= _HALF[1] + _NEAR)
    at = np.flatnonzero(near_half.sum(axis=0) == 2)
    if not 0 < len(at) <= _MOST_SPLIT_COLUMNS:
        return [], {}
    bases = [tuple(_LETTERS[np.flatnonzero(near_half[:, c])].tolist()) for c in at]
    own: dict[tuple, list[int]] = {}
    for i, (row, shift) in enumerate(zip(rows, shifts)):
        place = at - columns.begin - shift
        pattern = tuple(b.index(row[p]) if 0 <= p < len(row) and row[p] in b else None for p, b in zip(place, bases))
        own.setdefault(pattern, []).append(i)
    completes = lambda q, p: q != p and all(x is None or x == y for x, y in zip(p, q))
    final = [p for p in own if not any(completes(q, p) for q in own)]
    return [(int(c) - columns.begin, chr(b[0]), chr(b[1])) for c, b in zip(at, bases)], {q: sorted(i for p, members in own.items() if p == q or completes(q, p) for i in members) for q in final}


def _splits(o: Options):
    def run(piles: Iterator[Piled]) -> Iterator[pa.RecordBatch]:
        for p in piles:
            out: list[tuple] = []
            for i in range(len(p.ids)):
                own = p.kept(i)
                rows, quals, factors = p.pile(i, own)
                weights = [f * (quality_weight(quals[j], o.phred) if quals else np.ones(len(r))) for j, (r, f) in enumerate(zip(rows, [1.0, *factors]))]
                columns = Columns(rows, np.array([0, *p.shift[own]]), weights)
                at, groups = split_patterns(columns, rows[1:], p.shift[own])
                for pattern, members in groups.items():
                    shown = [f"{c}{two[x]}" for (c, *two), x in zip(at, pattern) if x is not None]
                    out.append((p.ids[i], ",".join(shown), [p.candidates[own[m]] for m in members]))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["read_id", "pattern", "candidates"])

    return run


def region_splits(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """read_id, pattern, candidates: groups of an anchor's candidates by what they show in columns of which two bases hold about
    half each. The pattern lists column (0 is the anchor's first base) and base. Piles without such columns, or with more than 16,
    have no groups."""
    return piled(reads, options, _splits(options), "read_id bigint, pattern string, candidates array<bigint>")


def piled(reads: DataFrame, o: Options, use: Callable[[Iterator[Piled]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `use` makes of every anchor that has kept candidates; at most hashmaps * bucket_limit of them."""
    return grouped(ready_reads(reads, o), o).mapInArrow(lambda batches: use(Part(batches, o).piles(o)), schema)


def corrections(reads: DataFrame, options: Options = Options(), anchor_forest: Forest | None = None, candidate_forest: Forest | None = None) -> DataFrame:
    """read_id, kind (anchor, candidate), hq, shift, seq of every correction found.

    Needs read_id, seq, qual (each read once). Ambiguous reads can be left out by an option. Without candidates a read
    has no correction; an empty table gives none. With a forest and correction type 1, positions of anchors that are
    not of high quality take the consensus where the forest says so.
    """
    return piled(reads, options, _correct(options, (anchor_forest, candidate_forest)), "read_id bigint, kind string, hq boolean, shift int, seq string")


def alignments(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """read_id, candidate, reverse, shift, overlap, mismatches of aligned candidates, and which agree enough to be kept."""
    return aligned_pairs(ready_reads(reads, options), options)


def consensus_columns(reads: DataFrame, options: Options = Options(), as_text: bool = False) -> DataFrame:
    """Per anchor with kept candidates: how many, first column (0 is the anchor's first base), consensus, support and coverage
    of every column, and whether the consensus can be trusted and is of high quality. As text, support is in whole millionths."""
    kinds = ("string", "string") if as_text else ("array<double>", "array<int>")
    return piled(reads, options, _consensus(options, as_text), f"read_id bigint, reads int, begin int, consensus string, support {kinds[0]}, coverage {kinds[1]}, trusted boolean, hq boolean")


def correction_features(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """Correction type 2: read_id, kind, pos, consensus, features of every position that differs from the consensus, in
    anchors that are not of high quality and in candidates near an anchor; to train a forest with. Reverse candidates
    have positions -pos - 1."""
    return piled(reads, options, _features(options), "read_id bigint, kind string, pos int, consensus string, features array<double>")


def combined(found: DataFrame) -> DataFrame:
    """read_id, seq, label: an anchor of high quality is applied (3); of three or more results all must agree (2); of
    fewer the anchor's is applied (1); without an anchor's nothing is."""
    by = found.groupBy("read_id").agg(
        F.max(F.when(F.col("kind") == "anchor", F.struct("hq", "seq"))).alias("a"),
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("least"),
        F.max("seq").alias("most"),
    )
    high = F.col("a.hq")
    label = F.when(F.col("a").isNull(), 0).when(high, 3).when(F.col("n") >= 3, F.when(F.col("least") == F.col("most"), 2).otherwise(0)).otherwise(1)
    return by.select("read_id", F.col("a.seq").alias("corrected"), label.alias("label")).filter("label > 0")


def corrected_reads(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """The reads with corrections applied; labels go to the name by an option. Quality strings stay."""
    once = combined(corrections(reads, options))
    out = reads.join(once, "read_id", "left").withColumn("seq", F.coalesce("corrected", "seq"))
    if options.quality_labels and "name" in reads.columns:
        out = out.withColumn("name", F.concat("name", F.lit(LABEL), F.coalesce("label", F.lit(0)).cast("string")))
    return out.select(*reads.columns)


def changed(found: DataFrame, reads: DataFrame) -> int:
    """Stored corrections: all but those of high quality that change nothing."""
    both = found.filter("kind = 'anchor'").join(reads.select("read_id", F.upper("seq").alias("before")), "read_id")
    return both.filter(~(F.col("hq") & (F.col("seq") == F.col("before")))).count()
