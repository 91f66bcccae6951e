"""Vectorised kernels over blocks of reads. Positions count from 0; results are lengths or positions per row.

Each replaces a scan along every read by operations over whole columns of a block: cumulative sums find the
first window or position that stops the scan.
"""

from __future__ import annotations

import numpy as np

A, C, G, T, N = b"ACGTN"
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGTacgt", b"TGCATGCA"):
    _COMPLEMENT[_a] = _b


def first_true(hit: np.ndarray, default: np.ndarray | int) -> np.ndarray:
    """Column of the first True in each row, else the default."""
    if hit.shape[1] == 0:
        return np.broadcast_to(np.asarray(default), hit.shape[:1]).astype(np.int64).copy()
    at = hit.argmax(axis=1)
    return np.where(hit[np.arange(len(at)), at], at, default)


def skip_while(flag: np.ndarray, start: np.ndarray, step: int) -> np.ndarray:
    """From `start` go on by `step` (1 or -1) while the flag holds; ends at the width or at -1."""
    n, width = flag.shape
    at = np.arange(width)
    if step > 0:
        return first_true(~flag & (at >= start[:, None]), width) if width else start
    back = first_true((~flag & (at <= start[:, None]))[:, ::-1], width)
    return width - 1 - back


def trim_ends(bases: np.ndarray, quals: np.ndarray, length: np.ndarray, front: int, tail: int, cut5: bool, cut3: bool, window: int = 4, quality: int = 20, phred: int = 33) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed and quality trimming: (ok, first base kept, bases kept)."""
    n, width = bases.shape
    at = np.arange(width)
    ok = length - front - tail > 0
    begin = np.full(n, front, np.int64)
    kept = length - front - tail
    if cut5 or cut3:
        sums = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(quals, axis=1, dtype=np.int64)], axis=1)
        # good[i, s]: the window that starts at s has the mean; windows beyond the matrix have not
        good = np.zeros((n, width), bool)
        if width >= window:
            good[:, : width - window + 1] = sums[:, window:] - sums[:, :-window] >= window * (phred + quality)
        is_n = bases == N
    if cut5:
        ok &= length - front - tail - window > 0
        last = length - tail - window  # where the scan ends without a good window
        seen = good & (at >= front) & (at < last[:, None])
        s = first_true(seen, np.maximum(last, 0))
        s = np.where(s > 0, s + window - 1, s)
        # the bases after the read count as no N
        inside = is_n & (at < length[:, None])
        s = np.where(s < width, np.minimum(skip_while(inside, np.minimum(s, width), 1), np.maximum(s, length)), s)
        begin = np.where(ok, s, begin)
        kept = length - begin - tail
    if cut3:
        ok &= length - begin - tail - window > 0
        end = length - tail - 1
        # a window that ends at t starts at t - window + 1
        ends = np.zeros((n, width), bool)
        ends[:, window - 1 :] = good[:, : max(0, width - window + 1)]
        seen = ends & (at <= end[:, None]) & (at - window >= begin[:, None])
        back = first_true(seen[:, ::-1], -1)
        t = np.where(back >= 0, width - 1 - back, begin + window - 1)
        t = np.where(t < length - 1, t - window + 1, t)
        t = skip_while(is_n, np.clip(t, -1, width - 1), -1)
        kept = np.where(ok, t - begin + 1, kept)
    ok &= (kept > 0) & (begin < length - 1)
    return ok, begin, kept


def from_end(bases: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each row read from its last base backwards, padded with 0."""
    place = length[:, None] - 1 - np.arange(bases.shape[1])
    return np.where(place >= 0, np.take_along_axis(bases, np.maximum(place, 0), axis=1), 0)


def trim_poly_g(bases: np.ndarray, length: np.ndarray, least: int = 10, each: int = 8, most: int = 5) -> np.ndarray:
    """New length: a tail of G with few other bases is cut at the first G of it."""
    back = from_end(bases, length)
    i = np.arange(back.shape[1])
    g = back == G
    wrong = np.cumsum(~g, axis=1)
    stop = ((wrong > most) | ((wrong > (i + 1) // each) & (i >= least - 1))) & (i < length[:, None])
    end = first_true(stop, length)
    # first G: the furthest one up to and including the base at which the scan stopped
    reach = np.where(g & (i <= end[:, None]), i, -1).max(axis=1, initial=-1)
    first = np.where(reach >= 0, length - 1 - reach, length - 1)
    return np.where(end >= least, first, length)


def trim_poly_x(bases: np.ndarray, length: np.ndarray, least: int = 10, each: int = 8, most: int = 5) -> np.ndarray:
    """New length: a tail of one base with few others is cut; reads that are such a tail throughout are left."""
    back = from_end(bases, length)
    n, width = back.shape
    i = np.arange(width)
    letters = (A, T, C, G)  # ties go to the earlier
    counts = [np.cumsum((back == b) | (back == N), axis=1) for b in letters]
    allowed = np.minimum(most, (i + 1) // each)
    stop = np.ones((n, width), bool)
    for c in counts:
        stop &= (i + 1) - c > allowed
    stop &= ((i >= each) | (i + 1 >= least - 1)) & (i < length[:, None])
    p = first_true(stop, length)
    has = (p + 1 >= least) & (p < length)
    at_p = np.minimum(p, max(0, width - 1))
    totals = np.stack([c[np.arange(n), at_p] if width else np.zeros(n, int) for c in counts], axis=1)
    best = np.asarray(letters, np.uint8)[totals.argmax(axis=1)]
    reach = np.where((back == best[:, None]) & (i <= p[:, None]), i, -1).max(axis=1, initial=-1)
    return np.where(has, length - 1 - reach, length)


def find_adapter(bases: np.ndarray, length: np.ndarray, adapter: np.ndarray, match: int = 4, each: int = 8) -> np.ndarray:
    """First position of the adapter with at most an eighth of mismatches, from -4 on; -1000 if there is none.

    Columns past a row's length must be 0.
    """
    n, width = bases.shape
    size = len(adapter)
    none = np.full(n, -1000, np.int64)
    if size < match or n == 0:
        return none
    lead = 4 if size >= 16 else 3 if size >= 12 else 2 if size >= 8 else 0
    places = lead + max(0, width - match)
    padded = np.zeros((n, lead + width + size), np.uint8)
    padded[:, lead : lead + width] = bases
    padded[:, :lead] = 1  # differs from every letter
    wrong = np.zeros((n, places), np.uint8 if size < 255 else np.uint16)
    for i in range(size):
        wrong += padded[:, i : i + places] != adapter[i]
    pos = np.arange(places) - lead
    compared = np.minimum(length[:, None] - pos, size)
    # outside the read everything differs and isn't counted
    extra = (size - compared) + np.maximum(0, -pos)
    ok = (wrong - extra <= compared // each) & (pos < (length - match)[:, None])
    at = first_true(ok, -1000 + lead)
    return at - lead


def cut_adapter(bases: np.ndarray, length: np.ndarray, adapter: np.ndarray, match: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new length, position or -1000, bases removed as counted); bases past the new length are set to 0 in place."""
    pos = find_adapter(bases, length, adapter, match)
    found = pos > -1000
    new = np.where(found, np.maximum(pos, 0), length)
    removed = np.where(found, np.where(pos < 0, len(adapter) + pos, length - pos), 0)
    if found.any():
        rows = np.flatnonzero(found)
        cut = bases[rows]
        cut[np.arange(bases.shape[1]) >= new[rows][:, None]] = 0
        bases[rows] = cut
    return new, pos, removed


def reverse_complement(bases: np.ndarray, length: np.ndarray) -> np.ndarray:
    return _COMPLEMENT[from_end(bases, length)]


def _first_overlap(left: np.ndarray, left_len: np.ndarray, right: np.ndarray, right_len: np.ndarray, differ: int, require: int, compare: int) -> tuple[np.ndarray, np.ndarray]:
    """First shift o of the right row along the left one with at most `differ` mismatches among the first `compare`
    bases of the overlap, for o below left_len - require: (shift or -1, mismatches)."""
    n, width = left.shape
    shifts = max(0, width - require)
    if not shifts or n == 0:
        return np.full(n, -1, np.int64), np.zeros(n, np.int64)
    a = np.zeros((n, width + compare), np.uint8)
    a[:, :width] = left
    b = np.ones((n, compare), np.uint8)  # 1 and 0 differ from each other and all letters
    w = min(compare, right.shape[1])
    b[:, :w] = np.where(np.arange(w) < right_len[:, None], right[:, :w], 1)
    wrong = np.zeros((n, shifts), np.uint8)
    for i in range(compare):
        wrong += a[:, i : i + shifts] != b[:, i : i + 1]
    o = np.arange(shifts)
    used = np.minimum(compare, np.minimum(left_len[:, None] - o, right_len[:, None]))
    wrong = wrong.astype(np.int64) - (compare - used)
    # a mate without bases overlaps nothing
    ok = (wrong <= differ) & (o < (left_len - require)[:, None]) & (used > 0)
    at = first_true(ok, -1)
    return at, np.where(at >= 0, wrong[np.arange(n), np.maximum(at, 0)], 0)


def overlap(r1: np.ndarray, len1: np.ndarray, r2: np.ndarray, len2: np.ndarray, differ: int = 5, require: int = 30, compare: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(overlapped, offset, overlap length, mismatches) of mates; forward shifts first, then the reverse ones."""
    rc = reverse_complement(r2, len2)
    rc[np.arange(rc.shape[1]) >= len2[:, None]] = 0
    ahead, d1 = _first_overlap(r1, len1, rc, len2, differ, require, compare)
    behind, d2 = _first_overlap(rc, len2, r1, len1, differ, require, compare)
    forward, backward = ahead >= 0, (ahead < 0) & (behind >= 0)
    offset = np.where(forward, ahead, np.where(backward, -behind, 0))
    size = np.where(forward, np.minimum(len1 - ahead, len2), np.where(backward, np.minimum(len1, len2 - behind), 0))
    return forward | backward, offset, size, np.where(forward, d1, np.where(backward, d2, 0))


def correct_by_overlap(r1: np.ndarray, q1: np.ndarray, len1: np.ndarray, r2: np.ndarray, q2: np.ndarray, len2: np.ndarray, offset: np.ndarray, size: np.ndarray, phred: int = 33, good: int = 30, bad: int = 14) -> np.ndarray:
    """Where overlapping mates disagree, a good base replaces a bad one with its quality; in place. Corrections per row."""
    n = len(len1)
    width = int(size.max(initial=0))
    if not n or not width:
        return np.zeros(n, np.int64)
    i = np.arange(width)
    inside = i < size[:, None]
    p1 = np.clip(np.maximum(0, offset)[:, None] + i, 0, r1.shape[1] - 1)
    p2 = np.clip((len2 - 1 - np.maximum(0, -offset))[:, None] - i, 0, r2.shape[1] - 1)
    b1, b2 = np.take_along_axis(r1, p1, 1), np.take_along_axis(r2, p2, 1)
    w1, w2 = np.take_along_axis(q1, p1, 1), np.take_along_axis(q2, p2, 1)
    differ = inside & (b1 != _COMPLEMENT[b2])
    use1 = differ & (w1 >= phred + good) & (w2 <= phred + bad)
    use2 = differ & ~use1 & (w2 >= phred + good) & (w1 <= phred + bad)
    row, col = np.nonzero(use1)
    r2[row, p2[row, col]] = _COMPLEMENT[b1[row, col]]
    q2[row, p2[row, col]] = w1[row, col]
    row, col = np.nonzero(use2)
    r1[row, p1[row, col]] = _COMPLEMENT[b2[row, col]]
    q1[row, p1[row, col]] = w2[row, col]
    return use1.sum(axis=1) + use2.sum(axis=1)


def filter_code(bases: np.ndarray, quals: np.ndarray, length: np.ndarray, trimmed_ok: np.ndarray, shortest: int = 15, longest: int = 500, low_quality: int = 15, low_percent: int = 40, most_n: int = 5, phred: int = 33) -> np.ndarray:
    """0 pass, 1 too many N, 2 too short, 3 too long, 4 too many bases of low quality."""
    inside = np.arange(bases.shape[1]) < length[:, None]
    low = ((quals < phred + low_quality) & inside).sum(axis=1)
    n = ((bases == N) & inside).sum(axis=1)
    code = np.where(low * 100 > low_percent * length, 4, np.where(n > most_n, 1, 0))
    code = np.where((length == 0) | (length < shortest), 2, code)
    code = np.where(length >= longest, 3, code)
    return np.where(trimmed_ok, code, 2)
