import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.functions import kernels as K
from readloom.functions.ragged import blocks, flat, sliced
from readloom.operators import orp, trim
from tests import scalar

R = random.Random(5)


def reads(n=400, letters="ACGTN"):
    """Reads of all lengths with poly tails, N at the ends and low-quality ends."""
    out = []
    for i in range(n):
        size = R.choice([0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 14, 15, 16, 30, 31, 32, 33, 60, 100, 150])
        s = "".join(R.choice(letters) for _ in range(size))
        if i % 3 == 0 and size > 4:
            tail = R.randrange(size)
            b = R.choice("ATCGN")
            s = s[: size - tail] + "".join(b if R.random() < 0.9 else R.choice("ACGT") for _ in range(tail))
        if i % 7 == 0:
            s = "N" * min(3, size) + s[3:]
        if i % 11 == 0:
            s = s[0] * size if s else s
        q = "".join(chr(33 + R.choice([2, 10, 15, 19, 20, 21, 30, 40])) for _ in range(size))
        out.append((s, q))
    return out


def columns(rows):
    return [pa.array([r[i] for r in rows], pa.string()) for i in range(len(rows[0]))]


def in_blocks(rows, f):
    """f(block) -> arrays per row, put together in order."""
    s, q = columns(rows)
    seq, qual = flat(s), flat(q)
    out = [None] * len(rows)
    for b in blocks(seq, qual, np.zeros(len(rows), np.int64), np.diff(seq[1])):
        for row, value in zip(b.rows, zip(*f(b))):
            out[row] = tuple(x.item() for x in value)
    return out


@pytest.mark.parametrize("front,tail,five,three", [(0, 0, True, False), (0, 0, False, True), (0, 0, True, True), (3, 2, True, True), (5, 3, False, False), (1, 0, True, False), (0, 4, False, True)])
def test_trim(front, tail, five, three):
    rows = reads()
    got = in_blocks(rows, lambda b: K.trim_ends(b.bases, b.quals, b.lengths, front, tail, five, three))
    for (s, q), (ok, begin, size) in zip(rows, got):
        want = scalar.trim(s, q, front, tail, five, three)
        assert (want is not None) == ok, (s, q)
        if want:
            assert want == (begin, size), (s, q)


def test_poly():
    rows = reads(1500)
    assert [x for (x,) in in_blocks(rows, lambda b: (K.trim_poly_g(b.bases, b.lengths),))] == [scalar.poly_g(s) for s, _ in rows]
    assert [x for (x,) in in_blocks(rows, lambda b: (K.trim_poly_x(b.bases, b.lengths),))] == [scalar.poly_x(s) for s, _ in rows]


@pytest.mark.parametrize("size", [3, 4, 7, 8, 12, 16, 24, 60])
def test_adapter(size):
    a = "".join(R.choice("ACGT") for _ in range(size))
    rows = []
    for s, q in reads(500):
        if R.random() < 0.6 and s:
            at = R.randrange(-4, len(s))
            noisy = "".join(c if R.random() < 0.93 else R.choice("ACGT") for c in a)
            s = (s[: max(0, at)] + noisy[max(0, -at) :] + s)[: len(s)]
        rows.append((s, q))
    got = in_blocks(rows, lambda b: (K.find_adapter(b.bases, b.lengths, np.frombuffer(a.encode(), np.uint8)),))
    assert [None if x == -1000 else x for (x,) in got] == [scalar.adapter(s, a) for s, _ in rows]


def test_adapter_list():
    listed = sorted("".join(R.choice("ACGT") for _ in range(R.choice([5, 10, 18, 30]))) for _ in range(20))
    rows = []
    for s, q in reads(400):
        if s:
            at = R.randrange(len(s))
            s = (s[:at] + R.choice(listed) + R.choice(listed))[: len(s)].ljust(len(s), "A")
        rows.append((s, q))
    match = trim.list_match(listed)
    assert match == 5 and trim.list_match(listed[:16]) == 4 and trim.list_match(["A"] * 257) == 6
    got = in_blocks(rows, lambda b: trim.cut_list(b.bases, b.lengths, listed, match))
    for (s, _), (size, removed) in zip(rows, got):
        kept, n = scalar.adapters(s, listed, match)
        assert (size, removed) == (len(kept), n)


def mates(n=300):
    out = []
    for i in range(n):
        frag = "".join(R.choice("ACGT") for _ in range(R.choice([10, 29, 30, 31, 45, 60, 100, 130, 220])))
        l1, l2 = R.choice([0, 20, 31, 80, 100]), R.choice([0, 33, 80, 100])
        rc = "".join(scalar.PAIR[c] for c in reversed(frag))
        noise = lambda s: "".join(c if R.random() < 0.97 else R.choice("ACGTN") for c in s)
        s1, s2 = noise((frag + "AGATCGGAAGAGC" + "A" * 100)[:l1]), noise((rc + "CTGTCTCTTATAC" + "T" * 100)[:l2])
        q = lambda s: "".join(chr(33 + R.choice([2, 14, 15, 29, 30, 38])) for _ in s)
        out.append((s1, q(s1), s2, q(s2)))
    return out


def test_overlap_and_correction():
    from readloom.operators.pairs import pair_blocks

    rows = mates()
    s1, q1, s2, q2 = (flat(c) for c in columns(rows))
    seen = 0
    for one, two in pair_blocks(s1, q1, s2, q2):
        ok, offset, size, diff = K.overlap(one.bases, one.lengths, two.bases, two.lengths)
        before = [rows[i] for i in one.rows]
        n = K.correct_by_overlap(one.bases, one.quals, one.lengths, two.bases, two.quals, two.lengths, offset, size)
        for j, (a, qa, b, qb) in enumerate(before):
            want = scalar.overlap(a, b)
            assert (want is not None) == bool(ok[j])
            if want:
                seen += 1
                assert want == (offset[j], size[j], diff[j])
                c1, w1, c2, w2, m = scalar.correct(a, qa, b, qb, offset[j], size[j])
                text = lambda m_, k: m_[j, :k].tobytes().decode()
                assert (text(one.bases, len(a)), text(one.quals, len(a)), text(two.bases, len(b)), text(two.quals, len(b)), n[j]) == (c1, w1, c2, w2, m)
    assert seen > 50


def test_hot_scan():
    hot = ["".join(R.choice("AC") for _ in range(k)) for k in (3, 3, 5, 8) for _ in range(4)]
    words = orp.HotWords(hot)
    rows = [("".join(R.choice("AC") for _ in range(R.choice([0, 2, 3, 4, 5, 8, 9, 30, 80]))),) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays(columns(rows), ["seq"])
    got = {}
    for b in orp._scan(hot, 100)(iter([batch])):
        for w, p, n in zip(*(c.to_pylist() for c in b.columns)):
            got[w, p] = got.get((w, p), 0) + n
    want = {}
    for (s,) in rows:
        for k in words.by:
            for p, w in scalar.hits(s, k, set(hot)):
                want[w, p] = want.get((w, p), 0) + 1
    assert got == want and want


def test_sliced_and_flat_of_slices():
    a = pa.array(["abc", None, "", "défg", "xyz"])[1:]
    text, offsets = flat(a)
    assert offsets.tolist() == [0, 0, 0, 5, 8]
    assert sliced(text, offsets, np.array([0, 0, 0, 1]), np.array([0, 0, 1, 2])).to_pylist() == ["", "", "d", "yz"]
