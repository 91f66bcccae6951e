"""Links, alignment and columns made from arrays against the plain ways of the same definitions."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from readloom import common
from readloom.operators import correct
from readloom.operators import neighbours as N
from readloom.options import Options

R = random.Random(11)


def noisy(n: int, spread: int = 400, shift: int = 0) -> list[tuple[int, str, str]]:
    """Reads of both directions and several lengths from two regions that differ in a few places."""
    g = "".join(R.choice("ACGT") for _ in range(spread))
    other = "".join(x if R.random() < 0.95 else R.choice("ACGT") for x in g)
    rows = []
    for i in range(n):
        size, source = R.choice([60, 100, 100, 100, 150]), R.choice([g, g, other])
        p = R.randrange(spread - size)
        s = "".join(x if R.random() < 0.98 else R.choice("ACGT") for x in source[p : p + size])
        s = s if R.random() < 0.5 else s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((i + shift, s, "".join(R.choice("5?I") for _ in s)))
    return rows + [(n + i + shift, rows[0][1], rows[0][2]) for i in range(90)]  # a bucket that is too large


@pytest.mark.parametrize("shift", [0, (1 << 40) + 1])
def test_alignments_of_parts(spark, shift):
    rows = noisy(150, shift=shift)
    t = spark.createDataFrame(rows, "read_id bigint, seq string, qual string")
    o = Options(pair_mode="PE")
    got = {(r.read_id, r.candidate): tuple(r)[2:] for r in correct.alignments(t, o).collect()}
    seqs = {i: s for i, s, _ in rows}
    links = {(r.read_id, r.candidate) for r in correct.candidate_pairs(correct.signatures(t, 20)).collect()}
    assert links and not any(i >= 150 + shift for i, _ in links)
    stack = lambda texts: np.stack([np.frombuffer(x.ljust(150, "\0").encode(), np.uint8) for x in texts])
    pairs = sorted(links)
    a, c = stack([seqs[i] for i, _ in pairs]), stack([seqs[j] for _, j in pairs])
    la, lc = (np.array([len(seqs[p[k]]) for p in pairs]) for k in (0, 1))
    f, r = (correct.align(a, la, x, lc, 0.2, 30, 0.3) for x in (c, correct.reverse_rows(c, lc)))
    ok, turned = correct.orient(f, r, la, 0.24, 30, 0.3)
    want = {}
    for n in np.flatnonzero(ok):
        s, over, wrong = (int((r if turned[n] else f)[k][n]) for k in (1, 2, 3))
        i, j = pairs[n]
        want[i, j] = (bool(turned[n]), s, over, wrong, (i ^ 1, j ^ 1) in links or wrong / over < 0.06)
    assert got == want and len({v[4] for v in got.values()}) == 2


def parts(spark, o: Options) -> correct.Part:
    rows = [tuple(r) for r in correct.grouped(correct.ready_reads(spark.createDataFrame(noisy(400), "read_id bigint, seq string, qual string"), o), o).collect()]
    return correct.Part(iter([N.batch([r[:2] + tuple(bytes(x) if x is not None else None for x in r[2:]) for r in rows])]), o)


@pytest.mark.parametrize("o", [Options(), Options(coverage=10, quality_scores=True), Options(coverage=12, correct_candidates=True)])
def test_columns_of_all_anchors_at_once(spark, o):
    part, removed = parts(spark, o), 0
    once = {}
    for batch in correct._correct(o, (None, None))(part.piles(o)):
        for x in batch.to_pylist():
            once.setdefault((x["kind"], x["hq"]), []).append((x["read_id"], x["shift"], x["seq"]))
    one = {}
    for batch in correct._correct_with(o, (None, None))(part.piles(o)):
        for x in batch.to_pylist():
            one.setdefault((x["kind"], x["hq"]), []).append((x["read_id"], x["shift"], x["seq"]))
    assert {k: sorted(v) for k, v in once.items()} == {k: sorted(v) for k, v in one.items()} and once
    for p in part.piles(o, 500):
        x = correct.Stacked(p, o)
        trusted, high = x.quality()
        for i in range(len(p.ids)):
            own = p.kept(i)
            rows, quals, factors = p.pile(i, own)
            keep, c = correct.selected_columns(rows, p.shift[own], factors, quals, o)
            at = slice(x.starts[i], x.starts[i + 1])
            assert (x.counts[:, at] == c.counts).all() and np.allclose(x.weights[:, at], c.weights, atol=1e-8)
            assert (np.flatnonzero(x.keep[own]) == keep).all() and x.begin[i] == c.begin and (trusted[i], high[i]) == correct.quality_of(c, o)
            removed += len(own) - len(keep)
    assert removed > 0


def test_shifts_are_made_once_for_each_read(spark, monkeypatch):
    o, shifted = Options(), []
    got = correct.grouped(correct.ready_reads(spark.createDataFrame(noisy(400), "read_id bigint, seq string, qual string"), o), o).collect()
    word = correct._word
    monkeypatch.setattr(correct, "_word", lambda plane, s: shifted.append(plane.shape[1]) or word(plane, s))
    part = correct.Part(iter([N.batch([tuple(r)[:2] + tuple(bytes(x) if x is not None else None for x in tuple(r)[2:]) for r in got])]), o)
    assert len(part.anchor) > 5_000
    # Windows of both directions in each of three widths, whatever the pairs are: before, a copy for each pair and side.
    assert 0 < sum(shifted) <= 3 * 2 * 128 * len(part.reads.ids)


def test_windows_are_read_in_order():
    """Pairs of the same lengths in order of the read whose windows are read, however they come."""
    rng = np.random.default_rng(5)
    windows, words = rng.integers(0, 1 << 62, (40, 71)).astype(np.uint64), rng.integers(0, 1 << 62, 40).astype(np.uint64)
    moved, still, same = rng.integers(0, 40, 900), rng.integers(0, 40, 900), np.full(900, 100)
    taken = []

    class Seen:
        shape = windows.shape

        def take(self, rows, axis):
            taken.extend(rows)
            return windows.take(rows, axis=axis)

    found = correct._near_shifts(Seen(), moved, [(words, still)], same, same, np.full(900, 30), np.full(101, 21, np.uint8), 0)
    got = {(int(r), int(s)) for _, rows, shifts in found for r, s in zip(rows, shifts)}
    assert taken == sorted(moved)
    inside = np.array([(1 << min(64, 100 - s)) - 1 for s in range(71)], np.uint64)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count((windows[moved] ^ words[still, None]) & inside) < 21)))) and got


def test_letters_of_a_pile_are_taken_in_one_run(spark):
    o = Options(coverage=10, quality_scores=True)
    part = parts(spark, o)
    text, quals = part.reads.both_ways
    for c in range(0, len(part.reads.ids), 7):
        at = correct._runs(np.array([len(text) - part.reads.offsets[c + 1], part.reads.offsets[c]]), np.repeat(part.reads.length[c], 2))
        own = slice(part.reads.offsets[c], part.reads.offsets[c + 1])
        assert (text[at] == np.concatenate([3 - part.reads.text[own][::-1], part.reads.text[own]])).all()
        assert (quals[at] == np.concatenate([part.reads.quals[own][::-1], part.reads.quals[own]])).all()


@pytest.mark.parametrize("few", [1 << 14, 1 << 8])
def test_pairs_by_few_windows(few, monkeypatch):
    """All lengths, also of several words, and pairs in several portions: as one pair after the other."""
    rng = np.random.default_rng(few)
    g = rng.integers(0, 4, 700).astype(np.uint8)
    texts = []
    for size in [*range(28, 132, 3), 20, 64, 65, 128, 129, 300, 640]:
        p = rng.integers(0, 700 - size + 1) if size > 300 else rng.integers(0, 300 - size + 1)
        t = np.where(rng.random(size) < 0.06, rng.integers(0, 4, size), g[p : p + size]).astype(np.uint8)
        texts.append(t if rng.random() < 0.5 else 3 - t[::-1])
    texts.append(np.zeros(100, np.uint8))
    texts.append(np.full(70, 3, np.uint8))
    n = np.array([len(t) for t in texts])
    reads = N.Reads([[N._bytes(np.arange(len(texts))), N._bytes(n), N._bytes(N.packed(np.concatenate(texts)))]], False)
    left, right = np.triu_indices(len(texts), 1)
    monkeypatch.setattr(correct, "_WINDOWS", few)
    o = Options()
    ok, *found = correct._align_pairs(reads, left, right, o)
    stack = lambda which: np.stack([np.pad(np.frombuffer(b"ACGT", np.uint8)[texts[k]], (0, 640 - n[k])) for k in which])
    used = 0
    for side, (a, c) in enumerate(((left, right), (right, left))):
        x, y = stack(a), stack(c)
        f, r = (correct.align(x, n[a], z, n[c], o.max_mismatch_ratio, o.min_overlap, o.min_overlap_ratio) for z in (y, correct.reverse_rows(y, n[c])))
        want, turned = correct.orient(f, r, n[a], 4 * o.error_factor, o.min_overlap, o.min_overlap_ratio)
        assert (ok[side] == want).all() and (found[0][side] == turned)[want].all()
        for k in (1, 2, 3):
            assert (found[k][side] == np.where(turned, r[k], f[k]))[want].all()
        used += want.sum()
    assert used > 300


def test_arrays_in_rows():
    for x in ([], [0, 255], [0, 256], [5, 1 << 20], [1 << 40, 3], [-7, 2]):
        assert N._array(N._bytes(np.array(x, np.int64))).tolist() == x
    assert N.risen([[N.rising(np.array([-9, -9, 4, 1 << 50]))]], 0).tolist() == [-9, -9, 4, 1 << 50]
    text = np.array([3, 1, 0, 2, 2, 1], np.uint8)
    assert N.unpacked(N.packed(text), 6).tolist() == text.tolist()


def test_written_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        time.sleep(1)
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    old = shuffled()
    df = common.written(spark.range(1000).repartition(7), "test")
    assert not shuffled() - old
    assert df.count() == 1000
