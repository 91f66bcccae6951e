import random
import re

import pytest

from readloom.llm import queries, split
from tests.oracle import same

R = random.Random(2)
C = "chunk_id bigint, file_no bigint, chunk_start bigint, chunk_end bigint, nseqs bigint, max_bases int, halo int"
F = "gid bigint, file_no bigint, name string, comment string, seq string"


def letters(n):
    return "".join(R.choice("ACGT") for _ in range(n))


def check(pieces, whole, limit, halo, ends):
    """Ordered pieces of at most the limit give the whole back; each shares the halo; cuts are as late as allowed."""
    assert "".join(p.bases[p.fresh - p.start :] for p in pieces) == whole
    for i, p in enumerate(pieces):
        assert len(p.bases) == p.n_bases <= limit
        assert p.bases == whole[p.start : p.start + p.n_bases]
        assert p.fresh - p.start == (0 if i == 0 else min(halo, limit - 1, p.fresh))
        end = p.start + p.n_bases
        if end not in ends:  # inside a record only if it doesn't fit beside the halo
            before = max(e for e in [0, *ends] if e < end)
            assert before <= p.fresh


@pytest.mark.parametrize("limit,halo", [(1000, 0), (1000, 50), (37, 5), (10, 50), (1, 0)])
def test_pieces(spark, limit, halo, monkeypatch):
    monkeypatch.setattr(split, "SEGMENT", 4000)
    monkeypatch.setattr(split, "BLOCK", 7)
    sizes = [R.choice([0, 1, 5, 100, 300, 900, 1100, 9000]) for _ in range(60)]
    seqs = [letters(n) for n in sizes]
    records = [(i + 100, 4, "n", None, "\r\n".join(re.findall(".{1,80}", s))) for i, s in enumerate(seqs)]
    records += records[:5] + [(500, 4, "n", None, letters(50)), (110, 5, "n", None, letters(50))]
    chunks = [(7, 4, 100, 159, 60, limit, halo), (7, 4, 100, 159, 60, limit, halo), (8, 4, 110, 120, 3, 1 << 20, halo)]
    got = split.split_chunks(spark.createDataFrame(chunks, C), spark.createDataFrame(R.sample(records, len(records)), F)).collect()
    whole = "".join(seqs)
    ends, at = [], 0
    for s in seqs:
        at += len(s)
        ends.append(at)
    mine = sorted((p for p in got if p.chunk_id == 7), key=lambda p: p.fresh)
    assert mine == sorted(mine, key=lambda p: (p.segment, p.piece))
    # a segment's end is a further place to cut inside a long record
    cuts = {p.fresh for p in mine if p.piece == 0}
    check(mine, whole, limit, halo, sorted(set(ends) | cuts))
    assert [p.bases for p in got if p.chunk_id == 8] == ["".join(seqs[10:21])]
    bare = split.split_chunks(spark.createDataFrame(chunks, C), spark.createDataFrame(records, F), texts=False)
    assert sorted(map(tuple, bare.collect())) == sorted(tuple(p)[:-1] for p in got)
    found = {r.chunk_id: r.gid for r in split.oversized_chunks(split.split_chunks(spark.createDataFrame(chunks, C), spark.createDataFrame(records, F))).collect()}
    assert found == {7: 100 + next(i for i, e in enumerate(ends) if e > limit)}


def test_edges(spark):
    records = spark.createDataFrame([(1, 0, None, None, None), (2, 0, None, None, ""), (3, 0, None, None, "AC\nGT"), (None, 0, None, None, "AAAA"), (4, None, None, None, "AAAA")], F)
    chunks = [(1, 0, 1, None, 3, 3, 1), (2, 0, None, 3, 1, 4, 0), (3, 0, 3, 3, None, None, 0), (4, 0, None, None, 3, 2, 0), (5, None, 4, 4, 1, 2, 0), (6, 0, 1, 1 << 60, None, 2, None), (7, 0, 3, 1, 1, 2, 0), (8, 0, 1, 2, 2, 1, 0), (None, 0, 3, 3, 1, 1, 0)]
    got = sorted((p.chunk_id, p.piece, p.bases) for p in split.split_chunks(spark.createDataFrame(chunks, C), records).collect())
    assert got == [(1, 0, "ACG"), (1, 1, "GT"), (2, 0, "ACGT"), (6, 0, "AC"), (6, 1, "GT")]
    assert split.split_chunks(spark.createDataFrame([], C), records).count() == 0
    assert split.split_chunks(spark.createDataFrame(chunks, C), spark.createDataFrame([], F)).count() == 0


def test_clashing_columns(spark):
    records = spark.createDataFrame([(3, 0, "ACGT", 1, 2)], "gid bigint, file_no bigint, seq string, block int, n int")
    chunks = spark.createDataFrame([(1, 0, 3, 3, 1, 2, 0, "x", "y")], C + ", bases string, gid string")
    assert [p.bases for p in split.split_chunks(chunks, records).orderBy("piece").collect()] == ["AC", "GT"]


@pytest.mark.parametrize("limit,overlap", [(200, 0), (200, 30), (9, 3), (1, 0)])
def test_texts(spark, limit, overlap):
    words = ["word", "a", "longer-word", "end.", "x" * 30, "é😀"]
    texts = [("".join(R.choice(words) + R.choice([" ", " ", "\n", "\n\n"]) for _ in range(200))) for _ in range(5)] + ["", None, "x" * 1000, "😀" * 500]
    rows = [(i, t, "p") for i, t in enumerate(texts)]
    got = split.split_texts(spark.createDataFrame(rows, "id bigint, t string, piece string"), "id", "t", limit, overlap).orderBy("id", "piece").collect()
    for i, t in enumerate(texts):
        mine = [p for p in got if p.id == i]
        if not t:
            assert not mine
            continue
        assert all(len(p.text) <= limit and t[p.start : p.start + len(p.text)] == p.text for p in mine)
        end = 0
        for p in mine:
            assert p.start == max(0, end - overlap)
            end = p.start + len(p.text)
        assert end == len(t)


def test_text_boundary_is_the_strongest(spark):
    t = "One sentence. Another one here\nline two goes on\n\nnew paragraph with words"
    df = spark.createDataFrame([(1, t)], "id int, t string")
    assert split.split_texts(df, "id", "t", 60).first().text.endswith("goes on\n\n")
    assert split.split_texts(df, "id", "t", 33).first().text.endswith("here\n")
    assert split.split_texts(df, "id", "t", 20).first().text == "One sentence. "
    with pytest.raises(ValueError):
        split.split_texts(df, "id", "t", 5, 5)


@pytest.mark.parametrize("name", ["p1_found", "p1_pieces"])
def test_equals_sql(spark, data, name):
    same(spark, data, queries.queries()[name], queries.oracle_sql()[name])


def test_running_totals(spark):
    for n in (1, 2, 3, 4, 10, 99, 100, 101):
        numbers = [R.randrange(9) for _ in range(n)]
        got = spark.createDataFrame([(numbers,)], "x array<int>").select(split.running_totals("x")).first()[0]
        assert got == [sum(numbers[: i + 1]) for i in range(n)]


def test_time_grows_with_the_text(spark, tmp_path):
    """Four times the text takes no more than about four times as long, with many cuts and a halo as long as a piece."""
    import time

    def took(n):
        t = "lorem ipsum dolor sit amet. " * n
        spark.createDataFrame([(1, t)], "id int, t string").write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        best = 99.0
        for _ in range(2):
            began = time.time()
            split.split_texts(df, "id", "t", 20, 12).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    took(1000)
    assert took(40_000) < 8 * max(0.3, took(10_000))


def test_halo_as_long_as_a_piece(spark):
    records = [(i, 0, "n", None, letters(R.choice([1, 2, 30]))) for i in range(80)]
    for limit, halo in ((20, 500), (1, 3)):
        chunk = spark.createDataFrame([(1, 0, 0, 79, None, limit, halo)], C)
        got = sorted(split.split_chunks(chunk, spark.createDataFrame(records, F)).collect(), key=lambda p: p.fresh)
        whole = "".join(r[4] for r in records)
        ends, at, owner = [], 0, []
        for r in records:
            at += len(r[4])
            ends.append(at)
            owner += [r[0]] * len(r[4])
        check(got, whole, limit, halo, sorted(set(ends) | {p.fresh for p in got if p.piece == 0}))
        assert all((p.first_gid, p.last_gid) == (owner[p.fresh], owner[p.start + p.n_bases - 1]) for p in got)
