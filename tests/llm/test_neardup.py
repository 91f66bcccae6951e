import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import neardup

R = random.Random(8)
S = "read_id bigint, seq string, id string, text int, class_id int"


def dna(n):
    return "".join(R.choice("ACGT") for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "x", 1, 2) for i, s in rows], S)


def words(s):
    s = (s or "").strip().upper()
    return {s[i : i + 12] for i in range(len(s) - 11) if set(s[i : i + 12]) <= set("ACGT")}


def brute(rows):
    sets = {i: words(s) for i, s in rows if i is not None}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def edited(s, rate):
    return "".join(R.choice(["", c + R.choice("ACGT"), R.choice("ACGT")]) if R.random() < rate else c for c in s)


def test_permutations_are_bijections():
    x = np.arange(1 << 10, dtype=np.uint32)
    assert len(np.unique(neardup._first_permutation(x, 10, 1))) == 1 << 10
    p = neardup._second_permutation(10, 1, 7)
    assert sorted(p[: 1 << 10]) == list(range(1 << 10)) and (p[1 << 10 :] == p[:7]).all()


def test_signature_agreement_estimates_similarity():
    a = np.arange(0, 3000, dtype=np.uint32) * 17
    b = np.concatenate([a[:2250], np.arange(100_000, 100_750, dtype=np.uint32)])
    true = 2250 / 3750
    same = np.mean(neardup.signature(a, 1000, 12) == neardup.signature(b, 1000, 12))
    assert abs(same - true) < 0.08


def test_pairs_equal_brute_force(spark):
    rows, i = [], 0
    for _ in range(60):
        base = dna(R.choice([100, 400, 1500]))
        for _ in range(R.choice([1, 2, 4])):
            rows.append((i, edited(base, R.choice([0, 0.005, 0.02, 0.03, 0.05]))))
            i += 1
    hot = dna(300)
    rows += [(i + j, hot.lower() if j % 2 else hot + "\r\n") for j in range(30)]
    rows += [(900, None), (901, ""), (902, "ACGT"), (903, "ACGT"), (904, "N" * 50), (905, dna(12)), (906, "A" * 100_000), (907, "A" * 50)]
    want = brute(rows)
    got = [tuple(r) for r in neardup.similar_reads(frame(spark, rows + rows[:40])).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_groups_have_one_row_each(spark):
    base = dna(800)
    chain = [base]
    for _ in range(12):  # each near the one before, ends far apart
        chain.append(chain[-1][60:] + dna(60))
    rows = [(i, s) for i, s in enumerate(chain)] + [(50 + i, chain[3]) for i in range(5)] + [(80, dna(500)), (81, "")]
    near = neardup.similar_reads(frame(spark, rows))
    got = {r.id: r for r in near.groups().collect()}
    assert set(got) == {i for i, _ in rows}
    assert {r.group_id for i, r in got.items() if i < 60} == {0} and got[80].group_id == 80 and got[80].links == 0
    assert {got[i].class_id for i in (3, 50, 54)} == {3} and got[3].copies == 6
    links = brute([(i, s) for i, s in enumerate(chain)])
    assert all(got[i].links == sum(i in p for p in links) for i in range(13))


def test_hot_bucket_is_cut_and_complete(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    rows = [(1, i) for i in range(40)] + [(2, i) for i in range(30, 50)] + [(3, 7)]
    got = [tuple(r) for r in neardup.spread_self_join(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "v").collect()]
    want = {(a, b) for lo, hi in ((0, 40), (30, 50)) for a in range(lo, hi) for b in range(a + 1, hi)}
    assert len(got) == len(want) and set(got) == want


def test_crowded_band_makes_no_pairs(spark, monkeypatch):
    """Reads that share a beginning, and with it many bands, but not 60 %; among them some that do."""
    monkeypatch.setattr(neardup, "HOT_BAND", 50)
    head = dna(150)
    rows = [(i, head + dna(250)) for i in range(500)]
    rows += [(2000 + i, edited(rows[i][1], 0.01)) for i in range(40)] + [(3000 + i, rows[i][1][:330] + dna(60)) for i in range(40)]
    near = neardup.similar_reads(frame(spark, rows))
    counts = near.counts()
    by = dict(rows)  # other reads share the beginning only, less than a quarter
    want = {p for i in range(40) for p in brute([(j, by[j]) for j in (i, 2000 + i, 3000 + i)])}
    assert {tuple(r) for r in near.pairs().collect()} == want and len(want) > 80
    assert counts["hot_bands"] > 0 and counts["crowded"] > 100
    assert counts["candidates"] < 8000  # of more than 160,000 pairs


def test_signatures_drop_what_agrees_too_little():
    least = neardup.least_agreement(272, 0.6)
    assert 0.4 < least < 0.6 and neardup.least_agreement(10_000, 0.6) > 0.57


def test_without_broadcast(spark, data, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    t = spark.read.parquet(f"{data}/long_reads.parquet")
    rows = [tuple(r) for r in t.select("read_id", "seq").distinct().collect()]
    assert {tuple(r) for r in neardup.similar_reads(t).pairs().collect()} == brute(rows)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")))
    got = neardup.components(edges).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


def test_empty(spark):
    near = neardup.similar_reads(frame(spark, []))
    assert near.pairs().count() == 0 and near.groups().count() == 0
    near = neardup.similar_reads(frame(spark, [(1, None), (None, "ACGT")]))
    assert near.pairs().count() == 0


def test_given_table(spark, data):
    t = spark.read.parquet(f"{data}/long_reads.parquet")
    rows = [tuple(r) for r in t.select("read_id", "seq").distinct().collect()]
    assert {tuple(r) for r in neardup.similar_reads(t).pairs().collect()} == brute(rows)


@pytest.mark.parametrize("name", ["p6_found", "p6_groups"])
def test_equals_sql(spark, name):
    from readloom.llm import queries
    from tests.oracle import same

    same(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])


def test_threshold_is_exact(spark):
    """Sets of 5 words with 3 in common lie at the limit of 60 % in any case."""
    base = dna(13)
    rows = [(1, base), (2, base[:12] + ("A" if base[12] != "A" else "C"))]
    assert brute(rows) == set() and neardup.similar_reads(frame(spark, rows)).pairs().count() == 0
    for n in (4, 16, 40):  # n common words of n + n * 2/3 in all
        common = dna(n + 11)
        rows = [(1, common), (2, common + dna(2 * n // 3))]
        assert {tuple(r) for r in neardup.similar_reads(frame(spark, rows)).pairs().collect()} == brute(rows)
