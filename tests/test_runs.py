"""Whole runs, error correction and streaming: invariants and constructed cases."""

import random

import numpy as np
import pytest

from readloom.operators import correct, detect, orp, pairs, reads, trim
from readloom.options import Options
from readloom.plans import pipeline
from tests import scalar

R = random.Random(11)


def genome(n):
    return "".join(R.choice("ACGT") for _ in range(n))


def test_single_run_conserves(spark, data):
    t = reads.single_reads(spark.read.parquet(f"{data}/reads_se.parquet"), "name", "strand", "qual")
    result = pipeline.single(t, Options(cut5=True, cut3=True, poly_g=True, poly_x=True, overrepresented=True))
    before = result.tables["before_totals"].first()
    assert result.coded.count() == before.reads == t.count()
    assert sum(r.reads for r in result.tables["filter"].collect()) == before.reads
    assert result.passed.count() == result.tables["after_totals"].first().reads
    for when in ("before", "after"):
        bases = result.tables[f"{when}_totals"].first().bases
        assert sum(r.n for r in result.tables[f"{when}_positions"].collect()) == bases
        assert sum(r.length * r.reads for r in result.tables[f"{when}_lengths"].collect()) == bases
    for row in result.tables.values():
        row.collect()


def test_chain_is_the_scans_in_order(spark, data):
    t = reads.single_reads(spark.read.parquet(f"{data}/reads_se.parquet"), "qual")
    listed = trim.adapter_list(spark.read.parquet(f"{data}/adapters.parquet"))
    o = Options(cut5=True, cut3=True, poly_g=True, poly_x=True, front1=1, tail1=2)
    one = listed[3]
    got = {r.read_id: r for r in trim.trim_single(t, o, one, listed).collect()}
    for read_id, seq, qual in t.collect():
        cut = scalar.trim(seq, qual, 1, 2, True, True)
        r = got[read_id]
        if cut is None:
            assert (r.trimmed_ok, r.code, r.seq) == (False, 2, seq)
            continue
        s = seq[cut[0] : cut[0] + cut[1]]
        s = s[: scalar.poly_g(s)]
        s = s[: scalar.poly_x(s)]
        pos = scalar.adapter(s, one)
        removed = 0
        if pos is not None:
            removed = len(one) + pos if pos < 0 else len(s) - pos
            s = s[: max(0, pos)]
        s, more = scalar.adapters(s, listed, trim.list_match(listed))
        assert (r.seq, r.adapter_bases) == (s, removed + more)
        assert r.qual == qual[cut[0] : cut[0] + len(s)]


def test_paired_run(spark, data):
    t = reads.read_pairs(spark.read.parquet(f"{data}/reads_pe.parquet"), "name", "q1", "q2")
    result = pipeline.paired(t, Options(in_file1="x", in_file2="y", correct_overlap=True, poly_x=True))
    assert sum(r.reads for r in result.tables["filter"].collect()) == 2 * t.count()
    assert sum(r.pairs for r in result.tables["insert_sizes"].collect()) == t.count()
    coded = pairs.trim_pairs(t, Options(correct_overlap=True)).collect()
    source = {r.read_id: r for r in t.collect()}
    for r in coded:
        x = source[r.read_id]
        ov = scalar.overlap(x.s1, x.s2)
        assert r.overlapped == (ov is not None)
        if ov:
            a, qa, b, qb, n = scalar.correct(x.s1, x.q1, x.s2, x.q2, ov[0], ov[1])
            if ov[0] < 0:
                a, qa, b, qb = (v[: ov[1]] for v in (a, qa, b, qb))
            assert (r.s1, r.q1, r.s2, r.q2, r.corrected) == (a, qa, b, qb, n)


def align_by_scan(a, c, ratio=0.2, least=30, least_ratio=0.3):
    total, need = len(a) + len(c), max(least, int(len(a) * least_ratio))
    best, out = total, None
    shifts = [0, *range(1, len(a) - need + 1), *range(-1, need - len(c) - 1, -1)]
    for s in shifts:
        o = min(len(a) - s, len(c)) if s >= 0 else min(len(a), len(c) + s)
        if o <= 0:
            continue
        m = sum(a[s + i] != c[i] if s >= 0 else a[i] != c[i - s] for i in range(o))
        score = m + total - 2 * o
        if m < int(o * ratio) and score < best:
            best, out = score, (s, o, m)
    return out


def test_alignment():
    g = genome(300)
    rows = []
    for _ in range(150):
        p, q = R.randrange(180), R.randrange(180)
        a, c = g[p : p + R.choice([40, 80, 100])], g[q : q + R.choice([40, 80, 100])]
        rows.append((a, "".join(x if R.random() < 0.95 else R.choice("ACGT") for x in c)))
    size = lambda i: np.array([len(r[i]) for r in rows])
    stack = lambda i: np.stack([np.frombuffer(r[i].ljust(100, "\0").encode(), np.uint8) for r in rows])
    valid, shift, over, wrong = correct.align(stack(0), size(0), stack(1), size(1), 0.2, 30, 0.3)
    for i, (a, c) in enumerate(rows):
        want = align_by_scan(a, c)
        assert (want is not None) == bool(valid[i])
        if want:
            assert want == (shift[i], over[i], wrong[i])


def noisy_reads(spark, n=600, size=100, error=0.01):
    g = genome(1500)
    rows, truth = [], {}
    for i in range(n):
        p = R.randrange(len(g) - size)
        s = g[p : p + size]
        if R.random() < 0.5:
            s = "".join(scalar.PAIR[x] for x in reversed(s))
        truth[i] = s
        rows.append((i, "".join(x if R.random() > error else R.choice("ACGT") for x in s), "I" * size))
    return spark.createDataFrame(rows, "read_id bigint, seq string, qual string"), truth


@pytest.mark.parametrize("o", [Options(), Options(correct_candidates=True), Options(quality_scores=True, quality_bits=2), Options(pair_mode="PE")])
def test_correction_removes_errors(spark, o):
    t, truth = noisy_reads(spark)
    wrong = lambda rows: sum(a != b for r in rows for a, b in zip(r.seq, truth[r.read_id]))
    before, after = wrong(t.collect()), wrong(correct.corrected_reads(t, o).collect())
    assert after < 0.2 * before, (before, after)
    assert correct.corrected_reads(t, o).count() == 600


def test_correction_edges(spark):
    schema = "read_id bigint, seq string, qual string, name string"
    rows = [(0, "", "", "a"), (1, "ACGT", "IIII", "b"), (2, "N" * 60, "I" * 60, "c"), (3, "acgtn" * 20, "I" * 100, "d")]
    got = correct.corrected_reads(spark.createDataFrame(rows, schema), Options(quality_labels=True)).orderBy("read_id").collect()
    assert [r.seq for r in got] == [r[1] for r in rows] and got[0].name == "a corrected:q=0"
    assert correct.corrections(spark.createDataFrame([], schema)).count() == 0
    seqs = {r.read_id: (r.seq, r.ambiguous) for r in correct.prepared(spark.createDataFrame(rows, schema)).collect()}
    assert seqs[2] == ("ACGT" * 15, True) and seqs[1] == ("ACGT", False) and seqs[3][0][:10] == "ACGTAACGTC"


def test_combination(spark):
    rows = [(1, "anchor", True, 0, "A"), (1, "candidate", False, 0, "C"), (2, "anchor", False, 0, "A"), (2, "candidate", False, 0, "A"), (2, "candidate", False, 0, "A"), (3, "anchor", False, 0, "A"), (3, "candidate", False, 0, "A"), (3, "candidate", False, 0, "C"), (4, "candidate", False, 0, "A"), (5, "anchor", False, 0, "G")]
    got = {r.read_id: (r.corrected, r.label) for r in correct.combined(spark.createDataFrame(rows, "read_id bigint, kind string, hq boolean, shift int, seq string")).collect()}
    assert got == {1: ("A", 3), 2: ("A", 2), 5: ("G", 1)}


def test_detects_planted_adapter(spark):
    known, whole = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", genome(90)
    for planted, want in ((known, known), (whole, whole[:60])):
        rows = []
        for i in range(10_050):
            s = genome(100)
            if i % 4 == 0:
                p = R.randrange(30, 60) if planted is known else 0
                s = (s[:p] + planted + genome(100))[:100] if planted is known else whole
            rows.append((i, s))
        t = spark.createDataFrame(rows, "read_id bigint, seq string")
        assert detect.detect_adapter(t) == want
        assert detect.detect_adapter(t.filter("read_id < 9000")) == ""
    assert detect.detect_adapter(spark.createDataFrame([(i, genome(50)) for i in range(10_001)], "read_id bigint, seq string")) == ""


def test_overrepresented_counts(spark):
    word = genome(60)
    rows = [(i, word if i % 2 else genome(60)) for i in range(2000)]
    t = spark.createDataFrame(rows, "read_id bigint, seq string")
    hot = orp.hot_sequences(orp.head_reads(t)).collect()
    assert hot and all(r.word in word for r in hot)
    got = orp.overrepresented(t, every=5).collect()
    assert got and all(r.n == sum(r.starts.values()) for r in got)


def test_bounded_head(spark):
    from pyspark.sql import functions as F

    t = spark.range(200_000).select(F.col("id").alias("read_id"), F.lit("ACGT").alias("seq"))
    assert reads.bounded_head(t, F.length("seq"), 150_000, 1 << 60).agg(F.count("*"), F.max("read_id")).first()[:] == (150_000, 149_999)
    assert reads.bounded_head(t, F.length("seq"), 1 << 60, 401).count() == 101
    assert reads.bounded_head(t, F.length("seq"), 1 << 60, 1 << 60).count() == 200_000
    assert reads.bounded_head(t.filter("read_id < 0"), F.length("seq"), 10, 10).count() == 0


def test_empty_tables(spark, data):
    empty = reads.single_reads(spark.read.parquet(f"{data}/reads_se.parquet").filter("read_id < 0"), "name", "strand", "qual")
    result = pipeline.single(empty, Options(cut5=True))
    assert result.passed.count() == 0 and result.tables["before_totals"].first().reads == 0
    none = reads.read_pairs(spark.read.parquet(f"{data}/reads_pe.parquet").filter("read_id < 0"), "name", "q1", "q2")
    assert pipeline.paired(none, Options(in_file1="x", in_file2="y")).passed.count() == 0


def test_stream_counts_each_read_once(spark, data, tmp_path):
    from readloom.streaming import arrivals

    t = spark.read.parquet(f"{data}/reads_se.parquet")
    (tmp_path / "in").mkdir()
    t.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = arrivals.stream_reads(spark, str(tmp_path / "in"), t.schema)
    q = arrivals.start(arrivals.arrival_counts(stream, late="3650 days"), "arrivals", str(tmp_path / "ck"), mode="complete")
    q.awaitTermination(120)
    got = spark.sql("SELECT sum(reads) AS n FROM arrivals").first().n
    assert got == t.filter("arrived_at IS NOT NULL").select("read_id").distinct().count()


def random_tree(n, depth):
    """(nested, as arrays) of the same random tree."""
    nodes = []

    def make(d):
        at = len(nodes)
        nodes.append([R.randrange(n), R.random(), -1, -1, 0.0, 0.0])
        for side in (0, 1):
            if d and R.random() < 0.7:
                nodes[at][2 + side] = make(d - 1)
            else:
                nodes[at][4 + side] = R.randrange(64) / 64
        return at

    make(depth)
    return nodes


def test_forest(tmp_path):
    from readloom.operators import forest

    raw = [random_tree(13, 6) for _ in range(7)]
    trees = [forest.Tree(*(np.array(c, t) for c, t in zip(zip(*nodes), (int, float, int, int, float, float)))) for nodes in raw]
    whole = forest.Forest(trees)
    forest.write_forest(whole, str(tmp_path / "f"), 13)
    back = forest.read_forest(str(tmp_path / "f"), 13)
    rows = np.array([[R.random() for _ in range(13)] for _ in range(200)])

    def walk(nodes, row, at=0):
        side = 0 if row[nodes[at][0]] <= nodes[at][1] else 1
        return nodes[at][4 + side] if nodes[at][2 + side] < 0 else walk(nodes, row, nodes[at][2 + side])

    want = [sum(walk(n, r) for n in raw) / 7 for r in rows]
    assert np.allclose(whole.probability(rows), want) and np.allclose(back.probability(rows), want)
    assert len(forest.read_forest(str(tmp_path / "f"), 13, most_trees=2).trees) == 2
    with pytest.raises(ValueError):
        forest.read_forest(str(tmp_path / "f"), 14)
    (tmp_path / "g").write_bytes((tmp_path / "f").read_bytes()[:-3])
    with pytest.raises(ValueError):
        forest.read_forest(str(tmp_path / "g"), 13)


def test_forest_decides_corrections(spark):
    from readloom.operators import forest

    t, truth = noisy_reads(spark, 300, error=0.03)
    one = lambda v: forest.Forest([forest.Tree(np.array([0]), np.array([0.5]), np.array([-1]), np.array([-1]), np.array([v]), np.array([v]))])
    o = Options(correction_type=1)
    source = {r.read_id: r.seq for r in t.collect()}
    never = correct.corrections(t, o, one(0.0)).collect()
    always = correct.corrections(t, o, one(1.0)).collect()
    assert any(not r.hq for r in never)
    assert all(r.seq == source[r.read_id] for r in never if not r.hq)
    wrong = lambda rows: sum(a != b for r in rows for a, b in zip(r.seq, truth[r.read_id]))
    assert wrong(always) < wrong(never)
    features = correct.correction_features(t, Options(correction_type=2)).collect()
    assert features and {len(r.features) for r in features} <= {13, 14}
    assert all(r.consensus != source[r.read_id][r.pos] for r in features if r.kind == "anchor")
    for r in correct.consensus_columns(t).collect():
        assert len(r.consensus) == len(r.support) == len(r.coverage) and r.begin <= 0
        own = r.coverage[-r.begin : -r.begin + 100]
        assert len(own) == 100 and min(own) >= 1 and max(own) <= r.reads + 1 and all(0.25 <= x <= 1 for x in r.support)
    kept = correct.alignments(t).filter("kept").collect()
    assert kept and all(r.overlap >= 30 and r.mismatches < 0.24 * r.overlap for r in kept)


def test_all_queries_on_empty_tables(spark, data, tmp_path):
    import os

    from readloom.queries import core

    for f in os.listdir(data):
        if f.split(".")[0] in ("reads_se", "reads_pe", "long_reads", "fasta_records", "fasta_chunks", "raw_reads"):
            spark.read.parquet(f"{data}/{f}").limit(0).write.parquet(str(tmp_path / f))
        elif f == "adapters.parquet":
            spark.read.parquet(f"{data}/{f}").write.parquet(str(tmp_path / f))
    for f in core.queries().values():
        f(spark, str(tmp_path)).collect()


def test_written_tables_can_be_dropped(spark):
    from readloom import common

    df = common.written(spark.range(10), "test")
    assert df.count() == 10 and common.drop_written(spark) >= 1 and common.drop_written(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
