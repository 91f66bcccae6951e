from collections import Counter

from readloom.operators import hotkeys


def test_edges_and_skew(spark):
    schema = "read_id bigint, seq string, key12 int, n_reads string, all_reads int"
    hot = [(i, "ACGTACGTACGTTT\r\n", 1, "x", 2) for i in range(300)]
    rows = hot + hot[:50] + [(1000, None, 0, "", 0), (1001, "", 0, "", 0), (1002, "acgtacgtacg", 0, "", 0), (1003, " acgtacgtacgg ", 0, "", 0), (1004, "N" * 100_000, 0, "", 0), (None, "TTTTTTTTTTTTT", 0, "", 0), (None, "TTTTTTTTTTTTT", 0, "", 0)]
    got = {r.key12: r for r in hotkeys.prefix_groups(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v.n_reads for k, v in got.items()} == {"ACGTACGTACGT": 300, "ACGTACGTACGG": 1, "N" * 12: 1, "T" * 12: 1}
    assert {v.all_reads for v in got.values()} == {306}
    assert got["N" * 12].max_len == 100_000 and got["ACGTACGTACGT"].gc_bases == 300 * 6
    assert hotkeys.prefix_groups(spark.createDataFrame([], schema)).count() == 0


def test_share_is_strict(spark):
    rows = [(i, ("A" if i < 3 else "C" if i < 7 else "G") * 12) for i in range(100)]
    got = {r.key12 for r in hotkeys.hot_prefixes(spark.createDataFrame(rows, "read_id bigint, seq string")).collect()}
    assert got == {"C" * 12, "G" * 12}  # three of a hundred are not more than 3 %


def test_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/reads_se.parquet").select("read_id", "seq").distinct().collect()
    want = Counter(s.strip().upper()[:12] for _, s in rows if s and len(s.strip()) >= 12)
    got = {r.key12: r.n_reads for r in hotkeys.prefix_groups(spark.read.parquet(f"{data}/reads_se.parquet")).collect()}
    assert got == dict(want)
