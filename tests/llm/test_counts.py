import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from readloom.llm import frequent, queries, words
from tests.oracle import same

R = random.Random(4)


@pytest.mark.parametrize("epsilon", [0.5, 0.05, 0.001])
def test_lossy_bounds(epsilon):
    items = np.array([min(int(R.expovariate(0.02)), 500) for _ in range(20_000)], np.int64)
    counter = frequent.LossyCounter(epsilon)
    for at in range(0, len(items), 777):
        counter.add(items[at : at + 777])
    rows = counter.summary().to_pylist()
    true = Counter(items.tolist())
    kept = {r["h"]: r for r in rows if r["h"] is not None}
    assert all(kept[h]["n"] <= n <= kept[h]["n"] + kept[h]["delta"] if h in kept else n <= counter.pruned for h, n in true.items())
    assert counter.pruned <= epsilon * len(items) + 1
    assert len(kept) <= 20 / epsilon


S = "read_id bigint, seq string, h int, item string, n string"


def seqs(spark, rows):
    return spark.createDataFrame([(i, s, 1, "x", "y") for i, s in rows], S)


def skewed():
    rows, i = [], 0
    for k in range(1, 41):
        for _ in range(k):
            rows.append((i, f"acgt{'A' * k} \r\n" if i % 2 else f"ACGT{'A' * k}"))
            i += 1
    return rows + [(i + j, "UNIQUE" + str(j)) for j in range(3000)] + rows[:400] + [(10_000 + j, s) for j, s in enumerate([None, "", "  "] * 60)]


@pytest.mark.parametrize("epsilon", [0.004, 0.0001])
def test_most_frequent(spark, epsilon):
    got = frequent.frequent_sequences(seqs(spark, skewed()), 20, epsilon).collect()
    assert {r.seq: r.n for r in got} == {"ACGT" + "A" * k: k for k in range(21, 41)}
    assert all(r.n_low <= r.n <= r.n_high and r.certain for r in got)


def test_even_counts_keep_the_memory(spark, monkeypatch):
    """Nothing is frequent: epsilon stays, no task holds all items, and no rank is called certain."""
    calls = []
    real = frequent.merged_summary
    monkeypatch.setattr(frequent, "merged_summary", lambda h, e: calls.append(e) or real(h, e))
    got = frequent.frequent_sequences(seqs(spark, [(i, f"S{i // 2}") for i in range(20_000)]), 20, 0.01).collect()
    assert calls == [0.01] and not any(r.certain for r in got) and all(r.n_low <= r.n <= r.n_high for r in got)
    counter = frequent.LossyCounter(0.01)
    counter.add(np.arange(1_000_000, dtype=np.int64))
    assert len(counter.items) <= 100 and counter._waiting < 100


def test_uncertain_ranks_are_marked(spark):
    got = frequent.frequent_sequences(seqs(spark, skewed()), 20, 0.2).collect()
    assert all(r.n_low <= r.n <= r.n_high for r in got)
    most = {f"ACGT{'A' * k}": k for k in range(1, 41)}
    assert all(r.n == most.get(r.seq, 1) for r in got)
    assert all(r.seq in list(most)[-20:] for r in got if r.certain)


def test_frequent_edges(spark):
    assert frequent.frequent_sequences(seqs(spark, [])).count() == 0
    assert frequent.frequent_sequences(seqs(spark, [(1, None), (2, "")])).count() == 0
    long = "A" * 1_000_000
    got = frequent.frequent_sequences(seqs(spark, [(1, long), (2, long), (3, "C"), (None, "G"), (None, "G")]), 2).collect()
    assert {r.seq: r.n for r in got} == {long: 2, "C": 1, "G": 1}  # ties at the limit are all kept


def test_frequent_without_broadcast(spark):
    rows = [(i, "AB"[i % 2] * 5) for i in range(50)]
    df = seqs(spark, rows).select("read_id", "seq")
    assert frequent.frequent_items(df, "read_id", "seq", 2, broadcast_rows=0).count() == 2


@pytest.mark.parametrize("depth,letters", [(21, 4), (30, 4), (64, 2), (500, 1), (1000, 2)])
def test_suffix_array_and_prefixes(depth, letters):
    pieces = [np.array([R.randrange(letters) + 1 for _ in range(R.choice([0, 1, 5, 21, 22, 90]))], np.uint8) for _ in range(20)]
    text = np.concatenate([np.append(x, 0) for x in pieces + pieces[:5]]).astype(np.uint8)
    key = words.packed_prefixes(text)
    order = words.suffix_array(text, key, depth)
    raw, n = bytes(text), len(text)
    assert sorted(order) == list(range(n))
    raw += bytes(depth)  # behind the text stand ends
    assert all(raw[a : a + depth] <= raw[b : b + depth] for a, b in zip(order, order[1:]))
    run = np.array([raw.index(0, p) - p for p in order])
    most = min(depth, 40)
    got = words.common_prefixes(text, key, order, run, most)

    def shared(a, b):
        k = 0
        while k < most and raw[a + k] == raw[b + k] != 0:
            k += 1
        return k

    assert got.tolist() == [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def brute(rows, n):
    occurrences, records = Counter(), defaultdict(set)
    for i, s in rows:
        s = (s or "").strip().upper()
        for a in range(len(s) - n + 1):
            w = s[a : a + n]
            if set(w) <= set("ACGT"):
                occurrences[w] += 1
                records[w].add(i)
    return {w: (c, len(records[w])) for w, c in occurrences.items()}


def made(n):
    rows = [(i, "".join(R.choice("ACGTN" if i % 3 else "AC") for _ in range(R.choice([0, 1, n - 1, n, 40, 90])))) for i in range(300)]
    return rows + [(1000, None), (1001, "acgtacgtacgtacgt\n"), (1002, "A" * 50_000)]


@pytest.mark.parametrize("n", [2, 6, 9, 25])
def test_words(spark, n):
    rows = made(n)
    got = words.marked_words(seqs(spark, rows + rows[:50]), n).collect()
    want = brute(rows, n)
    assert {r.kmer: (r.occurrences, r.reads) for r in got} == want
    assert all(r.all_reads == 303 for r in got)
    assert all(r.mark == ("rare" if r.reads * 500 < 303 else "common" if r.reads * 10 > 303 else None) for r in got)


def test_all_lengths_from_one_array(spark):
    rows = made(12)
    got = words.marked_words(seqs(spark, rows), range(1, 32)).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.n][r.kmer] = r.occurrences, r.reads
    assert all(by[n] == brute(rows, n) for n in range(1, 32))
    with pytest.raises(ValueError):
        words.marked_words(seqs(spark, rows), 32)


def test_words_small_texts(spark):
    rows = [(i, "ACGTACGTAC") for i in range(100)]
    df = seqs(spark, rows).select("read_id", "seq")
    got = words.word_counts(df, "seq", [6], text_bytes=50).withColumn("kmer", words.letters_of("word", "n")).collect()
    counts = {r.kmer: (r.occurrences, r.records) for r in got}
    assert counts.pop(None) == (0, 100) and counts == {w: (c, r) for w, (c, r) in brute(rows, 6).items()}
    assert words.marked_words(seqs(spark, [])).count() == 0
    assert words.marked_words(seqs(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if n.startswith(("p2", "p5"))))
def test_equals_sql(spark, name):
    same(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])
