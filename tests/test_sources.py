import gzip
import random
import zlib

import pytest

from readloom import sinks
from readloom.options import OptionError, Options, parse
from readloom.plans import pipeline
from readloom.sources import fastq

R = random.Random(3)


def records(n, pos=0):
    out = []
    for i in range(n):
        k = R.randrange(1, 60)
        seq = "".join(R.choice("ACGTN") for _ in range(k))
        # qualities that look like headers and separators
        qual = ("@" if i % 3 == 0 else "+" if i % 3 == 1 else "I") + "".join(R.choice("@+I#") for _ in range(k - 1))
        out.append((f"@r{i} {pos}", seq, "+" if i % 2 else "+@x", qual))
    return out


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_round_trip(spark, tmp_path, split, end):
    rows = records(300)
    p = tmp_path / "a.fastq"
    p.write_bytes("".join(end.join(r) + end for r in rows).encode())
    got = fastq.read_fastq(spark, str(p), split).orderBy("read_id").collect()
    assert [tuple(r)[1:] for r in got] == rows
    assert [r.read_id for r in got] == list(range(300))


def test_gzip_many_files_and_empty(spark, tmp_path):
    rows = records(50)
    text = "".join("\n".join(r) + "\n" for r in rows)
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.fq").write_text(text)
    (tmp_path / "c.fq").write_text("")
    got = fastq.read_fastq(spark, str(tmp_path), 700).orderBy("read_id").collect()
    assert [r.seq for r in got] == [r[1] for r in rows] * 2
    with pytest.raises(Exception):
        fastq.read_fastq(spark, str(tmp_path / "none.fq")).count()


def bgzf(text, size):
    """The text in blocks of so many bytes, each with its compressed size in the extra field, and the empty block at the end."""
    out = b""
    for at in [*range(0, len(text), size), len(text)]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = text[at : at + size]
        body = c.compress(part) + c.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little")
        out += head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


@pytest.mark.parametrize("size,split", [(97, 500), (1000, 300), (60_000, 1 << 20), (33, 64)])
def test_blocks_of_gzip_are_cut(spark, tmp_path, size, split):
    rows = records(200)
    text = "".join("\n".join(r) + "\n" for r in rows).encode()
    data = bgzf(text, size)
    assert gzip.decompress(data) == text
    p = tmp_path / "a.fq.gz"
    p.write_bytes(data)
    assert fastq.is_bgzf(str(p))
    parts = fastq._Reader({"path": str(p), "splitbytes": split}, False).partitions()
    assert len(parts) == -(-len(data) // split)
    got = fastq.read_fastq(spark, str(p), split).orderBy("read_id").collect()
    assert [tuple(r) for r in got] == [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_broken_records_have_a_reason(spark, tmp_path, split):
    p = tmp_path / "a.fq"
    p.write_text("@a\nAC\n+\nII\n\n\n@b\nACG\nIII\n@c\nA\n+\nI\nnoise\nmore\n@d\nAC\n+d\n@I\n@e\n\n+\n\n@f\nACGT\n+\n")
    good = fastq.read_fastq(spark, str(p), split).orderBy("read_id").collect()
    assert [(r.read_id, r.name, r.seq, r.qual) for r in good] == [(0, "@a", "AC", "II"), (1, "@c", "A", "I"), (2, "@d", "AC", "@I"), (3, "@e", "", "")]
    bad = fastq.broken_records(spark, str(p), split).orderBy("offset").collect()
    assert [(r.reason, r.text) for r in bad] == [("separator", "@b\nACG\nIII"), ("header", "noise\nmore"), ("truncated", "@f\nACGT\n+")]


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_blocks_of_bytes_change_nothing(monkeypatch, tmp_path, block):
    monkeypatch.setattr(fastq, "_BLOCK", block)
    rows = records(60)
    p = tmp_path / "a.fq"
    p.write_text("".join("\n".join(r) + "\n" for r in rows))
    for split in (50, 1 << 20):
        got = []
        for r in fastq._Reader({"path": str(p), "splitbytes": split}, False).partitions():
            for _, columns in fastq.fastq_batches(r):
                got += list(zip(*(c.to_pylist() for c in columns[:4])))
        assert got == rows


@pytest.mark.parametrize("split", [30, 1 << 20])
def test_fasta(spark, tmp_path, split):
    p = tmp_path / "a.fa"
    p.write_text(">one first record\nACGT\nAC\r\n>two\n>three x\n\nGG GG\nT\n")
    got = [tuple(r) for r in fastq.read_fasta(spark, str(p), split_bytes=split).orderBy("gid").collect()]
    assert got == [(0, "one", "first record", "ACGTAC"), (1, "two", None, ""), (2, "three", "x", "GG GGT")]
    assert fastq.read_fasta(spark, str(p), least=6).count() == 2


def test_pairs_interleaved_and_sinks(spark, tmp_path):
    a, b = records(40, 1), records(40, 2)
    for name, rows in (("1.fq", a), ("2.fq", b), ("i.fq", [x for ab in zip(a, b) for x in ab])):
        (tmp_path / name).write_text("".join("\n".join(r) + "\n" for r in rows))
    pairs = fastq.read_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), 200)
    got = [tuple(r) for r in pairs.orderBy("read_id").collect()]
    assert got == [(i, x[0], x[1], x[3], y[1], y[3]) for i, (x, y) in enumerate(zip(a, b))]
    assert [tuple(r) for r in fastq.read_interleaved(spark, str(tmp_path / "i.fq"), 100).orderBy("read_id").collect()] == got
    sinks.write_interleaved(pairs, str(tmp_path / "out_i"), gzip=True)
    back = fastq.read_interleaved(spark, str(tmp_path / "out_i"))
    assert [tuple(r) for r in back.orderBy("read_id").collect()] == got
    sinks.write_pairs(pairs, str(tmp_path / "o1"), str(tmp_path / "o2"))
    assert fastq.read_pairs(spark, str(tmp_path / "o1"), str(tmp_path / "o2")).count() == 40
    with pytest.raises(Exception):
        sinks.write_pairs(pairs, str(tmp_path / "o1"), str(tmp_path / "o2"))
    sinks.write_pairs(pairs, str(tmp_path / "o1"), str(tmp_path / "o2"), keep_order=False, overwrite=True)


def test_adapter_file(spark, tmp_path):
    (tmp_path / "ad").write_text("b TTTT\na\tACGT\n\nc GGGG")
    assert [tuple(r) for r in fastq.read_adapters(spark, str(tmp_path / "ad")).collect()] == [("a", "ACGT"), ("c", "GGGG"), ("b", "TTTT")]


def test_run_from_files(spark, tmp_path):
    rows = [(f"@r{i}", "ACGTTGCA" * 10, "+", "I" * 80) for i in range(20)] + [("@bad", "A" * 80, "+", "#" * 80), ("@short", "ACG", "+", "III")]
    (tmp_path / "in.fq").write_text("".join("\n".join(r) + "\n" for r in rows))
    o = parse(["-i", str(tmp_path / "in.fq"), "-o", str(tmp_path / "out"), "--trimFront1=2", "-5"])
    result = pipeline.run(spark, o)
    kept = fastq.read_fastq(spark, str(tmp_path / "out")).orderBy("read_id").collect()
    assert len(kept) == 20 and {r.name for r in kept} == {f"@r{i}" for i in range(20)}
    n = {r.code: r.reads for r in result.tables["filter"].collect()}
    assert sum(n.values()) == 22 and n[0] == 20
    text = sinks.summary_text(result.tables["before_totals"], result.tables["filter"])
    assert "reads 22" in text and "passed 20" in text
    sinks.save_snapshot(result.passed, str(tmp_path / "snap"))
    assert sinks.load_snapshot(spark, str(tmp_path / "snap")).count() == 20
    assert [sinks.name_prefix(x) for x in ("/a/b.x.fq.gz", "c.fasta", "d/")] == ["b.x", "c", "d"]
    assert "<table>" in sinks.summary_html({"filter": result.tables["filter"]})


@pytest.mark.parametrize("arguments", [["--nothing"], ["-i"], ["--compressLevel", "0"], ["--umiLen", "x"], ["-u", "--umiLoc", "nowhere"], ["-u", "--umiLoc", "read1"], ["-I", "b"], ["-i", "a", "-I", "b", "--interleavedIn"], ["-i", "a.gz", "-I", "b"], ["--TGS", "-i", "a", "-I", "b"], ["--trimFront1", "-3"], ["--pairmode", "XX"]])
def test_bad_options(arguments):
    with pytest.raises(OptionError):
        parse(arguments)


def test_options():
    o = parse(["-i", "a", "-I", "b", "--trimFront1", "3", "--trimFront2", "1", "-w", "8", "-g", "-a", "--notKeepOrder"])
    assert (o.front2, o.poly_g, o.trim_adapter, o.keep_order, o.paired) == (3, True, False, False, True)
    assert Options().checked() == Options()


def test_flags_that_act_or_are_refused(spark, tmp_path, data):
    for flag in ("--stdin", "--stdout"):
        with pytest.raises(OptionError):
            parse([flag])
    with pytest.raises(OptionError):
        parse(["--printORPSeqs"])
    o = parse(["--save-preprocessedreads-to", str(tmp_path / "reads"), f"--save-hashtables-to={tmp_path / 'sigs'}", "--coverage", "10"])
    from readloom.operators import correct, reads

    t = reads.single_reads(spark.read.parquet(f"{data}/reads_se.parquet"), "qual")
    first = sorted(map(tuple, correct.corrections(t, o).collect()))
    assert spark.read.parquet(str(tmp_path / "reads")).count() == t.count() and first
    again = parse(["--load-preprocessedreads-from", str(tmp_path / "reads"), "--load-hashtables-from", str(tmp_path / "sigs"), "--coverage", "10"])
    assert sorted(map(tuple, correct.corrections(t.limit(0), again).collect())) == first


def test_report_tells_what_it_leaves_out(spark):
    page = sinks.summary_html({"t": spark.range(30)}, 10)
    assert "The first 10 of 30 rows" in page and "The first" not in sinks.summary_html({"t": spark.range(10)}, 10)
    adapters = spark.createDataFrame([("ACGT", 3), ("GG", 9)], "adapter string, n bigint")
    rate, peak = spark.createDataFrame([(0.25,)], "rate double"), spark.createDataFrame([(150, 9)], "peak int, pairs bigint")
    text = sinks.summary_text(spark.createDataFrame([(5,)], "reads bigint"), None, rate, peak, adapters, most_adapters=1)
    assert text.splitlines() == ["reads 5", "duplication rate 0.25", "insert size peak 150", "adapter GG 9", "and 1 more adapters"]


def test_stages_are_deleted(spark):
    from pathlib import Path

    from readloom import common

    with common.stages(spark):
        common.written(spark.range(3), "x")
        path = common._WRITTEN[-1]
        assert Path(path).exists()
    assert not Path(path).exists() and path not in common._WRITTEN


@pytest.mark.parametrize("most", [0, 100])
def test_delivered_once(spark, most):
    from readloom import common

    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (3, "c"), (None, "x"), (None, "x"), (None, "y")]
    got = common.delivered_once(spark.createDataFrame(rows, "id bigint, t string"), "id", most).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, set(rows)))
    assert common.delivered_once(spark.createDataFrame([], "id bigint, t string"), "id").count() == 0
