import re

import pytest

from readloom.operators import badrows
from readloom.operators.badrows import BadRecord, parse_record, split_csv


@pytest.mark.parametrize(
    "fmt,payload,reason",
    [
        ("csv", "@a,ACG,III", None),
        ("csv", '"@a, b ""c""",ACG,"I""I"\r\n', None),
        ("csv", '"@a\nb",ACG,III', None),
        ("csv", '@a"b,ACG,III', "quoting"),
        ("csv", '"@a"b,ACG,III', "quoting"),
        ("csv", '"@a,ACG,III', "quoting"),
        ("csv", "@a\nb,ACG,III", "quoting"),
        ("csv", '@a,"ACG","I"I"', "quoting"),
        ("csv", "@a,ACG", "columns"),
        ("csv", "@a,ACG,III,", "columns"),
        ("csv", "", "columns"),
        ("csv", None, "columns"),
        ("csv", '@a,ACG, "III"', "quoting"),
        ("tsv", "@a\tACG\tIII\n", None),
        ("tsv", "@a ACG III", "columns"),
        ("tsv", '@a\tACG\t"II', None),
        ("fastq", "@a\nACG\n+\nIII\n", None),
        ("fastq", "@a\r\nACG\r\n+\r\nIII\r\n", None),
        ("fastq", "@a\nACG\n-\nIII", "separator"),
        ("fastq", "@a\nACG\n+", "columns"),
        ("fastq", "@a\n\n+\n\n", "seq"),
        ("fastq", "@ a\nACG\n+\nIII", "header"),
        ("fastq", "@\nACG\n+\nIII", "header"),
        ("fastq", "a\nACG\n+\nIII", "header"),
        ("fastq", "@a\nAXG\n+\nIII", "seq"),
        ("fastq", "@a\nACG\n+\nI I", "qual"),
        ("fastq", "@a\nACG\n+\nII", "length"),
        ("fastq", "@a\nACG\n+\n\n\n", "columns"),
        (None, "@a,ACG,III", "columns"),
    ],
)
def test_reasons(fmt, payload, reason):
    if reason is None:
        parse_record(fmt, payload)
    else:
        with pytest.raises(BadRecord) as e:
            parse_record(fmt, payload)
        assert e.value.args[0] == reason


def test_csv_against_grammar():
    import random

    r = random.Random(1)
    field = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
    good = re.compile(rf"{field}(?:,{field})*", re.S)
    seen = 0
    for _ in range(20_000):
        text = "".join(r.choice('"",,ab\n\r x') for _ in range(r.randrange(9)))
        try:
            got = split_csv(text)
        except BadRecord:
            got = None
        assert (got is not None) == bool(good.fullmatch(text)), repr(text)
        if got is not None:
            seen += 1
            parts = re.findall(rf"(?:^|,)({field})", "," + text)
            assert len(got) == len(re.findall(rf",{field}", "," + text)) or parts
    assert seen > 1000


def test_edges(spark):
    schema = "raw_id bigint, fmt string, payload string, name string, reason int"
    rows = [(1, "csv", None, "x", 1), (1, "csv", None, "x", 1), (2, "tsv", "@a\tACG\tIII", "x", 2), (3, None, "a", None, None), (4, "fastq", "@" + "a" * 500_000 + "\n" + "A" * 500_000 + "\n+\n" + "I" * 500_000, None, None), (None, "csv", "", None, None)]
    parsed = badrows.parse_records(spark.createDataFrame(rows, schema))
    assert {(r.raw_id, r.reason) for r in parsed.collect()} == {(1, "columns"), (2, None), (3, "columns"), (4, None), (None, "columns")}
    assert sorted((r.raw_id or 0, r.reason, r.payload) for r in badrows.bad_records(parsed).collect()) == [(0, "columns", ""), (1, "columns", None), (3, "columns", "a")]
    assert badrows.good_records(parsed).count() == 2
    assert badrows.good_records(parsed).filter("raw_id = 4").select("seq").first().seq == "A" * 500_000
    assert badrows.parse_records(spark.createDataFrame([], schema)).count() == 0
