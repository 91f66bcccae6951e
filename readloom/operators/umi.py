"""Unique molecular identifiers: taken from the name's index or from the read, appended to the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATIONS = ("index1", "index2", "read1", "read2", "per_index", "per_read")


def first_index(name: str) -> Column:
    """After the last `:` that two or more characters follow, up to the first `+`; empty for short names."""
    rest = F.regexp_extract(name, r"^(?s:.*):(..+)$", 1)
    cut = F.regexp_extract(rest, r"^([^+]*)\+..", 1)
    has = rest.rlike(r"^[^+]*\+..")
    return F.when(F.length(name) < 5, F.lit("")).when(has, cut).otherwise(rest)


def last_index(name: str) -> Column:
    """After the last `:` or `+` that two or more characters follow; empty for short names."""
    return F.when(F.length(name) < 5, F.lit("")).otherwise(F.regexp_extract(name, r"^(?s:.*)[:+](..+)$", 1))


def tagged(name: str, umi: Column, prefix: str = "") -> Column:
    """`:umi` or `:prefix_umi` before the first space of the name."""
    tag = F.concat(F.lit(f":{prefix}_" if prefix else ":"), umi)
    return F.regexp_replace(F.col(name), r"^([^ ]*)", F.concat(F.lit("$1"), F.regexp_replace(tag, r"([\\$])", r"\\$1")))


def _cut(seq: str, qual: str, n: Column) -> tuple[Column, Column]:
    return F.substr(F.col(seq), n + 1), F.substr(F.col(qual), n + 1)


def add_umi(reads: DataFrame, location: str, length: int = 0, prefix: str = "", skip: int = 0) -> DataFrame:
    """Single reads (name, seq, qual) with the UMI in the name; index2 and read2 do nothing here."""
    if location not in LOCATIONS:
        raise ValueError(f"location must be one of {', '.join(LOCATIONS)}")
    if location in ("index2", "read2"):
        return reads
    size = F.length("seq")
    if location in ("index1", "per_index"):
        umi = first_index("name")
        always = location == "per_index"
        return reads.withColumn("__umi", umi).withColumn("name", F.when(F.lit(always) | (F.col("__umi") != ""), tagged("name", F.col("__umi"), prefix)).otherwise(F.col("name"))).drop("__umi")
    umi = F.substr(F.col("seq"), F.lit(1), F.lit(length))
    most = size - 1 if location == "read1" else size
    n = F.greatest(F.lit(0), F.least(most, F.length(umi) + skip))
    seq, qual = _cut("seq", "qual", n)
    always = location == "per_read"
    name = F.when(F.lit(always) | (umi != ""), tagged("name", umi, prefix)).otherwise(F.col("name"))
    return reads.withColumns({"name": name, "seq": seq, "qual": qual})


def add_umi_pairs(pairs: DataFrame, location: str, length: int = 0, prefix: str = "", skip: int = 0) -> DataFrame:
    """Pairs (name, s1, q1, s2, q2); both mates share the name and get the same tag."""
    if location not in LOCATIONS:
        raise ValueError(f"location must be one of {', '.join(LOCATIONS)}")
    piece = {m: F.substr(F.col(f"s{m}"), F.lit(1), F.lit(length)) for m in (1, 2)}
    umi = {
        "index1": first_index("name"),
        "index2": last_index("name"),
        "read1": piece[1],
        "read2": piece[2],
        "per_index": F.concat_ws("_", first_index("name"), last_index("name")),
        "per_read": F.concat_ws("_", piece[1], piece[2]),
    }[location]
    changed = {"name": F.when(F.lit(location.startswith("per_")) | (umi != ""), tagged("name", umi, prefix)).otherwise(F.col("name"))}
    for m in {"read1": (1,), "read2": (2,), "per_read": (1, 2)}.get(location, ()):
        n = F.greatest(F.lit(0), F.least(F.length(f"s{m}") - 1, F.length(piece[m]) + skip))
        changed[f"s{m}"], changed[f"q{m}"] = _cut(f"s{m}", f"q{m}", n)
    return pairs.withColumns(changed)
