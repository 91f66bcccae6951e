"""Splitting oversized items at natural boundaries by bounded-quantifier regular expressions.

The pattern's alternatives are ordered by the strength of their boundary; each consumes as much as the limit
allows, the last one plain characters. The lengths of what it extracts give the cuts, and looking back from
each cut by the overlap gives what consecutive pieces share. All of it is SQL string and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: gids that are joined and summed as one block.
BLOCK = 1024
#: Least bases of a segment, the unit that one row cuts; 16 times max_bases if that is more.
SEGMENT = 1 << 18
#: Cuts that a segment has at most, but for what 16 times max_bases need.
CUTS = 1 << 12
#: Letters of a record before its last one.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def record_pattern(limit: Column) -> Column:
    """Up to the last end of a record within the limit, else the limit's letters. A record ends in lower case."""
    return F.concat(F.lit("[A-Za-z]{0,"), (limit - 1).cast("string"), F.lit("}[a-z]|[A-Za-z]{1,"), limit.cast("string"), F.lit("}"))


def text_pattern(limit: int) -> str:
    """A rest within the limit is taken whole, then the boundaries in order, then characters."""
    least = max(1, limit // 2)
    parts = [f"(?:.{{1,{limit}}}\\z)"]
    for end, width in (("\\n\\n", 2), ("\\n", 1), ("[.!?;:]\\s", 2), ("\\s", 1)):
        if limit - width >= least:
            parts.append(f"(?:.{{{least},{limit - width}}}{end})")
    return "(?s)" + "|".join([*parts, f"(?:.{{1,{limit}}})"])


def running_totals(column: str) -> Column:
    """Array of the totals up to and with each number of an array column. Numbers are summed in blocks of the root of their count, since an array
    that grows by one number is copied each time: no array that grows here is longer than the root."""
    numbers = F.col(column)
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers)))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(numbers) - 1) / side).cast("int")), lambda i: F.slice(numbers, i * side + 1, side))
    empty = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("upto"))

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["upto"], F.array(acc["sum"] + n)).alias("upto"))

    inner = F.transform(blocks, lambda block: F.aggregate(block, empty, step))
    begun = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before"))

    def follow(acc: Column, block: Column) -> Column:
        return F.struct((acc["sum"] + block["sum"]).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))

    # All blocks before: the sums are few, but their array is made once, outside the lambda over the blocks.
    return F.transform(
        F.array(inner),
        lambda all_blocks: F.flatten(F.zip_with(all_blocks, F.aggregate(all_blocks, begun, follow)["before"], lambda block, before: F.transform(block["upto"], lambda x: x + before))),
    )[0]


def split_texts(df: DataFrame, id_col: str, text: str, limit: int, overlap: int = 0) -> DataFrame:
    """Pieces of every text: id, piece (from 1), start, text; at most `limit` characters with the overlap.

    Cut at the end of a paragraph, line, sentence or word if one lies in the second half of what fits, else
    anywhere. Each row is cut by itself, in time that grows with its length; other columns are ignored; null and empty
    texts have no pieces and an empty table none. Surrogate pairs are never cut, since lengths are in characters.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    t = F.col("__t")
    first = F.regexp_extract(t, "^(?:" + text_pattern(limit).replace("(?s)", "(?s:", 1) + "))", 0)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__t")).filter(F.length("__t") > 0).withColumn("__first", first)
    rest = F.regexp_extract_all(F.substr(t, F.length("__first") + 1), F.lit(text_pattern(limit - overlap)), F.lit(0))
    rows = rows.select("__id", F.concat(F.array("__first"), rest).alias("__p"))
    rows = rows.withColumn("__n", F.transform("__p", lambda x: F.length(x))).withColumn("__ends", running_totals("__n"))
    # All pieces but the last have at least this many characters, so so many pieces hold the overlap.
    back = -(-overlap // max(1, (limit - overlap) // 2))
    pieces = F.col("__p")

    def before(i: Column) -> Column:
        return F.right(F.array_join(F.slice(pieces, F.greatest(F.lit(1), i + 1 - back), F.least(i, F.lit(back))), ""), F.lit(overlap))

    texts = F.transform(pieces, lambda x, i: F.when(i > 0, F.concat(before(i), x)).otherwise(x)) if overlap else pieces
    rows = rows.select("__id", F.posexplode(F.zip_with(texts, "__ends", lambda x, end: F.struct(x.alias("text"), end.alias("end")))).alias("__n", "__cut"))
    body = F.col("__cut.text")
    return rows.select(F.col("__id").alias(id_col), (F.col("__n") + 1).alias("piece"), (F.col("__cut.end") - F.length(body)).cast("int").alias("start"), body.alias("text"))


def whole_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk once with start and end; a null among start, end, nseqs follows from the other two."""
    start, end, n = F.col("chunk_start"), F.col("chunk_end"), F.col("nseqs")
    return (
        chunks.select("chunk_id", "file_no", F.coalesce(start, end - n + 1).alias("start"), F.coalesce(end, start + n - 1).alias("end"), F.col("max_bases").cast("bigint").alias("max_bases"), F.greatest(F.lit(0), F.coalesce(F.col("halo"), F.lit(0))).cast("bigint").alias("halo"))
        .filter("chunk_id IS NOT NULL AND start <= end AND max_bases > 0")
        .distinct()
    )


def letters(records: DataFrame) -> DataFrame:
    """file_no, gid and the letters of seq, as delivered."""
    return records.filter("gid IS NOT NULL").select("file_no", "gid", F.regexp_replace(F.coalesce(F.col("seq"), F.lit("")), "[^A-Za-z]", "").alias("bases"))


def chunk_records(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """(chunk, gid, n) of the records from start to end in the chunk's file, n bases each, joined by blocks of gids.

    Only numbers move here. However long a chunk is, its records meet it block by block, so no task takes a whole
    chunk or file.
    """
    block = lambda c: F.floor(c / BLOCK)
    kept = letters(records).select("file_no", "gid", F.length("bases").cast("bigint").alias("n")).distinct().withColumn("block", block(F.col("gid")))
    # A chunk is laid only over the gids that its file has.
    files = kept.groupBy("file_no").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"))
    laid = (
        whole_chunks(chunks)
        .join(files, "file_no")
        .filter((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))
        .withColumn("block", F.explode(F.sequence(block(F.greatest("start", "lo")), block(F.least("end", "hi")))))
        .drop("lo", "hi")
    )
    return laid.join(kept, ["file_no", "block"]).filter(F.col("gid").between(F.col("start"), F.col("end")))


def marked(row: Column) -> Column:
    """A record's letters in upper case, its last one in lower case."""
    text = row["piece"]
    return F.when(row["last"], F.concat(F.upper(F.substr(text, F.lit(1), F.length(text) - 1)), F.lower(F.right(text, F.lit(1))))).otherwise(F.upper(text))


def split_chunks(chunks: DataFrame, records: DataFrame, texts: bool = True) -> DataFrame:
    """Ordered pieces of every chunk: chunk_id, segment, piece, start, fresh, n_bases, first_gid, last_gid, bases.

    A piece holds at most max_bases bases: those from `fresh` on are new, those before it, from `start`, are the
    last `halo` bases of the piece before. Pieces are ordered by (segment, piece) or by start. They are cut between
    records where the record fits beside the halo; a halo that leaves no room for new bases is shortened to
    max_bases - 1. first_gid and last_gid are the records of the first new and the last base.

    Chunks and records count once however often delivered; chunks with two of start, end, nseqs null, a null id or
    file, or a max_bases that is null or below 1 have no pieces, nor have chunks without bases. Bases are the letters
    of seq; other columns are ignored. Empty tables give an empty result.

    Without `texts` the pieces come without their bases, so that only the marks of the records move.

    Time grows with the bases that come out: texts are cut by one pass of the expression, offsets are running totals, and
    slices don't walk the text. A chunk of any size is cut in segments by its running total of bases, found in two levels (sums of blocks of
    gids, then inside a block), so no task holds a chunk. All segments but the last hold at least 14 * max_bases.
    """
    rows = chunk_records(chunks, records).select("chunk_id", "file_no", "block", "gid", "n", "max_bases", "halo")
    sums = rows.groupBy("chunk_id", "block").agg(F.sum("n").alias("in_block"))
    before = F.sum("in_block").over(W.partitionBy("chunk_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("chunk_id", "block", F.coalesce(before, F.lit(0)).alias("before_block"))
    inside = F.sum("n").over(W.partitionBy("chunk_id", "block").orderBy("gid").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(sums, ["chunk_id", "block"]).withColumn("before", F.col("before_block") + F.coalesce(inside, F.lit(0))).filter("n > 0")
    # The bases move twice: to their place here, where a record delivered again is dropped, and to their segment.
    rows = rows.join(letters(records).dropDuplicates(["file_no", "gid"]), ["file_no", "gid"])
    # A halo that leaves little room makes many pieces of a segment, so segments are shorter then.
    fits = F.greatest(F.lit(1), F.col("max_bases") - F.col("halo")) * CUTS
    size = F.greatest(F.least(F.lit(SEGMENT), fits), 16 * F.col("max_bases"))
    # Records longer than an eighth of a segment go on in several rows; only the last ends a record.
    step = (size / 8).cast("int")
    rows = rows.withColumn("size", size).withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / step).cast("int"))))
    at = F.col("part") * step
    piece = F.substr(F.col("bases"), at + 1, step)
    last = at + F.length("piece") >= F.col("n")
    rows = rows.withColumn("piece", piece).withColumn("at", F.col("before") + at)
    segments = (
        rows.withColumn("last", last)
        .groupBy("chunk_id", F.floor(F.col("at") / F.col("size")).alias("segment"), "max_bases", "halo")
        .agg(F.min("at").alias("origin"), F.array_sort(F.collect_list(F.struct("at", "gid", "piece", "last"))).alias("r"))
        .select("chunk_id", "segment", "max_bases", F.least("halo", F.col("max_bases") - 1).alias("halo"), "origin", "r")
        # The records in order: those that end in the segment and the one that goes on.
        .withColumn("gids", F.concat(F.transform(F.filter("r", lambda x: x["last"]), lambda x: x["gid"]), F.array(F.element_at("r", -1)["gid"])))
        .select("chunk_id", "segment", "max_bases", "halo", "origin", "gids", *([F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("bases")] if texts else []), F.array_join(F.transform("r", marked), "").alias("marks"))
    )
    tail = F.right("bases", F.col("halo").cast("int")).alias("tail") if texts else F.lit("").alias("tail")
    tails = segments.select("chunk_id", (F.col("segment") + 1).alias("segment"), F.least(F.length("marks"), F.col("halo")).cast("int").alias("lead"), tail)
    whole = segments.join(tails, ["chunk_id", "segment"], "left").withColumns({"tail": F.coalesce("tail", F.lit("")), "lead": F.coalesce("lead", F.lit(0))})
    room = F.col("max_bases") - F.col("halo")
    limit = F.when(F.col("segment") == 0, F.col("max_bases")).otherwise(room)
    first = F.element_at(F.regexp_extract_all(F.substr(F.col("marks"), F.lit(1), limit.cast("int")), record_pattern(limit), F.lit(0)), 1)
    whole = whole.withColumn("first", first)
    rest = F.regexp_extract_all(F.substr(F.col("marks"), F.length("first") + 1), record_pattern(room), F.lit(0))
    whole = whole.withColumn("p", F.concat(F.array("first"), rest))
    # How many records have ended with each piece tells which record its last base belongs to.
    whole = whole.withColumns({"lengths": F.transform("p", lambda x: F.length(x)), "lasts": F.transform("p", lambda x: F.length(F.translate(x, UPPER, "")))})
    ends, ended = running_totals("lengths"), running_totals("lasts")
    # Of letters every one is a byte, and bytes are sliced without walking through the text before.
    text = [F.encode(F.concat("tail", "bases"), "US-ASCII").alias("text")] if texts else []
    whole = whole.select("chunk_id", "segment", "origin", "halo", "gids", *text, "lead", "p", ends.alias("ends"), ended.alias("ended"))

    def cut(i: Column) -> Column:
        fresh = F.when(i > 0, F.col("ends")[i - 1]).otherwise(F.lit(0))
        begun = F.when(i > 0, F.col("ended")[i - 1]).otherwise(F.lit(0))
        start = F.greatest(-F.col("lead"), fresh - F.col("halo"))
        end = F.col("ends")[i]
        # A piece that ends with a record ends in that record, another one in the record that goes on.
        inside = F.col("ended")[i] - F.when(F.col("p")[i].rlike("[a-z]$"), 1).otherwise(0)
        return F.struct(
            start.alias("start"),
            fresh.alias("fresh"),
            (end - start).alias("n_bases"),
            F.col("gids")[begun.cast("int")].alias("first_gid"),
            F.col("gids")[inside.cast("int")].alias("last_gid"),
            *([F.decode(F.substring(F.col("text"), (F.col("lead") + start + 1).cast("int"), (end - start).cast("int")), "US-ASCII").alias("bases")] if texts else []),
        )

    cuts = F.transform(F.sequence(F.lit(0), F.size("p") - 1), cut)
    out = whole.select("chunk_id", "segment", "origin", F.posexplode(cuts).alias("piece", "cut"))
    return out.select(
        "chunk_id",
        "segment",
        "piece",
        (F.col("origin") + F.col("cut.start")).alias("start"),
        (F.col("origin") + F.col("cut.fresh")).alias("fresh"),
        F.col("cut.n_bases").cast("int").alias("n_bases"),
        "cut.first_gid",
        "cut.last_gid",
        *(["cut.bases"] if texts else []),
    )


def oversized_chunks(pieces: DataFrame) -> DataFrame:
    """Chunks of more than one piece, with the record that no longer fits into the first: chunk_id, gid.

    The first segment holds more than max_bases wherever the chunk does, so its second piece begins there.
    """
    return pieces.filter("segment = 0 AND piece = 1").select("chunk_id", F.col("first_gid").alias("gid"))
