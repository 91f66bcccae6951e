"""Mixing sources to target shares of tokens by Pareto order sampling.

The mix is as large as the target shares and repeat limits allow. A source whose target is r times its own
tokens gives floor(r) certain copies of each document; the rest, a share of its tokens, is a sample without replacement in
which every document has its own inclusion odds: lambda = min(1, c * weight), the weight being the document's size or a
given column and c such that the expected tokens are those wanted. Documents are ranked by random odds U / (1 - U) over
inclusion odds lambda / (1 - lambda) and taken from the lowest rank until the tokens are reached; in place of the document
that would pass them the one that comes nearest in size is taken. U is a hash of the document's id, so a task that
runs again after a loss makes the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.common import broadcast_if_small, materialize, written
from readloom.llm.tokens import token_counts

#: Ranks are compared in this many bins per source first; only the bin in which a source is cut is sorted.
BINS = 1 << 14
#: Weights are summed in so many bins per doubling to find c; one bin's weights differ by 4 %.
WEIGHT_BINS = 16
#: Sources that are broadcast at most; more of them are joined by shuffling.
BROADCAST_SOURCES = 100_000

_RANKED = ("source", "doc_id", "tokens", "rank", "bin")


def normal_source(col: str) -> Column:
    return F.lower(F.trim(F.col(col)))


def inclusion(pool: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, c): inclusion odds min(1, c * weight) of the pool's documents (source, tokens, weight) make up the wanted tokens.

    The heaviest documents are certain. Going down by bins of weight, the first bin whose weights stay below 1 with the c
    that the remaining tokens need ends the certain ones. Sums of bins only: some hundred rows a source.
    """
    bins = pool.groupBy("source", F.floor(F.log2("weight") * WEIGHT_BINS).alias("b")).agg(
        F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("tw"), F.max("weight").alias("most")
    )
    down = W.partitionBy("source").orderBy(F.desc("b"))
    up = W.partitionBy("source").orderBy("b")
    sums = bins.withColumns({"above": F.sum("t").over(down) - F.col("t"), "below": F.sum("tw").over(up)}).join(wanted, "source")
    c = (F.col("wanted") - F.col("above")) / F.col("below")
    fits = sums.withColumn("c", c).filter((F.col("c") > 0) & (F.col("c") * F.col("most") <= 1))
    return fits.groupBy("source").agg(F.max_by("c", "b").alias("c"))


class Mix:
    """Selection and report of a mix.

    documents need `doc_id`, `text`, `source` and the column `weight` names, if any; weights need `source`,
    `target_share`, `max_repeats`. Sources are compared without case and outer spaces; of several rows of a source the
    greatest share and limit count. Repeated documents count once; documents of a null source or one without target are not
    taken; null or empty texts have no tokens and are taken only in certain copies, as are documents whose weight is
    null or not positive. Weights of sources whose share or limit is null or not positive are left out; shares are divided by
    their sum. A source without any tokens can't reach its share; the others keep theirs in proportion. Empty inputs give
    empty results.

    A document's own odds are in proportion to its size, unless `weight` names a column. One document of each source, the
    last one, is chosen by size, so that the share differs from its target by less than one document.
    """

    def __init__(self, docs: DataFrame, weights: DataFrame, seed: int = 0, vocabulary: str | None = None, size: int | None = None, weight: str | None = None) -> None:
        w = weights.select(normal_source("source").alias("source"), F.col("target_share").cast("double").alias("target"), F.col("max_repeats").cast("int").alias("most"))
        self.targets = w.filter("source IS NOT NULL AND target > 0 AND most > 0").groupBy("source").agg(F.max("target").alias("target"), F.max("most").alias("most"))
        own = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
        named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_source("source").alias("source"), own.alias("weight"), "text")
        sized = token_counts(named, ["doc_id", "source", "weight"], vocabulary=vocabulary).distinct()
        self.sized = written(sized if weight else sized.withColumn("weight", F.col("tokens").cast("double")), "sized")
        have = self.sized.groupBy("source").agg(F.sum("tokens").alias("have")).filter("have > 0")
        able = materialize(self.targets.join(have, "source"))  # a row per source
        whole = able.agg(F.sum("target")).first()[0] or 1.0
        limit = able.agg(F.min(F.col("have") * F.col("most") * whole / F.col("target"))).first()[0] or 0.0
        self.tokens = min(limit, size) if size else limit
        r = F.least(F.col("most").cast("double"), F.col("target") / whole * self.tokens / F.col("have"))
        r = F.when(F.abs(r - F.round(r)) < 1e-9, F.round(r)).otherwise(r)
        plan = able.withColumn("r", r).withColumn("certain", F.floor("r").cast("int"))
        plan = plan.select("source", "certain", F.round((F.col("r") - F.col("certain")) * F.col("have")).cast("bigint").alias("wanted"))
        self.plan = broadcast_if_small(plan, able.count(), BROADCAST_SOURCES)
        self.few = able.count() <= BROADCAST_SOURCES
        self.seed = seed

    def _small(self, rows: DataFrame) -> DataFrame:
        """Rows per source, broadcast if the sources are few."""
        return F.broadcast(rows) if self.few else rows

    def odds(self) -> DataFrame:
        """doc_id, source, tokens, certain, lambda: whole copies and inclusion odds of one more, for every document of a source
        with a target."""
        planned = self.sized.join(self.plan, "source")
        pool = planned.filter((F.col("wanted") > 0) & (F.col("tokens") > 0) & (F.col("weight") > 0))
        c = materialize(inclusion(pool, self.plan.select("source", "wanted")))
        both = planned.join(self._small(c), "source", "left")
        sampled = (F.col("wanted") > 0) & (F.col("tokens") > 0) & (F.col("weight") > 0)
        # Without a c all weighed documents are needed.
        odds = F.when(sampled, F.coalesce(F.least(F.lit(1.0), F.col("c") * F.col("weight")), F.lit(1.0))).otherwise(F.lit(0.0))
        return both.select("doc_id", "source", "tokens", "certain", odds.alias("lambda"))

    def selection(self) -> DataFrame:
        """doc_id, source, tokens, copies for every document taken at least once."""
        u = (F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        rank = F.when(F.col("lambda") < 1, (F.col("u") / (1 - F.col("u"))) / (F.col("lambda") / (1 - F.col("lambda")))).otherwise(F.lit(0.0))
        ranked = self.odds().withColumn("u", u).withColumn("rank", F.when(F.col("lambda") > 0, rank))
        # rank / (1 + rank) lies in [0, 1) and keeps the order. Numbers only, written once: what follows reads them several times.
        ranked = written(ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")).drop("u", "lambda"), "ranked")
        pool = ranked.filter(F.col("rank").isNotNull()).select(*_RANKED)
        # Sums of bins find the bin in which a source is cut; at most BINS rows a source.
        running = W.partitionBy("source").orderBy("bin")
        bins = pool.groupBy("source", "bin").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(running))
        crossed = bins.join(self.plan.select("source", "wanted"), "source").filter("upto > wanted")
        cut = self._small(materialize(crossed.groupBy("source", "wanted").agg(F.min("bin").alias("cut"), F.min(F.col("upto") - F.col("t")).alias("below"))))
        marked = pool.join(cut, "source", "left")
        # Only the bin of the cut is sorted.
        upto = F.sum("tokens").over(W.partitionBy("source").orderBy("rank", "doc_id")) + F.col("below")
        edge = written(marked.filter(F.col("bin") == F.col("cut")).withColumn("upto", upto), "edge")
        first = marked.filter(F.col("cut").isNull() | (F.col("bin") < F.col("cut"))).select("doc_id", "source", "tokens")
        fits = edge.filter("upto <= wanted")
        reached = self._small(edge.groupBy("source", "wanted").agg(F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto")).otherwise(F.col("below"))).alias("reached")))
        later = marked.filter("bin > cut").select(*_RANKED).unionByName(edge.filter("upto > wanted").select(*_RANKED)).join(reached, "source")
        missing = F.col("wanted") - F.col("reached")
        miss = F.abs(F.col("tokens") - missing)
        last = later.filter(miss < missing).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "doc_id", "tokens")).alias("x"))
        taken = [d.select("doc_id", "source", "tokens") for d in (first, fits, last.select("x.doc_id", "source", "x.tokens"))]
        sampled = taken[0].unionByName(taken[1]).unionByName(taken[2]).withColumn("copies", F.lit(1))
        certain = ranked.filter(F.col("certain") > 0).select("doc_id", "source", "tokens", F.col("certain").alias("copies"))
        return certain.unionByName(sampled).groupBy("doc_id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies"))

    def report(self, selection: DataFrame | None = None) -> DataFrame:
        """Per source with a target: target_share, max_repeats, documents, tokens, most_copies and the share reached."""
        taken = (selection if selection is not None else self.selection()).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
        all_tokens = F.sum("tokens").over(W.partitionBy())  # one row per source
        full = self.targets.join(taken, "source", "left").select("source", F.col("target").alias("target_share"), F.col("most").alias("max_repeats"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_copies")))
        return full.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0)))


def mix_documents(docs: DataFrame, weights: DataFrame, seed: int = 0, vocabulary: str | None = None) -> Mix:
    return Mix(docs, weights, seed, vocabulary)
