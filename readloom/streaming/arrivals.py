"""Reads as they arrive: each counted once, by windows of arrival time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.stats import bases_from, filter_code, gc_bases
from readloom.operators.reads import line, quality


def stream_reads(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def arrival_counts(reads: DataFrame, window: str = "1 hour", late: str = "10 days") -> DataFrame:
    """Per window of arrived_at: reads, bases, q30 and GC bases, reads that pass the filter.

    A read delivered again within the watermark counts once; later rows are dropped, as are rows without a time.
    State is bounded by the watermark: one key per read and one row per window.
    """
    rows = reads.filter("arrived_at IS NOT NULL").select("read_id", F.col("arrived_at").cast("timestamp").alias("arrived_at"), line("seq").alias("seq"), quality("qual", "seq").alias("qual"))
    once = rows.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["read_id"])
    return once.groupBy(F.window("arrived_at", window)).agg(
        F.count(F.lit(1)).alias("reads"),
        F.sum(F.length("seq")).alias("bases"),
        F.sum(bases_from("qual", 30)).alias("q30_bases"),
        F.sum(gc_bases("seq")).alias("gc_bases"),
        F.sum(F.when(filter_code("seq", "qual") == 0, 1).otherwise(0)).alias("passed"),
    )


def start(counts: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Into a memory table; available files only, then it ends."""
    writer = counts.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
