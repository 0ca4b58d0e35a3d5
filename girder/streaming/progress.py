"""Streams (X8, H13, B14, G10, W8): progress events and learning by micro-batches.

The counters that are kept are sums, so late or repeated files do no harm beyond what the
deduplication in a watermark lets through. Where the first or last one wins, ``ts`` decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import learning

EVENT = "type STRING, message STRING, percent DOUBLE"


def parsed(lines: DataFrame, prefix: str = "EVENT ") -> DataFrame:
    """Events from lines (value, ts) that begin with ``prefix``."""
    text = F.substring(F.col("value"), len(prefix) + 1, 1 << 30)
    return lines.where(F.col("value").startswith(prefix)).select("ts", F.from_json(text, EVENT).alias("e")).select("ts", "e.*").where("type is not null")


def throttled(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The last message of each second, in tumbling windows with a watermark."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 second"))
    return windows.agg(F.max_by("message", "ts").alias("message"), F.max("percent").alias("percent"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("second"), "message", "percent", "n")


def unseen(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Each document once, among those that arrive within the watermark."""
    return documents.withWatermark("ts", late).dropDuplicatesWithinWatermark(["document"])


def _merge(spark: SparkSession, path: str, new: DataFrame, batch: int) -> None:
    """Adds a batch's counts to a table of counts: a folder for each batch, so that a batch that runs
    again after a failure replaces its own folder and is counted once."""
    new.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def learn(pages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Terms of arriving pages (document, method, text), merged by batch below ``path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        named = batch.withColumnRenamed("document", "doc_id")
        _merge(spark, f"{path}/terms", learning.terms(named), batch_id)
        _merge(spark, f"{path}/verified", learning.verified_terms(named.where(F.col("method").isin(*learning.TRUSTED_METHODS))), batch_id)
        batch.unpersist()

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def learned(spark: SparkSession, path: str) -> DataFrame:
    """Counts over all batches."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy("term").agg(*(F.sum(c).alias(c) for c in rows.columns if c != "term"))


def log_corrections(pairs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only log of corrections."""
    return pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
