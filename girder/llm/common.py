"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and by bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Only where none is set and all runs on one machine (tests) a temporary one is made; on a cluster
    that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp("-checkpoint")
        sc.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once, as a table in the folder that the cluster shares; its lineage ends there.

    What is read again has the size of its files for an estimate. (Estimates of a checkpoint are those
    of the plan behind it, and multiply from round to round.)
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a small table that are broadcast, and the parts that a key is dealt in where there are more.
MOST_BROADCAST = 50_000
DEALS = 64


def looked_up(rows: DataFrame, table: DataFrame, key: str, deal: Column, most: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each value of ``key`` at most; nulls match.

    The table is broadcast if it is known to have ``most`` rows at most, or is counted to have few.
    Else rows go by key and a part of ``deal``, a long, so that a common key is dealt over many tasks.
    """
    right = table.withColumnRenamed(key, "__of")
    match = F.col(key).eqNullSafe(F.col("__of"))
    if (table.count() if most is None else most) <= MOST_BROADCAST:
        return rows.join(F.broadcast(right), match, how).drop("__of")
    right = right.withColumn("__dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = rows.withColumn("__deal", F.pmod(deal, F.lit(DEALS)).cast("int"))
    return dealt.join(right, match & (F.col("__deal") == F.col("__dealt")), how).drop("__of", "__deal", "__dealt")


def places(values: DataFrame) -> DataFrame:
    """``(value, place)``: the distinct values of the one column, numbered from 0 in their order, null last.

    Values are dealt by ranges, numbered within a range, and a range begins where those before it end.
    """
    of = values.columns[0]
    dealt = saved(values.select(F.col(f"`{of}`").alias("value")).distinct().repartitionByRange(F.col("value").asc_nulls_last()).select("value", F.spark_partition_id().alias("range")))
    sizes = dealt.groupBy("range").count()  # one row for each partition
    before = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("value").asc_nulls_last())) - 1
    return dealt.withColumn("within", within).join(F.broadcast(before), "range").select("value", (F.col("before") + F.col("within")).cast("long").alias("place"))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function that applies ``fn`` to each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` and its texts, and the name the texts have there."""
    if text in keep:
        return docs.select(*keep), text
    return docs.select(*keep, F.col(text).alias("__text")), "__text"


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes, without decoding it."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def ddl(df: DataFrame, *more: str) -> str:
    """Schema of ``df``'s columns and those that ``more`` declares."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if it has fewer partitions than there are cores; only for small tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
