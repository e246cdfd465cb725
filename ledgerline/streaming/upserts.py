"""Incremental forms of the batch operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.load import latest, upsert


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their sum by type and window; rows later than the watermark are left out, and state is freed after it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def stream_upsert(source: DataFrame, target: str, checkpoint: str, key: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Each micro-batch, its newest row of a key, goes into the table at target. A state is a folder named by its batch, so
    a batch that is run again after a failure writes the same state anew from the one before it."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, [F.col(c).desc() for c in order])
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state={batch_id - 1}")
        there = batch_id > 0 and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        state = upsert(spark.read.parquet(f"{target}/state={batch_id - 1}"), new, key) if there else new
        state.write.mode("overwrite").parquet(f"{target}/state={batch_id}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, target: str) -> DataFrame:
    """The table after the newest batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    states = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    last = max(int(s.getPath().getName().split("=")[1]) for s in states if s.getPath().getName().startswith("state="))
    return spark.read.parquet(f"{target}/state={last}")
