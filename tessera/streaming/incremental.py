"""Streams: incremental upserts into the index, first-come dedupe, run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.index import IndexTable


def chunk_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(stream: DataFrame, table: IndexTable, checkpoint: str, order: str | None = None):
    """Starts a query that upserts each micro-batch once: its id is in the manifest
    of the version that holds it. Of a key's rows in a batch the last by order stays."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = F.max_by(F.struct(*batch.columns), F.col(order or table.key)).alias("r")
        table.upsert(batch.groupBy(F.col(table.key).alias("_key")).agg(last).select("r.*"), f"{checkpoint}#{epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_come(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; its state is dropped after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_rates(stream: DataFrame, time: str, kind: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of each kind in tumbling windows; late ones are dropped after the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", kind, "n")
