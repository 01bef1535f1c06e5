"""Incremental ingest into the store (an extension: the batch loads of the store remain the reference semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flankline.sources import store


def ingest(spark: SparkSession, incoming: str, schema: str, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append new Parquet files of feature or protein rows to the store, each file once; ends when all are in. A batch that runs
    again has the mark of its first commit and adds nothing; ``store.compact`` brings what many batches leave together."""

    def put(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, root, table, f"{checkpoint}#{batch_id}")

    return spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per key and tumbling window with a watermark; the same plan serves batch and stream."""
    from pyspark.sql import functions as F

    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
