"""Incremental loads: a file stream whose micro-batches are upserted idempotently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from silverbarn.catalog import Catalog
from silverbarn.operators.upsert import keep_last


def upsert_stream(stream: DataFrame, catalog: Catalog, name: str, key: Sequence[str], sequence: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys, in the parts of the table they fall into; running it again gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        catalog.upsert(name, keep_last(batch, key, F.col(sequence)), key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: Sequence[str], time: str, late: str) -> DataFrame:
    """Repeated deliveries dropped within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def windowed(stream: DataFrame, time: str, late: str | None, window: str, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum and mean per tumbling window and key, emitted once the watermark has passed it.

    ``late`` None: the stream has its watermark already.
    """
    marked = stream if late is None else stream.withWatermark(time, late)
    return (
        marked.groupBy(F.window(time, window), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("window_start"), *keys, "n", "total", "mean")
    )


def parquet_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
