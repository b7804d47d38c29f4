"""Click history kept up to date from a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a key and window; a window closes ``late`` after its end by event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"
    )


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of queries is answered by the batch operators; a batch
    that is run again overwrites its own folder, so answers appear once."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
