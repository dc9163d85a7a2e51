"""Streams: files that arrive are extracted and upserted by the batch operators; windowed counts as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import extract, validate


def chunk_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def extract_stream(chunks: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Records of arriving chunks.  A batch writes under its own number, so a batch that is run again replaces what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        good, bad = validate.split_valid(extract.extract(extract.inputs(batch)))
        good.write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values by type and window; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
