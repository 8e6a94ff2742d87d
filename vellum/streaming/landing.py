"""Near-real-time landing: new NDJSON files as a stream, repeated resources dropped, each batch gated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """resource fields and seen_at of every line of new files in path."""
    lines = spark.readStream.option("pathGlobFilter", "*.ndjson").text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r"), F.current_timestamp().alias("seen_at")).select("r.*", "seen_at")


def deduplicated(stream: DataFrame, keys: list[str], time: str = "seen_at", within: str = "1 hour") -> DataFrame:
    """The first row of each key within a time span; state older than that is dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def gated_sink(stream: DataFrame, gate: Callable[[DataFrame], DataFrame], good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Appends batches without failures to good, and others to bad; runs what is there and stops."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        target = bad if gate(batch).limit(1).count() else good
        batch.write.mode("append").parquet(target)
        batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
