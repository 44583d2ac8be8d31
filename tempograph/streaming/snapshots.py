"""Degrees of windowed snapshots of a stream.

An edge event falls into the tumbling window of its time; late events count until the watermark has passed their
window. The state is one row a (window, node, neighbour) that is still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import new_path


def snapshot_edges(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, src, dst), each pair once a window, of events(ts, src, dst); works on streams and on tables alike."""
    binned = events.withWatermark("ts", late).withColumn("start", F.window("ts", every)["start"])
    return binned.select("start", "ts", "src", "dst").dropDuplicates(["start", "src", "dst"]) if not events.isStreaming else binned.dropDuplicatesWithinWatermark(["start", "src", "dst"])


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, in the order of their arrival; the table may be one file, which a stream only reads as a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_snapshot_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, src, events): a stream's events a window and source, run until the present input is used up.

    Each micro-batch adds its counts to a table in the shared folder under its batch's number, so that a repeated
    batch replaces its own; the table is summed up when it is read.
    """
    spark = events.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")

    def add(batch: DataFrame, number: int) -> None:
        counted = batch.withColumn("start", F.window("ts", every)["start"]).groupBy("start", "src").agg(F.count("*").alias("events"))
        counted.write.mode("overwrite").parquet(f"{out}/batch={number}")

    events.withWatermark("ts", late).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("start timestamp, src long, events long").parquet(f"{out}/batch=*")
    return found.groupBy("start", "src").agg(F.sum("events").alias("events"))
