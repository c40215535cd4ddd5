"""Resumable batches as streams: new files go through a transformation once, and a log keeps a current table.

The library has no event-time logic; the streams are file sources read to the end and stopped
(available-now), so a checkpoint replaces the resume tables of a batch run. Deliveries may repeat,
so every write is by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pilegrain.operators.review import state


def run_new_files(spark: SparkSession, source: str, schema: StructType | str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Apply work to the files that no earlier run has seen and append the result; returns when all are done."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = work(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fold_log(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keep the latest decisions of each batch of new files under target/part=<batch>; folded gives the state.

    A batch costs its own rows, whatever the log has grown to, and one that runs again writes the same part. decide turns the rows of
    the files into decisions.
    """

    def step(batch: DataFrame, number: int) -> None:
        log = batch if decide is None else decide(batch)
        state(log.select("face_id", "kind", "person_id", "at")).write.mode("overwrite").parquet(f"{target}/part={number:09d}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def folded(spark: SparkSession, target: str) -> DataFrame:
    """(face_id, kind, person_id, at): the state of all parts. Parts may overlap: the latest decision is a maximum."""
    return state(spark.read.parquet(target).drop("part"))


def compacted(spark: SparkSession, target: str) -> str:
    """Write the state of all parts as one part, to a folder beside them, and give its name; it replaces the parts it was made of once they are removed, and until then they may stand together."""
    parts = sorted(r["part"] for r in spark.read.parquet(target).select("part").distinct().collect())
    to = f"{target}-compacted/part={parts[-1]:09d}"
    folded(spark, target).write.mode("overwrite").parquet(to)
    return to


def windowed_events(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and type of an event stream; events later than the watermark are left out. An extension: times without zone are taken as UTC."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    return timed.withWatermark("_at", late).groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
