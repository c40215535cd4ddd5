"""Queries that run as streams: the decision log folded from files, events in windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.plans import reviews
from pilegrain.session import ensure_checkpoint_dir
from pilegrain.sources import views
from pilegrain.sources.tables import table
from pilegrain.streaming import resume


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest decision of every face, from a stream over the label files that keeps its parts in the shared folder."""
    # As a pattern the path may be a single file or a folder of files.
    where = f"{ensure_checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "gold_labels").schema
    resume.fold_log(spark, f"{sf_dir}/gold_labels.parque[t]", schema, f"{where}/state", f"{where}/progress", views.decisions_of)
    return resume.folded(spark, f"{where}/state").select("face_id", "kind", "person_id")


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and type: the stream's plan over a finished table."""
    rows = resume.windowed_events(table(spark, sf_dir, "events"))
    return rows.select(F.unix_micros("start").alias("start_us"), "event_type", "events")


QUERIES = {"streamed_state": streamed_state, "events_by_hour": events_by_hour}
ORACLE = {
    "streamed_state": reviews.ORACLE["latest_decision"],
    "events_by_hour": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
