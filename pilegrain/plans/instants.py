"""Query of problem 4: every written time of a photo as one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.functions.timestamps import written_times
from pilegrain.sources.tables import current_rows, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["taken_at", "exif_modified_at"]
    photos = current_rows(table(spark, sf_dir, "photos"), ["id"], "scanned_at", [*fields, "tz_name"])
    return written_times(photos.withColumnRenamed("id", "photo_id"), fields).select(F.col("photo_id"), F.col("field"), F.col("utc_us"))
