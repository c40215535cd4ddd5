"""Frozen label files, split files, exports and the table of experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of labels.
IDENTITY, CONTAMINANT = ["person"], ["not_of_interest", "non_face"]
GOLD = "face_id long, label string, person_id string, taken_at string, kind string, size string, pose string, era string, quality string, filtered string, `group` string"


def read_gold(spark: SparkSession, path: str, schema: str = GOLD) -> DataFrame:
    """A label file with role: identity, contaminant or excluded. An identity without a person is excluded."""
    rows = spark.read.csv(path, header=True, schema=schema)
    named = F.col("label").isin(IDENTITY) & (F.coalesce(F.trim("person_id"), F.lit("")) != "")
    return rows.withColumn("role", F.when(named, "identity").when(F.col("label").isin(CONTAMINANT), "contaminant").otherwise("excluded"))


def write_split(split: DataFrame, path: str) -> None:
    """One small CSV file, sorted by person: a split has one row per person labelled by hand."""
    split.select("person", "side").orderBy("person").coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="person string, side string")


def only_side(rows: DataFrame, split: DataFrame, side: str) -> DataFrame:
    """Identity rows of the people of one side; people that the split does not know drop out."""
    return rows.join(split.where(F.col("side") == side).select("person"), "person", "left_semi")


def export_gold(faces: DataFrame, photos: DataFrame, gold: DataFrame, strata: DataFrame) -> DataFrame:
    """The frozen export: labels with geometry, photo and strata, and the number of faces on the photo; scores rounded."""
    count = faces.groupBy("photo_id").agg(F.count("*").alias("faces_on_photo"))
    joined = gold.join(faces, "face_id").join(photos, "photo_id").join(count, "photo_id").join(strata, "face_id")
    return joined.select(*gold.columns, "photo_id", "taken_at", "kind", "faces_on_photo", *[F.round(c, 4).alias(c) for c in ("det_score", "interocular_px", "blur") if c in faces.columns], *[c for c in strata.columns if c != "face_id"])


def append_result(row: DataFrame, path: str) -> None:
    """Add a row of results; columns may come and go between runs."""
    row.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str, scores: tuple[str, ...] = ("bcubed_f1",)) -> tuple[DataFrame, DataFrame]:
    """(sound, suspect) rows: a row is sound when its scores are numbers from 0 to 1."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    sound = F.lit(True)
    for c in scores:
        sound = sound & F.coalesce(F.col(c).cast("string").try_cast("double").between(0, 1), F.lit(False))
    marked = rows.withColumn("_sound", sound)
    return marked.where("_sound").drop("_sound"), marked.where("NOT _sound").drop("_sound")


def best_results(sound: DataFrame, score: str = "bcubed_f1", most: int = 20) -> DataFrame:
    return sound.orderBy(F.desc(score)).limit(most)


def last_seconds(sound: DataFrame, algorithm: str) -> DataFrame:
    """One row: the newest run time of an algorithm."""
    return sound.where(F.col("algorithm") == algorithm).agg(F.max_by("seconds", "run_at").alias("seconds"))
