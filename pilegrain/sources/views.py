"""Current rows of the domain tables, and the SQL that states the same for checks.

Every table keeps repeated and superseded rows; these views resolve them once so that operators
see one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.operators import vectors
from pilegrain.sources.tables import current_rows, table

PHOTO = ["path", "rel_path", "size_bytes", "mtime", "quick_hash", "kind", "width", "height", "image_format", "taken_at", "taken_at_source", "exif_modified_at", "camera_make", "camera_model", "gps_lat", "gps_lon", "duplicate_of"]
FACE = ["photo_id", "face_index", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "landmarks", "det_score", "interocular_px", "yaw_deg", "roll_deg", "blur", "dark_fraction", "bright_fraction"]


def photos(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "photos"), ["id"], "scanned_at", list(keep or PHOTO))


def faces(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "faces"), ["id"], "created_at", list(keep or FACE))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, label, person_id, occlusion): the current label; person_id trimmed, blank is null."""
    rows = current_rows(table(spark, sf_dir, "gold_labels"), ["face_id"], "labelled_at", ["label", "person_id", "occlusion"])
    return rows.withColumn("person_id", F.nullif(F.trim("person_id"), F.lit("")))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, cluster_id, det_score, day) of the sampling pool; no cluster is -1, a day is ten characters or undated."""
    rows = current_rows(table(spark, sf_dir, "candidates"), ["face_id"], "created_at", ["cluster_id", "det_score", "day"])
    bare = F.lower(F.trim("day"))
    day = F.when(F.col("day").isNull() | bare.isin("", "undated"), F.lit("undated")).otherwise(F.substring(F.trim("day"), 1, 10))
    return rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("long"))).withColumn("day", day)


def face_embeddings(spark: SparkSession, sf_dir: str, dim: int = 256) -> DataFrame:
    """(id, v): vectors as stored, of the model with the most faces, by the current row of each face where it is usable."""
    rows = table(spark, sf_dir, "face_embeddings")
    model = rows.where("model IS NOT NULL").groupBy("model").agg(F.countDistinct("face_id").alias("faces")).orderBy(F.desc("faces"), "model").first()
    now = current_rows(rows.where(F.col("model") == (model["model"] if model else "")), ["face_id"], "created_at", ["embedding"])
    return now.where(vectors.usable(F.col("embedding"), dim)).select(F.col("face_id").alias("id"), F.col("embedding").alias("v"))


def face_vectors(spark: SparkSession, sf_dir: str, dim: int = 256) -> DataFrame:
    """(id, v): the same at length one."""
    return face_embeddings(spark, sf_dir, dim).select("id", vectors.unit(F.col("v")).alias("v"))


def decisions_of(labels: DataFrame) -> DataFrame:
    """(face_id, kind, person_id, at) of rows of gold_labels."""
    kind = F.when(F.col("label") == "person", "person").when(F.col("label").isin("not_of_interest", "non_face"), "junk").otherwise("unassigned")
    person = F.when(F.col("label") == "person", F.nullif(F.trim("person_id"), F.lit("")))
    return labels.where("face_id IS NOT NULL").select("face_id", kind.alias("kind"), person.alias("person_id"), F.col("labelled_at").alias("at"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling history as a decision log, copies once."""
    return decisions_of(table(spark, sf_dir, "gold_labels")).distinct()


def _current(name: str, key: str, latest: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {latest} DESC NULLS LAST) AS rn FROM {name} WHERE {key} IS NOT NULL) WHERE rn = 1"


SQL = {
    "cur_photos": _current("photos", "id", "scanned_at"),
    "cur_faces": _current("faces", "id", "created_at"),
    "cur_gold": f"SELECT face_id, label, nullif(trim(person_id, ' '), '') AS person_id, occlusion FROM ({_current('gold_labels', 'face_id', 'labelled_at')})",
    "cur_pool": f"SELECT face_id, coalesce(cluster_id, -1) AS cluster_id, det_score, CASE WHEN day IS NULL OR lower(trim(day)) IN ('', 'undated') THEN 'undated' ELSE substr(trim(day), 1, 10) END AS day FROM ({_current('candidates', 'face_id', 'created_at')})",
    "fv": "SELECT face_id AS id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT face_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY face_id ORDER BY created_at DESC NULLS LAST) AS r FROM face_embeddings WHERE face_id IS NOT NULL AND model = (SELECT model FROM face_embeddings WHERE model IS NOT NULL GROUP BY model ORDER BY count(DISTINCT face_id) DESC, model LIMIT 1)) WHERE r = 1 AND len(e) = 256 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0",
    "log": "SELECT DISTINCT face_id, CASE WHEN label = 'person' THEN 'person' WHEN label IN ('not_of_interest', 'non_face') THEN 'junk' ELSE 'unassigned' END AS kind, CASE WHEN label = 'person' THEN nullif(trim(person_id, ' '), '') END AS person_id, labelled_at AS at_time FROM gold_labels WHERE face_id IS NOT NULL",
}


def sql_with(*names: str, more: str = "") -> str:
    """A WITH clause of the views named, then of more."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " + more if more else "") + " "
