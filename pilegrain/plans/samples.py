"""Queries of the labelling sample: strata, ranks, caps, reserve, greedy choice, composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.operators import sampling
from pilegrain.session import cut
from pilegrain.sources import views
from pilegrain.sources.views import sql_with

SIZE = 600


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.faces(spark, sf_dir, "photo_id", "interocular_px", "yaw_deg", "blur", "det_score", "dark_fraction", "bright_fraction").withColumnRenamed("id", "face_id")
    year = F.nullif(F.regexp_extract("taken_at", r"^\s*(\d{4})[-:]", 1), F.lit("")).cast("int")
    photos = views.photos(spark, sf_dir, "kind", "path", "taken_at").select(F.col("id").alias("photo_id"), "kind", "path", year.alias("year"))
    n = faces.groupBy("photo_id").agg(F.count("*").alias("n_faces"))
    pool = views.pool(spark, sf_dir).select("face_id", "cluster_id", "day")
    return faces.join(photos, "photo_id").join(n, "photo_id").join(pool, "face_id")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cross_era(sampling.strata(_faces(spark, sf_dir), "backup"))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("face_id", *sampling.TARGETS, "cross_era")


def quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.faces(spark, sf_dir, "blur").select(F.col("id").alias("face_id"), "blur")
    return sampling.unit_rank(rows, F.coalesce("blur", F.lit(0.0)).asc(), "face_id", "place").select("face_id", "place")


def capped_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped(views.pool(spark, sf_dir)).select("face_id", "cluster_id", "day")


def reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reserve(views.pool(spark, sf_dir).where("det_score IS NOT NULL"), SIZE, noise_share=0.1)


def greedy_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice; an iterative algorithm without a SQL form, tested against a slow one."""
    return sampling.greedy(sampling.capped(cut(_rows(spark, sf_dir))), SIZE)


def pool_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.composition(_rows(spark, sf_dir))


def pinned_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice where every labelled person of the pool stays; the same algorithm, tested against a slow one."""
    pinned = views.gold(spark, sf_dir).where("label = 'person' AND person_id IS NOT NULL").select("face_id")
    return sampling.greedy(sampling.capped(cut(_rows(spark, sf_dir))), SIZE, pinned=pinned)


def cross_era_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: faces of clusters that span the oldest and the most recent era, these clusters, and whether the faces are too few (under ten)."""
    rows = sampling.cross_era(sampling.strata(_faces(spark, sf_dir), "backup")).where("cross_era")
    return rows.agg(F.count("*").alias("faces"), F.countDistinct("cluster_id").alias("clusters")).withColumn("too_few", F.col("faces") < 10)


QUERIES = {f.__name__: f for f in (strata, quality_rank, capped_pool, reserved, greedy_sample, pinned_sample, pool_composition, cross_era_supply)}

_FACES = (
    "n AS (SELECT photo_id, count(*) AS n_faces FROM cur_faces GROUP BY photo_id), "
    r"f AS (SELECT c.id AS face_id, c.*, p.kind AS pkind, p.path, CAST(nullif(regexp_extract(p.taken_at, '^\s*(\d{4})[-:]', 1), '') AS INT) AS year, n.n_faces, k.cluster_id FROM cur_faces c JOIN cur_photos p ON p.id = c.photo_id JOIN n ON n.photo_id = c.photo_id JOIN cur_pool k ON k.face_id = c.id), "
    "yr AS (SELECT max(year) - 1 AS recent_from, list_sort(list(year))[greatest(0, count(year) // 3 - 1) + 1] AS oldest_to FROM f WHERE year IS NOT NULL), "
    "q AS (SELECT *, 0.45::DOUBLE * ((row_number() OVER (ORDER BY coalesce(blur, 0), face_id) - 1) / greatest(1, count(*) OVER () - 1)) + 0.45::DOUBLE * ((row_number() OVER (ORDER BY det_score ASC NULLS FIRST, face_id) - 1) / greatest(1, count(*) OVER () - 1)) + 0.10::DOUBLE * (1.0::DOUBLE - least(greatest(coalesce(dark_fraction, 0) + coalesce(bright_fraction, 0), 0), 1)) AS quality FROM f), "
    """s AS (SELECT face_id, cluster_id, CASE WHEN interocular_px IS NULL OR interocular_px < 20 THEN 'tiny' WHEN interocular_px < 40 THEN 'small' WHEN interocular_px < 80 THEN 'medium' ELSE 'large' END AS size,
      CASE WHEN abs(coalesce(yaw_deg, 0)) < 15 THEN 'frontal' WHEN abs(coalesce(yaw_deg, 0)) < 45 THEN 'semi' ELSE 'profile' END AS pose,
      CASE WHEN year IS NULL THEN 'undated' WHEN year >= recent_from THEN 'recent' WHEN year <= oldest_to THEN 'oldest' ELSE 'middle' END AS era,
      CASE WHEN pkind = 'forwarded' THEN 'forwarded' ELSE 'photo' END AS kind, CASE WHEN contains(path, 'backup') THEN 'beauty' ELSE 'plain' END AS filtered,
      CASE WHEN n_faces >= 4 THEN 'group' ELSE 'solo' END AS "group", CASE WHEN quality < 0.15 THEN 'bad' WHEN quality < 0.40 THEN 'marginal' ELSE 'good' END AS quality,
      CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'clustered' END AS clustered FROM q, yr)"""
)
_GOALS = ", ".join(f"('{d}', '{c}', {t}::DOUBLE)" for d, cats in sampling.TARGETS.items() for c, t in cats.items())
_HELD = " UNION ALL ".join(f"SELECT '{d}' AS dimension, \"{d}\" AS category FROM s" for d in sampling.TARGETS)
_RANDOM = f"md5('{sampling.SEED}:' || face_id)"
ORACLE = {
    "strata": sql_with("cur_faces", "cur_photos", "cur_pool", more=_FACES) + "SELECT s.* EXCLUDE (cluster_id), coalesce(cluster_id <> -1 AND bool_or(era = 'oldest') OVER (PARTITION BY cluster_id) AND bool_or(era = 'recent') OVER (PARTITION BY cluster_id), false) AS cross_era FROM s",
    "quality_rank": sql_with("cur_faces") + "SELECT id AS face_id, (row_number() OVER (ORDER BY coalesce(blur, 0), id) - 1) / greatest(1, count(*) OVER () - 1) AS place FROM cur_faces",
    "capped_pool": sql_with("cur_pool") + f"SELECT face_id, cluster_id, day FROM cur_pool WHERE cluster_id = -1 UNION ALL SELECT face_id, cluster_id, day FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_RANDOM}, face_id) AS b FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, day ORDER BY {_RANDOM}, face_id) AS a FROM cur_pool WHERE cluster_id <> -1) WHERE a <= 3) WHERE b <= 70",
    "reserved": sql_with("cur_pool", more="low AS (SELECT face_id FROM cur_pool WHERE det_score IS NOT NULL ORDER BY det_score, face_id LIMIT 50)") + f"SELECT face_id, 'detector_fp' AS reserved_for FROM low UNION ALL (SELECT face_id, 'noise_review' FROM cur_pool WHERE det_score IS NOT NULL AND cluster_id = -1 AND face_id NOT IN (SELECT face_id FROM low) ORDER BY {_RANDOM}, face_id LIMIT 60)",
    "pool_composition": sql_with("cur_faces", "cur_photos", "cur_pool", more=_FACES + f", goals(dimension, category, target) AS (VALUES {_GOALS}), held AS (SELECT dimension, category, count(*) AS n FROM ({_HELD}) GROUP BY ALL), g AS (SELECT dimension, category, coalesce(n, 0) AS faces, target FROM goals LEFT JOIN held USING (dimension, category)), h AS (SELECT *, CAST(sum(faces) OVER (PARTITION BY dimension) AS BIGINT) AS t FROM g)") + "SELECT dimension, category, faces, faces / t AS share, target, abs(faces / t - target) > 0.05 AS off FROM h",
}
ORACLE["cross_era_supply"] = "WITH st AS (" + ORACLE["strata"] + ") SELECT count(*) AS faces, count(DISTINCT k.cluster_id) AS clusters, count(*) < 10 AS too_few FROM st JOIN (SELECT face_id, cluster_id FROM (" + sql_with("cur_pool") + "SELECT * FROM cur_pool)) k USING (face_id) WHERE cross_era"
