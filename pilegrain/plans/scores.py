"""Queries that score the pool's clusters against the labelled identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.operators import metrics
from pilegrain.sources import views
from pilegrain.sources.views import sql_with

DRAWS, PEOPLE = 2000, 40


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gold(spark, sf_dir).where("label = 'person' AND person_id IS NOT NULL").select("face_id", F.col("person_id").alias("person"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pool(spark, sf_dir).select("face_id", F.col("cluster_id").alias("cluster"))


def micro(x: Column) -> Column:
    """Millionths as whole numbers: sums of doubles differ in their last digits with the order of rows."""
    return F.round(x * 1e6).cast("long")


def _quantised(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[micro(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cells(_truth(spark, sf_dir), _predicted(spark, sf_dir))


def pairwise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(metrics.pairwise(_cells(spark, sf_dir)), "precision", "recall", "f1")


def bcubed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(metrics.bcubed(_cells(spark, sf_dir)), "precision", "recall", "f1")


def ari_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(metrics.information(_cells(spark, sf_dir)), "nmi", "ari")


def score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(metrics.counts(_truth(spark, sf_dir), _predicted(spark, sf_dir)), "noise_share")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    junk = views.gold(spark, sf_dir).where("label IN ('non_face', 'not_of_interest')").select("face_id")
    return _quantised(metrics.contamination(_truth(spark, sf_dir), _predicted(spark, sf_dir), junk), "share")


def slice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = views.gold(spark, sf_dir).where("occlusion IS NOT NULL").select("face_id", F.col("occlusion").alias("slice"))
    return _quantised(metrics.by_slice(_truth(spark, sf_dir), _predicted(spark, sf_dir), slices), "precision", "recall", "f1")


def per_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(metrics.per_person(_cells(spark, sf_dir)), "precision", "recall")


def identity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth person, by the years that their photos span, faces and name, is held out."""
    year = F.nullif(F.regexp_extract("taken_at", r"^\s*(\d{4})[-:]", 1), F.lit("")).cast("int")
    shown = views.faces(spark, sf_dir, "photo_id").select(F.col("id").alias("face_id"), "photo_id").join(views.photos(spark, sf_dir, "taken_at").select(F.col("id").alias("photo_id"), year.alias("year")), "photo_id")
    people = _truth(spark, sf_dir).join(shown, "face_id", "left").groupBy("person").agg(F.count("*").alias("faces"), F.coalesce(F.max("year") - F.min("year"), F.lit(0)).alias("span"))
    return metrics.split_identities(people).select("person", "faces", "span", "place", "side")


def frequency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _truth(spark, sf_dir).groupBy("person").agg(F.count("*").alias("faces"))
    band = F.when(F.col("faces") >= 40, "40+").when(F.col("faces") >= 15, "15-39").when(F.col("faces") >= 5, "5-14").when(F.col("faces") >= 2, "2-4").otherwise("1")
    return people.groupBy(band.alias("band")).agg(F.count("*").alias("people"), F.sum("faces").alias("faces"))


def error_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of F1 over random sets of people; no SQL form, as the draws follow a hash that only Spark has."""
    return metrics.error_bar(_cells(spark, sf_dir), PEOPLE, DRAWS)


QUERIES = {f.__name__: f for f in (pairwise_scores, bcubed_scores, ari_nmi, score_counts, contamination, slice_scores, per_person, identity_split, frequency_bands, error_bar)}

_BASE = sql_with(
    "cur_gold",
    "cur_pool",
    more="truth AS (SELECT face_id, person_id AS person FROM cur_gold WHERE label = 'person' AND person_id IS NOT NULL), "
    "pred AS (SELECT face_id, CASE WHEN cluster_id = -1 THEN 'lone ' || face_id ELSE cluster_id::VARCHAR END AS cluster, cluster_id FROM cur_pool), "
    "c0 AS (SELECT person, cluster, count(*) AS n FROM truth JOIN pred USING (face_id) GROUP BY ALL), "
    "cells AS (SELECT *, sum(n) OVER (PARTITION BY person) AS np, sum(n) OVER (PARTITION BY cluster) AS nc FROM c0)",
)
_PAIRS = ", pw AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM cells) AS hits, (SELECT sum(n) FROM cells) AS n_scored, (SELECT sum(nc * (nc - 1) // 2) FROM (SELECT DISTINCT cluster, nc FROM cells)) AS pp, (SELECT sum(np * (np - 1) // 2) FROM (SELECT DISTINCT person, np FROM cells)) AS tp) "
_M = lambda x: f"CAST(round(({x}) * 1e6) AS BIGINT)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_SPLIT = sql_with("cur_gold", "cur_faces", "cur_photos", more=r"y AS (SELECT id AS photo_id, CAST(nullif(regexp_extract(taken_at, '^\s*(\d{4})[-:]', 1), '') AS INT) AS year FROM cur_photos), sh AS (SELECT f.id AS face_id, y.year FROM cur_faces f JOIN y USING (photo_id)), pe AS (SELECT g.person_id AS person, count(*) AS faces, coalesce(max(year) - min(year), 0) AS span FROM cur_gold g LEFT JOIN sh USING (face_id) WHERE label = 'person' AND person_id IS NOT NULL GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY span DESC, faces DESC, person) AS place FROM pe)") + "SELECT person, faces, span, place, CASE WHEN (place - 1) % 5 = 4 THEN 'holdout' ELSE 'tune' END AS side FROM rk"
ORACLE = {
    "pairwise_scores": _BASE.rstrip() + _PAIRS + f"SELECT CAST(hits AS BIGINT) AS hits, CAST(n_scored AS BIGINT) AS n_scored, CAST(pp AS BIGINT) AS predicted_pairs, CAST(tp AS BIGINT) AS true_pairs, {_M('p')} AS precision, {_M('r')} AS recall, {_M(_F1)} AS f1 FROM (SELECT *, CASE WHEN pp > 0 THEN hits / pp ELSE 0 END AS p, CASE WHEN tp > 0 THEN hits / tp ELSE 0 END AS r FROM pw)",
    "bcubed_scores": _BASE + f"SELECT n_scored, {_M('p')} AS precision, {_M('r')} AS recall, {_M(_F1)} AS f1 FROM (SELECT CAST(sum(n) AS BIGINT) AS n_scored, sum(n * (n / nc)) / sum(n) AS p, sum(n * (n / np)) / sum(n) AS r FROM cells)",
    "ari_nmi": _BASE.rstrip() + _PAIRS + f", mi AS (SELECT sum(n / tot * ln(n * tot / (np * nc))) AS m FROM cells, (SELECT sum(n) AS tot FROM cells)), hp AS (SELECT sum(-np / tot * ln(np / tot)) AS h FROM (SELECT DISTINCT person, np FROM cells), (SELECT sum(n) AS tot FROM cells)), hc AS (SELECT sum(-nc / tot * ln(nc / tot)) AS h FROM (SELECT DISTINCT cluster, nc FROM cells), (SELECT sum(n) AS tot FROM cells)) "
    f"SELECT CAST(n_scored AS BIGINT) AS n_scored, {_M('m / ((hp.h + hc.h) / 2)')} AS nmi, {_M('(hits - pp * tp / (n_scored * (n_scored - 1) // 2)) / ((pp + tp) / 2 - pp * tp / (n_scored * (n_scored - 1) // 2))')} AS ari FROM pw, mi, hp, hc",
    "score_counts": _BASE + f"SELECT count(*) AS n_scored, count(DISTINCT person) AS n_people, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters, {_M('avg(CASE WHEN cluster_id = -1 THEN 1 ELSE 0 END)')} AS noise_share FROM truth JOIN pred USING (face_id)",
    "contamination": _BASE + f"SELECT count(*) FILTER (WHERE cluster_id IN (SELECT cluster_id FROM truth JOIN pred USING (face_id) WHERE cluster_id <> -1)) AS inside, count(*) AS n_junk, {_M('count(*) FILTER (WHERE cluster_id IN (SELECT cluster_id FROM truth JOIN pred USING (face_id) WHERE cluster_id <> -1)) / count(*)')} AS share FROM cur_gold JOIN pred USING (face_id) WHERE label IN ('non_face', 'not_of_interest')",
    "slice_scores": _BASE.rstrip() + f", rows AS (SELECT person, cluster, occlusion AS slice FROM truth JOIN pred USING (face_id) JOIN (SELECT face_id, occlusion FROM cur_gold WHERE occlusion IS NOT NULL) USING (face_id)), k AS (SELECT *, count(*) OVER (PARTITION BY person, cluster) AS n, count(*) OVER (PARTITION BY person) AS a, count(*) OVER (PARTITION BY cluster) AS b FROM rows) SELECT slice, faces, {_M('p')} AS precision, {_M('r')} AS recall, {_M(_F1)} AS f1 FROM (SELECT slice, count(*) AS faces, avg(n / b) AS p, avg(n / a) AS r FROM k GROUP BY slice) WHERE faces >= 10",
    "per_person": _BASE + f"SELECT person, faces, piles, largest, {_M('p')} AS precision, {_M('r')} AS recall, CASE WHEN p < 0.9 AND r < 0.9 THEN 'both' WHEN p < 0.9 THEN 'mixed' WHEN r < 0.9 THEN 'split' ELSE 'none' END AS failure FROM (SELECT person, CAST(sum(n) AS BIGINT) AS faces, count(*) AS piles, max(n) AS largest, sum(n * (n / nc)) / sum(n) AS p, sum(n * (n / np)) / sum(n) AS r FROM cells GROUP BY person)",
    "identity_split": _SPLIT,
    "frequency_bands": _BASE + "SELECT band, count(*) AS people, CAST(sum(faces) AS BIGINT) AS faces FROM (SELECT count(*) AS faces, CASE WHEN count(*) >= 40 THEN '40+' WHEN count(*) >= 15 THEN '15-39' WHEN count(*) >= 5 THEN '5-14' WHEN count(*) >= 2 THEN '2-4' ELSE '1' END AS band FROM truth GROUP BY person) GROUP BY band",
}
