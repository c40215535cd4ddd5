"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.caps import beyond, day_of, within
from pilegrain.sources.tables import current_rows, table


def _pool(spark: SparkSession, sf_dir: str, run: str) -> tuple[DataFrame, list[tuple[list[str], int | None]]]:
    pool = current_rows(table(spark, sf_dir, "candidates"), ["face_id"], "created_at", ["cluster_id", "det_score", "day"])
    pool = pool.where("cluster_id IS NOT NULL AND cluster_id <> -1").withColumn("day", day_of(F.col("day")))
    caps = table(spark, sf_dir, "sample_config").where(F.col("sample_run") == run).first()
    per_day, total = (caps["per_cluster_per_day"], caps["per_cluster_total"]) if caps else (None, None)
    return pool, [(["cluster_id", "day"], per_day), (["cluster_id"], total)]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, levels = _pool(spark, sf_dir, "baseline")
    return beyond(pool, levels, "det_score", "face_id").select("face_id")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with a cluster that the caps of run hard_cases keep."""
    pool, levels = _pool(spark, sf_dir, "hard_cases")
    return within(pool, levels, "det_score", "face_id").select("face_id", "cluster_id", "day", "det_score")


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within three nested caps: twenty of an author in a source and language, a hundredth of all of an author in a source, a seventh of all of a source; longer ones first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "author_id", F.lower(F.trim("lang")).alias("lang"), F.length("text").cast("double").alias("size"))
    rows = rows.where("doc_id IS NOT NULL AND source IS NOT NULL AND author_id IS NOT NULL")
    return within(rows, [(["source", "author_id", "lang"], 20), (["source", "author_id"], 0.01), (["source"], 1 / 7)], "size", "doc_id").select("doc_id", "source", "author_id")


QUERIES = {"p7_found": p7_found, "p7_kept": p7_kept, "p7_documents": p7_documents}
_KEPT = """
WITH cur AS (SELECT * FROM (SELECT face_id, cluster_id, det_score, day, row_number() OVER (PARTITION BY face_id ORDER BY created_at DESC NULLS LAST, cluster_id DESC NULLS LAST, det_score DESC NULLS LAST, day DESC NULLS LAST) AS r FROM candidates WHERE face_id IS NOT NULL) WHERE r = 1),
pool AS (SELECT face_id, cluster_id, CASE WHEN isnan(det_score) THEN NULL ELSE det_score END AS s, det_score,
  CASE WHEN day IS NULL OR lower(trim(day)) IN ('', 'undated') THEN 'undated' ELSE substr(trim(day), 1, 10) END AS day FROM cur WHERE cluster_id IS NOT NULL AND cluster_id <> -1),
caps AS (SELECT per_cluster_per_day AS d, per_cluster_total AS t FROM sample_config WHERE sample_run = '{run}'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, day ORDER BY s DESC NULLS LAST, face_id) AS r1 FROM pool) WHERE r1 <= (SELECT d FROM caps)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC NULLS LAST, face_id) AS r2 FROM one) WHERE r2 <= (SELECT t FROM caps))
"""
ORACLE = {
    "p7_found": _KEPT.format(run="baseline") + "SELECT face_id FROM pool WHERE face_id NOT IN (SELECT face_id FROM kept)",
    "p7_kept": _KEPT.format(run="hard_cases") + "SELECT face_id, cluster_id, day, det_score FROM kept",
    "p7_documents": """
WITH d AS (SELECT doc_id, lower(trim(source)) AS source, author_id, lower(trim(lang)) AS lang, length(text) AS size FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND author_id IS NOT NULL),
one AS (SELECT *, row_number() OVER (PARTITION BY source, author_id, lang ORDER BY size DESC NULLS LAST, doc_id) AS r1 FROM d),
two AS (SELECT *, row_number() OVER (PARTITION BY source, author_id ORDER BY size DESC NULLS LAST, doc_id) AS r2 FROM one WHERE r1 <= 20),
three AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC NULLS LAST, doc_id) AS r3 FROM two WHERE r2 <= floor(0.01 * (SELECT count(*) FROM d) + 1e-9))
SELECT doc_id, source, author_id FROM three WHERE r3 <= floor((SELECT count(*) FROM d) / 7.0 + 1e-9)""",
}
