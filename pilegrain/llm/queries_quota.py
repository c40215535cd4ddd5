"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.quota import availability, composition, folded, matched_sample, unmet
from pilegrain.sources.tables import current_rows, table

DIMENSIONS = ["size", "pose", "era", "kind", "filtered", "group", "quality", "clustered"]


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "candidates"), ["face_id"], "created_at", ["strata"])


def _dimensions() -> dict:
    return {d: F.col(f"strata.{d}") for d in DIMENSIONS}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = unmet(_pool(spark, sf_dir), _dimensions(), table(spark, sf_dir, "sample_targets"), table(spark, sf_dir, "sample_config"))
    return short.select("sample_run", "dimension", "category")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_sample(_pool(spark, sf_dir), "face_id", _dimensions(), table(spark, sf_dir, "sample_targets"), table(spark, sf_dir, "sample_config"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest deviation of each run and dimension and how many targets were missed."""
    rows = composition(p3_sample(spark, sf_dir), DIMENSIONS, table(spark, sf_dir, "sample_targets"), table(spark, sf_dir, "sample_config"))
    return rows.groupBy("sample_run", "dimension").agg(F.max("deviation").alias("max_deviation"), F.sum("picked").alias("picked"), F.count_if(F.col("lacking") > 0).alias("targets_missed"), F.sum("lacking").alias("lacking"))


def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_run, size, floors_missed): faces drawn for each run, and targets whose min_count exists but was not reached."""
    config, targets = table(spark, sf_dir, "sample_config"), table(spark, sf_dir, "sample_targets")
    sample = p3_sample(spark, sf_dir)
    held = availability(_pool(spark, sf_dir), _dimensions())
    told = composition(sample, DIMENSIONS, targets, config).join(targets.select("sample_run", "dimension", folded(F.col("category")).alias("category"), "min_count"), ["sample_run", "dimension", "category"])
    missed = told.join(F.broadcast(held), ["dimension", "category"], "left").groupBy("sample_run").agg(F.count_if(F.col("picked") < F.least(F.coalesce("min_count", F.lit(0)), F.coalesce("available", F.lit(0)))).alias("floors_missed"))
    return sample.groupBy("sample_run").agg(F.count("*").alias("size"), F.countDistinct("face_id").alias("distinct_faces")).join(missed, "sample_run")


QUERIES = {"p3_found": p3_found, "p3_sample": p3_sample, "p3_report": p3_report, "p3_sizes": p3_sizes}
_HELD = " UNION ALL ".join(f"SELECT '{d}' AS dimension, lower(trim(strata.\"{d}\")) AS category FROM cur" for d in DIMENSIONS)
ORACLE = {
    "p3_found": f"""
WITH cur AS (SELECT * FROM (SELECT face_id, strata, row_number() OVER (PARTITION BY face_id ORDER BY created_at DESC NULLS LAST) AS r FROM candidates WHERE face_id IS NOT NULL) WHERE r = 1),
held AS (SELECT dimension, category, count(*) AS n FROM ({_HELD}) GROUP BY ALL)
SELECT t.sample_run, t.dimension, lower(trim(t.category)) AS category
FROM sample_targets t JOIN sample_config c ON t.sample_run = c.sample_run LEFT JOIN held h ON h.dimension = t.dimension AND h.category = lower(trim(t.category))
WHERE coalesce(h.n, 0) < greatest(coalesce(t.min_count, 0), round(t.target_share * c.target_size))""",
    "p3_sizes": """
WITH n AS (SELECT count(DISTINCT face_id) AS n FROM candidates)
SELECT sample_run, least(target_size, n) AS size, least(target_size, n) AS distinct_faces, CAST(0 AS BIGINT) AS floors_missed FROM sample_config, n WHERE n > 0""",
}
