"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.stable import grown_sample
from pilegrain.sources.tables import table


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growing sample of every run over all load batches."""
    pool = table(spark, sf_dir, "candidates").select("face_id", "load_batch")
    return grown_sample(pool, "face_id", "load_batch", table(spark, sf_dir, "sample_config"), "sample_run", "target_size", "random_seed")


def p6_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample size after each load; a pick is never dropped, so sizes add up."""
    return p6_sample(spark, sf_dir).groupBy("sample_run", "picked_at").agg(F.count("*").alias("new_picks"))


QUERIES = {"p6_sample": p6_sample, "p6_growth": p6_growth}
#: The list after a load ends at the place of the target-th key in the order of the hash; no buckets are counted here.
_SAMPLE = """
WITH ks AS (SELECT face_id AS k, coalesce(min(load_batch), 1) AS l FROM candidates WHERE face_id IS NOT NULL GROUP BY face_id),
seeds AS (SELECT sample_run, target_size, ((coalesce(random_seed, 0) % 2147483648) + 2147483648) % 2147483648 AS s FROM sample_config WHERE target_size > 0),
placed AS (SELECT sample_run, target_size, k, l, (CAST(('0x' || substr(md5(k::VARCHAR), 1, 9)) AS BIGINT) * (s * 40503 % 67108864 * 2 + 1) + s * 69621 % 68719476736) % 68719476736 AS bucket FROM ks, seeds),
loads AS (SELECT DISTINCT l AS at_load FROM ks),
ranked AS (SELECT sample_run, target_size, at_load, bucket, row_number() OVER (PARTITION BY sample_run, at_load ORDER BY bucket) AS place FROM placed JOIN loads ON l <= at_load),
need AS (SELECT sample_run, at_load, coalesce(min(bucket) FILTER (WHERE place = target_size), 68719476736) AS need FROM ranked GROUP BY ALL),
listed AS (SELECT sample_run, at_load, max(need) OVER (PARTITION BY sample_run ORDER BY at_load) AS last FROM need),
picked AS (SELECT p.sample_run, p.k AS face_id, p.bucket, p.l AS load_batch, min(d.at_load) AS picked_at FROM placed p JOIN listed d ON p.sample_run = d.sample_run AND p.bucket <= d.last AND p.l <= d.at_load GROUP BY ALL)
"""
ORACLE = {
    "p6_sample": _SAMPLE + "SELECT * FROM picked",
    "p6_growth": _SAMPLE + "SELECT sample_run, picked_at, count(*) AS new_picks FROM picked GROUP BY ALL",
}
