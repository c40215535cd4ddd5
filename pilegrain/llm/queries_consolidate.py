"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.consolidate import consolidate
from pilegrain.sources.tables import table


def same_pairs(matches: DataFrame) -> DataFrame:
    """(a, b) with a < b whose latest verdict, either way round and over all runs, reads same. Equal times fall to the larger match_id."""
    pairs = matches.select(F.least("face_a", "face_b").alias("a"), F.greatest("face_a", "face_b").alias("b"), "matched_at", "match_id", F.lower(F.trim(F.col("verdict"))).alias("verdict"))
    pairs = pairs.where("face_a IS NOT NULL AND face_b IS NOT NULL AND face_a <> face_b")
    latest = pairs.groupBy("a", "b").agg(F.max(F.struct("matched_at", "match_id", "verdict")).alias("last"))
    return latest.where("last.verdict = 'same'").select("a", "b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(same_pairs(table(spark, sf_dir, "face_matches")), "a", "b", "face_id", "group_face_id")


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_found(spark, sf_dir).groupBy("group_face_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_groups"))


QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes}
_CLOSURE = """
WITH RECURSIVE pairs AS (
  SELECT least(face_a, face_b) AS a, greatest(face_a, face_b) AS b, lower(trim(verdict)) AS verdict,
         row_number() OVER (PARTITION BY least(face_a, face_b), greatest(face_a, face_b) ORDER BY matched_at DESC NULLS LAST, match_id DESC) AS r
  FROM face_matches WHERE face_a IS NOT NULL AND face_b IS NOT NULL AND face_a <> face_b),
same AS (SELECT a, b FROM pairs WHERE r = 1 AND verdict = 'same'),
links AS (SELECT a, b FROM same UNION SELECT b, a FROM same),
reach(v, u) AS (SELECT a, a FROM links UNION SELECT l.b, r.u FROM reach r JOIN links l ON l.a = r.v WHERE r.u < l.b),
found AS (SELECT v AS face_id, min(u) AS group_face_id FROM reach GROUP BY v)
"""
ORACLE = {
    "p5_found": _CLOSURE + "SELECT face_id, group_face_id FROM found",
    "p5_sizes": _CLOSURE + "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM found GROUP BY group_face_id) GROUP BY size",
}
