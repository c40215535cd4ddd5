"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.piles import described, misfits, piles, quantised
from pilegrain.operators.scalars import side_by_side
from pilegrain.session import cut
from pilegrain.sources.tables import table

DIM = 256


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current usable vectors of the model with the most faces; equal counts fall to the first model by name."""
    rows = table(spark, sf_dir, "face_embeddings")
    model = rows.where("model IS NOT NULL").groupBy("model").agg(F.countDistinct("face_id").alias("faces")).orderBy(F.desc("faces"), "model").first()
    return quantised(rows.where(F.col("model") == (model["model"] if model else "")), "face_id", "created_at", "embedding", DIM)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = piles(_vectors(spark, sf_dir), DIM)
    return members.select(F.col("key").alias("face_id"), F.col("pile").alias("pile_face_id"))


def p1_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and three most typical faces of every pile."""
    vectors = _vectors(spark, sf_dir)
    found = described(*piles(vectors, DIM), vectors, DIM)
    return found.select(F.col("pile").alias("pile_face_id"), "size", F.concat_ws(",", F.col("typical").cast("array<string>")).alias("typical_faces"))


def p1_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may not be, counted: faces in two piles, piles of one or not named by their smallest face, members below the mean cosine."""
    vectors = _vectors(spark, sf_dir)
    members, parts = piles(vectors, DIM)
    members = cut(members)
    named = members.groupBy("pile").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    twice = members.groupBy("key").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("faces_twice"))
    return side_by_side(twice, named.agg(F.count_if((F.col("n") < 2) | (F.col("least") != F.col("pile"))).alias("piles_wrong")), misfits(members, parts, vectors, DIM).agg(F.count("*").alias("members_below")))


QUERIES = {"p1_found": p1_found, "p1_piles": p1_piles, "p1_verified": p1_verified}
ORACLE = {"p1_verified": "SELECT CAST(0 AS BIGINT) AS faces_twice, CAST(0 AS BIGINT) AS piles_wrong, CAST(0 AS BIGINT) AS members_below"}
