"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.encode import decoded, token_count, token_ids
from pilegrain.session import spread
from pilegrain.sources.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", token_ids(F.col("text")).alias("ids"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document and characters per token."""
    counted = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length("text").alias("chars"), token_count(F.col("text")).alias("tokens"))
    return counted.withColumn("chars_per_token", F.when(F.col("tokens") > 0, F.col("chars") / F.col("tokens")))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ids of every document give its text again, null texts as empty ones."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return texts.select("doc_id", (decoded(token_ids(F.col("text"))) == F.coalesce("text", F.lit(""))).alias("same"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths, "p8_round_trip": p8_round_trip}
ORACLE = {"p8_round_trip": "SELECT doc_id, true AS same FROM documents"}
