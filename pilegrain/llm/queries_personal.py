"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pilegrain.llm.personal import redacted, spans
from pilegrain.session import spread
from pilegrain.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(_texts(spark, sf_dir), "doc_id", "text")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(_texts(spark, sf_dir), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLE: dict[str, str] = {}
