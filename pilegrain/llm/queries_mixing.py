"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.encode import token_count
from pilegrain.llm.mixing import folded, mixed, report, source_tokens
from pilegrain.session import cut, spread
from pilegrain.sources.tables import table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", folded(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets for which the schedule, all repetitions used, holds less than was asked for."""
    return p9_report(spark, sf_dir).where("short").select("mix_name", "source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(cut(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"), "doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(_sized(spark, sf_dir))
    targets = table(spark, sf_dir, "mix_targets")
    return report(mixed(sized, targets, "doc_id"), targets, source_tokens(sized))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target got what was asked for or all it may give, passing it by less than its largest document, within its cap of repetitions."""
    sized = cut(_sized(spark, sf_dir))
    targets = table(spark, sf_dir, "mix_targets")
    told = report(mixed(sized, targets, "doc_id"), targets, source_tokens(sized))
    largest = sized.groupBy("source").agg(F.max("tokens").alias("largest"))
    rows = told.join(F.broadcast(largest), "source", "left")
    may = F.least(F.col("asked_tokens"), F.coalesce("max_repeats", F.lit(0)) * F.col("source_tokens"))
    over = F.col("given_tokens") - may
    return rows.select("mix_name", "source", ((over >= 0) & (over <= F.coalesce("largest", F.lit(0)))).alias("share_met"), (F.col("passes") <= F.coalesce("max_repeats", F.lit(0))).alias("within_repeats"))


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_report": p9_report, "p9_kept": p9_kept}
ORACLE = {"p9_kept": "SELECT mix_name, lower(trim(source)) AS source, true AS share_met, true AS within_repeats FROM mix_targets"}
