"""Exact duplicates: the kept record of every group of equals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilegrain.functions.files import content_hash


def canonical(rows: DataFrame, same: list[str], key: str, order: list[str]) -> DataFrame:
    """rows of groups of two or more, without the kept one, with kept_id: the first by order, then by key.

    The kept record is a minimum, so a group with a third of all rows shrinks map-side; null keys of a group never match.
    """
    kept = rows.groupBy(*same).agg(F.min(F.struct(*order, key)).alias("_k"), F.count("*").alias("_n")).where("_n > 1")
    return rows.join(kept.select(*same, F.col(f"_k.{key}").alias("kept_id")), same).where(F.col(key) != F.col("kept_id"))


def two_stage(rows: DataFrame, key: str, content: str, chunk: int = 4096) -> DataFrame:
    """Equals by content: a quick hash of length and ends first, the full hash only where quick hashes collide."""
    n = F.length(content)
    ends = F.md5(F.concat_ws("|", n.cast("string"), F.substring(content, 1, chunk), F.when(n > 2 * chunk, F.expr(f"right(`{content}`, {chunk})"))))
    quick = rows.withColumn("_q", ends)
    colliding = quick.groupBy("_q").agg(F.count("*").alias("_m")).where("_m > 1").select("_q")
    hashed = quick.join(colliding, "_q", "left_semi").select(key, content_hash(F.col(content)).alias("_h"))
    return canonical(hashed, ["_h"], key, [])
