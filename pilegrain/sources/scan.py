"""Listing, resuming and keeping tables: what is new, what is pending, what replaces what.

Plain Parquet has no merge, so an upsert is the old table without the new keys, plus the new rows,
written to a new version directory.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan passes over.
SYSTEM_FOLDERS = ["__MACOSX", "$RECYCLE.BIN"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size_bytes, mtime) of every file under root that is not hidden; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    base = "file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root
    rel = F.regexp_replace(F.substring(F.col("path"), len(base) + 1, 100_000), "^/+", "")
    parts = F.split("rel_path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(SYSTEM_FOLDERS))
    return found.withColumn("rel_path", rel).where(~hidden).select("path", "rel_path", "size_bytes", "mtime")


def unseen(listing: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the listing that known does not hold unchanged."""
    return listing.join(known.select(*on).distinct(), on, "left_anti")


def awaiting(items: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Items with no result yet."""
    return items.join(done.select(*on).distinct(), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old with its rows of the new keys replaced; columns that new lacks become null."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_photos(old: DataFrame, new: DataFrame, on: str = "path") -> DataFrame:
    """Photos after a scan: a file scanned again loses what was told from its old content, the full hash and the copy it was."""
    fresh = new
    for name in ("content_hash", "duplicate_of"):
        if name in new.columns or name in old.columns:
            kind = (new if name in new.columns else old).schema[name].dataType
            fresh = fresh.withColumn(name, F.lit(None).cast(kind))
    return upsert(old, fresh, [on])


def mark_done(status: DataFrame, items: DataFrame, key: str, version: str, fault: str | None = None) -> DataFrame:
    """Status rows (key, version, fault) after items were worked on: one per key and version, so an item without any result is not pending for ever."""
    new = items.select(F.col(key), F.lit(version).alias("version"), F.lit(fault).cast("string").alias("fault")).distinct()
    return upsert(status, new, [key, "version"])


def pending(items: DataFrame, status: DataFrame, key: str, version: str) -> DataFrame:
    """Items without a status row of this version."""
    return awaiting(items, status.where(F.col("version") == version), [key])


def replace_groups(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old with every group that new speaks of replaced as a whole, as with all detections of a photo."""
    return upsert(old, new, by)


def point_to(spark: SparkSession, root: str, version: int) -> None:
    """Name the live version: one row written beside the versions, the newest of which counts."""
    spark.createDataFrame([(version,)], "version int").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/live")


def live(spark: SparkSession, root: str) -> DataFrame:
    """The table of the version that was named last."""
    newest = spark.read.parquet(f"{root}/live").orderBy(F.desc("at"), F.desc("version")).first()["version"]
    return spark.read.parquet(f"{root}/v{newest:06d}")


def save_version(df: DataFrame, root: str, version: int, *by: str) -> str:
    """Write a version directory; readers switch to it by name."""
    to = f"{root}/v{version:06d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(to)
    return to

