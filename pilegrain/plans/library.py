"""Queries over the photo library: composition, dates, duplicates, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pilegrain.functions import dates, files
from pilegrain.operators.dedup import canonical, two_stage
from pilegrain.operators.scalars import side_by_side
from pilegrain.sources import views
from pilegrain.sources.scan import awaiting, unseen
from pilegrain.sources.tables import table
from pilegrain.sources.views import sql_with

AS_OF_YEAR = 2026


def kind_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "kind", "size_bytes").groupBy("kind").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return rows.withColumn("share", F.col("files") / F.sum("files").over(Window.partitionBy()))


def duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "kind", "size_bytes", "duplicate_of")
    again = F.col("duplicate_of").isNotNull()
    return rows.agg(F.count_if(again).alias("duplicates"), F.coalesce(F.sum(F.when(again, F.col("size_bytes"))), F.lit(0)).alias("duplicate_bytes"), F.count_if(~again & F.col("kind").isin(files.WITH_FACES)).alias("unique_candidates"))


def _year():
    return F.nullif(F.regexp_extract("taken_at", r"^\s*(\d{4})[-:]", 1), F.lit(""))


def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "kind", "duplicate_of", "taken_at").where(F.col("duplicate_of").isNull() & F.col("kind").isin(files.WITH_FACES))
    return rows.groupBy(F.coalesce(_year(), F.lit("undated")).alias("year")).agg(F.count("*").alias("photos"))


def date_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "taken_at_source").groupBy(F.coalesce("taken_at_source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("photos"))
    return rows.withColumn("share", F.col("photos") / F.sum("photos").over(Window.partitionBy()))


def camera_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "camera_make", "camera_model").where("camera_make IS NOT NULL OR camera_model IS NOT NULL")
    return rows.groupBy(F.trim(F.concat_ws(" ", "camera_make", "camera_model")).alias("camera")).agg(F.count("*").alias("photos")).orderBy(F.desc("photos"), "camera").limit(15)


def folder_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "rel_path", "taken_at").withColumn("folder", F.regexp_replace("rel_path", r"/[^/]*$", ""))
    return rows.groupBy("folder").agg(F.count("*").alias("photos"), F.count_if(_year().isNotNull()).alias("dated")).withColumn("undated", F.col("photos") - F.col("dated")).orderBy(F.desc("photos"), "folder").limit(40)


def corpus_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of flags and their figures."""
    rows = views.photos(spark, sf_dir, "kind", "taken_at", "camera_make", "camera_model")
    use = F.col("kind").isin(files.WITH_FACES)
    one = rows.agg(F.count_if(use).alias("candidates"), F.count_if(use & _year().isNull()).alias("undated"), F.countDistinct(F.when(use, _year())).alias("years"), F.countDistinct(F.when(use, F.concat_ws(" ", "camera_make", "camera_model"))).alias("cameras"), F.count_if(F.col("kind") == "unreadable").alias("unreadable"), F.count_if(F.col("kind") == "raw").alias("raw"), F.count_if(F.col("kind") == "archive").alias("archives"))
    both = side_by_side(one, date_disagreement(spark, sf_dir))
    return both.select("*", (F.col("undated") > F.col("candidates") * 0.25).alias("mostly_undated"), (F.col("years") < 3).alias("few_years"), (F.col("cameras") <= 1).alias("one_camera"), *[(F.col(c) > 0).alias(f"has_{c}") for c in ("unreadable", "raw", "archives")], (F.col("disagreements") > F.col("comparable") * 0.1).alias("dates_disagree"))


def reject_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "path", "kind").where(~F.col("kind").isin(files.WITH_FACES))
    return rows.groupBy("kind", files.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


def path_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and dates of the photos whose path holds a word in any case."""
    rows = views.photos(spark, sf_dir, "path", "kind", "taken_at").where(F.col("path").ilike("%BACKUP%"))
    return rows.groupBy("kind").agg(F.count("*").alias("files"), F.count_if(_year().isNotNull()).alias("dated"), F.min("path").alias("first_path"))


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.photos(spark, sf_dir, "path", "width", "height", "image_format", "camera_make", "camera_model")
    c = F.col
    kind = F.coalesce(files.by_extension(c("path")), files.classify(c("path"), c("width"), c("height"), c("image_format"), c("camera_make"), c("camera_model")))
    return rows.select("id", kind.alias("kind"))


def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = dates.date_from_name(dates.base_name(F.col("rel_path")), AS_OF_YEAR)
    return views.photos(spark, sf_dir, "rel_path").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("taken_at")).where("taken_at IS NOT NULL")


def folder_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = dates.year_from_folder(F.col("rel_path"), AS_OF_YEAR)
    return views.photos(spark, sf_dir, "rel_path").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("taken_at")).where("taken_at IS NOT NULL")


def date_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered dates of undated photos; dates that are there are never overwritten."""
    rows = views.photos(spark, sf_dir, "rel_path", "mtime", "kind", "taken_at", "exif_modified_at").where("taken_at IS NULL AND kind NOT IN ('unreadable', 'unsupported', 'video', 'audio', 'archive')")
    got = dates.recovered(F.col("rel_path"), dates.exif_time(F.col("exif_modified_at")), F.col("mtime"), AS_OF_YEAR)
    return rows.select("id", got.alias("got")).where("got IS NOT NULL").select("id", F.date_format("got.at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"), F.col("got.source").alias("source"))


def date_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many camera dates lie more than seven whole days from the date in the file name."""
    rows = views.photos(spark, sf_dir, "rel_path", "taken_at", "taken_at_source").where("taken_at_source IN ('exif_original', 'exif_digitized')")
    pair = rows.select(dates.exif_time(F.col("taken_at")).alias("a"), dates.date_from_name(dates.base_name(F.col("rel_path")), AS_OF_YEAR).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    days = F.floor((F.unix_timestamp(F.col("a").cast("timestamp")) - F.unix_timestamp(F.col("b").cast("timestamp"))) / 86400)
    return pair.agg(F.count_if(F.abs(days) > 7).alias("disagreements"), F.count("*").alias("comparable"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the same hash and size as another: the kept one is the oldest, then the first by path."""
    rows = views.photos(spark, sf_dir, "path", "size_bytes", "mtime", "quick_hash").where("quick_hash IS NOT NULL")
    return canonical(rows, ["quick_hash", "size_bytes"], "id", ["mtime", "path"]).select("id", "kept_id")


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the text of another: quick hash first, full hash among colliders only."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.octet_length("text").cast("long").alias("size"))
    return two_stage(rows, "doc_id", "text").select(F.col("doc_id"), F.col("kept_id").alias("kept_doc_id"))


def pending_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical candidates without a detection."""
    rows = views.photos(spark, sf_dir, "kind", "duplicate_of").where(F.col("duplicate_of").isNull() & F.col("kind").isin(files.WITH_FACES))
    return awaiting(rows.select("id"), table(spark, sf_dir, "faces").select(F.col("photo_id").alias("id")), ["id"])


def pending_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces without a vector of the second model."""
    done = table(spark, sf_dir, "face_embeddings").where("model = 'lite_a'").select("face_id")
    return awaiting(views.faces(spark, sf_dir, "photo_id").select(F.col("id").alias("face_id")), done, ["face_id"])


def unchanged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a listing that an earlier scan (all but the last day) has not seen at their size and time."""
    rows = table(spark, sf_dir, "photos").select("path", "size_bytes", "mtime", "scanned_at")
    last = rows.agg(F.max("scanned_at").alias("last"))
    known = rows.join(F.broadcast(last), F.col("scanned_at") < F.col("last") - F.expr("INTERVAL 1 DAY")).select("path", "size_bytes", "mtime")
    return unseen(rows.select("path", "size_bytes", "mtime").distinct(), known, ["path", "size_bytes", "mtime"])


QUERIES = {f.__name__: f for f in (kind_composition, duplicate_totals, year_histogram, date_provenance, camera_top, folder_dated, corpus_warnings, reject_extensions, path_inspection, classify_files, filename_dates, folder_years, date_backfill, date_disagreement, exact_duplicates, content_duplicates, pending_photos, pending_faces, unchanged_scan)}

_P = sql_with("cur_photos")
_YEAR = r"nullif(regexp_extract(taken_at, '^\s*(\d{4})[-:]', 1), '')"
_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.([^.]+)$', 1))"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
# RE2 has neither look-around nor back-references: the bounds are matched as characters, each separator on its own.
_SEPARATORS = ("", "-", "_", r"\.")
_BASE = "regexp_extract(rel_path, '[^/]*$')"


def _name_date_sql() -> str:
    found = []
    for s in _SEPARATORS:
        found.append(rf"regexp_extract({_BASE}, '(?:^|\D)((?:19|20)\d\d{s}(?:0[1-9]|1[0-2]){s}(?:0[1-9]|[12]\d|3[01]))(?:\D|$)', 1)")
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in found) + ")"


_NAMED = (
    rf"named AS (SELECT *, {_BASE} AS base, {_name_date_sql()} AS d FROM cur_photos), "
    r"rests AS (SELECT *, regexp_replace(d, '[-_.]', '', 'g') AS ymd, substr(base, strpos(base, d) + length(d)) AS rest FROM named), "
    r"clocks AS (SELECT *, coalesce(nullif(regexp_extract(rest, '(?:^|\D)((?:[01]\d|2[0-3])[0-5]\d[0-5]\d)\d{0,3}(?:\D|$)', 1), ''), "
    r"nullif(regexp_extract(rest, '(?:^|\D)((?:[01]\d|2[0-3])-[0-5]\d-[0-5]\d)\d{0,3}(?:\D|$)', 1), ''), nullif(regexp_extract(rest, '(?:^|\D)((?:[01]\d|2[0-3])_[0-5]\d_[0-5]\d)\d{0,3}(?:\D|$)', 1), ''), "
    r"nullif(regexp_extract(rest, '(?:^|\D)((?:[01]\d|2[0-3])\.[0-5]\d\.[0-5]\d)\d{0,3}(?:\D|$)', 1), ''), nullif(regexp_extract(rest, '(?:^|\D)((?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)\d{0,3}(?:\D|$)', 1), '')) AS t FROM rests), "
    rf"by_name AS (SELECT *, CASE WHEN ymd IS NOT NULL AND CAST(substr(ymd, 1, 4) AS INT) BETWEEN 1990 AND {AS_OF_YEAR + 1} THEN try_strptime(ymd || coalesce(regexp_replace(t, '\D', '', 'g'), '000000'), '%Y%m%d%H%M%S') END AS name_at FROM clocks)"
)
_FOLDER = (
    r"folders AS (SELECT id, list_reverse(string_split(rel_path, '/')[:-2]) AS parts FROM cur_photos), "
    rf"by_folder AS (SELECT id, list_filter(list_transform(parts, lambda x: regexp_extract(x, '(?:^|\D)(19[89]\d|20[0-4]\d)(?:\D|$)', 1)), lambda y: y <> '' AND CAST(nullif(y, '') AS INT) BETWEEN 1990 AND {AS_OF_YEAR + 1})[1] AS y FROM folders)"
)
_EXIF = "coalesce(try_strptime(substr(trim(replace({c}, chr(0), ''), ' '), 1, 19), '%Y:%m:%d %H:%M:%S'), try_strptime(substr(trim(replace({c}, chr(0), ''), ' '), 1, 19), '%Y-%m-%d %H:%M:%S'), try_strptime(upper(substr(trim(replace({c}, chr(0), ''), ' '), 1, 19)), '%Y-%m-%dT%H:%M:%S'))"
_F = "%Y-%m-%d %H:%M:%S"
ORACLE = {
    "kind_composition": _P + "SELECT kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) / sum(count(*)) OVER () AS share FROM cur_photos GROUP BY kind",
    "duplicate_totals": _P + "SELECT count(duplicate_of) AS duplicates, CAST(coalesce(sum(size_bytes) FILTER (WHERE duplicate_of IS NOT NULL), 0) AS BIGINT) AS duplicate_bytes, count(*) FILTER (WHERE duplicate_of IS NULL AND kind IN ('photo', 'forwarded')) AS unique_candidates FROM cur_photos",
    "year_histogram": _P + f"SELECT coalesce({_YEAR}, 'undated') AS year, count(*) AS photos FROM cur_photos WHERE duplicate_of IS NULL AND kind IN ('photo', 'forwarded') GROUP BY 1",
    "date_provenance": _P + "SELECT coalesce(taken_at_source, '(none)') AS source, count(*) AS photos, count(*) / sum(count(*)) OVER () AS share FROM cur_photos GROUP BY 1",
    "camera_top": _P + "SELECT trim(concat_ws(' ', camera_make, camera_model)) AS camera, count(*) AS photos FROM cur_photos WHERE camera_make IS NOT NULL OR camera_model IS NOT NULL GROUP BY 1 ORDER BY photos DESC, camera LIMIT 15",
    "folder_dated": _P + f"SELECT regexp_replace(rel_path, '/[^/]*$', '') AS folder, count(*) AS photos, count({_YEAR}) AS dated, count(*) - count({_YEAR}) AS undated FROM cur_photos GROUP BY 1 ORDER BY photos DESC, folder LIMIT 40",
    "corpus_warnings": sql_with("cur_photos", more=_NAMED).rstrip() + f", dd AS (SELECT count(*) FILTER (WHERE abs(floor((epoch(a) - epoch(name_at)) / 86400)) > 7) AS disagreements, count(*) AS comparable FROM (SELECT name_at, {_EXIF.format(c='taken_at')} AS a FROM by_name WHERE taken_at_source IN ('exif_original', 'exif_digitized')) WHERE a IS NOT NULL AND name_at IS NOT NULL) " + f"SELECT candidates, undated, years, cameras, unreadable, raw, archives, disagreements, comparable, unreadable > 0 AS has_unreadable, raw > 0 AS has_raw, archives > 0 AS has_archives, disagreements > comparable * 0.1 AS dates_disagree, undated > candidates * 0.25 AS mostly_undated, years < 3 AS few_years, cameras <= 1 AS one_camera FROM (SELECT count(*) FILTER (WHERE u) AS candidates, count(*) FILTER (WHERE u AND y IS NULL) AS undated, count(DISTINCT y) FILTER (WHERE u) AS years, count(DISTINCT concat_ws(' ', camera_make, camera_model)) FILTER (WHERE u) AS cameras, count(*) FILTER (WHERE kind = 'unreadable') AS unreadable, count(*) FILTER (WHERE kind = 'raw') AS raw, count(*) FILTER (WHERE kind = 'archive') AS archives FROM (SELECT *, kind IN ('photo', 'forwarded') AS u, {_YEAR} AS y FROM cur_photos)), dd",
    "reject_extensions": _P + f"SELECT kind, {_EXT} AS extension, count(*) AS files FROM cur_photos WHERE kind NOT IN ('photo', 'forwarded') GROUP BY 1, 2",
    "path_inspection": _P + f"SELECT kind, count(*) AS files, count({_YEAR}) AS dated, min(path) AS first_path FROM cur_photos WHERE path ILIKE '%backup%' GROUP BY kind",
    "classify_files": _P + rf"""SELECT id, CASE WHEN {_EXT} IN {_IN(files.VIDEO)} THEN 'video' WHEN {_EXT} IN {_IN(files.AUDIO)} THEN 'audio' WHEN {_EXT} IN {_IN(files.ARCHIVE)} THEN 'archive' WHEN {_EXT} IN {_IN(files.RAW)} THEN 'raw' WHEN {_EXT} NOT IN {_IN(files.IMAGE)} THEN 'unsupported'
        WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)-wa\d{{4}}|^photo_\d{{4}}-\d{{2}}-\d{{2}}|^img-\d{{8}}-wa') OR contains(lower(regexp_replace(path, '[^/]*$', '')), 'whatsapp') THEN 'forwarded'
        WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)screen[\s_-]?shot') THEN 'screenshot' WHEN coalesce(width, 0)::BIGINT * coalesce(height, 0) < 10000 THEN 'tiny'
        WHEN image_format = 'PNG' AND coalesce(camera_make, '') = '' AND coalesce(camera_model, '') = '' THEN 'screenshot' ELSE 'photo' END AS kind FROM cur_photos""",
    "filename_dates": sql_with("cur_photos", more=_NAMED) + f"SELECT id, strftime(name_at, '{_F}') AS taken_at FROM by_name WHERE name_at IS NOT NULL",
    "folder_years": sql_with("cur_photos", more=_FOLDER) + "SELECT id, y || '-01-01 00:00:00' AS taken_at FROM by_folder WHERE y IS NOT NULL",
    "date_backfill": sql_with("cur_photos", more=_NAMED + ", " + _FOLDER) + f"SELECT n.id, CASE WHEN name_at IS NOT NULL THEN strftime(name_at, '{_F}') WHEN e IS NOT NULL THEN strftime(e, '{_F}') ELSE y || '-01-01 00:00:00' END AS taken_at, CASE WHEN name_at IS NOT NULL THEN 'filename' WHEN e IS NOT NULL THEN 'exif_modified' ELSE 'folder' END AS source FROM (SELECT *, {_EXIF.format(c='exif_modified_at')} AS e FROM by_name) n JOIN by_folder f ON n.id = f.id WHERE taken_at IS NULL AND kind NOT IN ('unreadable', 'unsupported', 'video', 'audio', 'archive') AND (name_at IS NOT NULL OR e IS NOT NULL OR y IS NOT NULL)",
    "date_disagreement": sql_with("cur_photos", more=_NAMED) + f"SELECT count(*) FILTER (WHERE abs(floor((epoch(a) - epoch(name_at)) / 86400)) > 7) AS disagreements, count(*) AS comparable FROM (SELECT name_at, {_EXIF.format(c='taken_at')} AS a FROM by_name WHERE taken_at_source IN ('exif_original', 'exif_digitized')) WHERE a IS NOT NULL AND name_at IS NOT NULL",
    "exact_duplicates": _P + "SELECT id, kept_id FROM (SELECT id, first_value(id) OVER (PARTITION BY quick_hash, size_bytes ORDER BY mtime, path, id) AS kept_id FROM cur_photos WHERE quick_hash IS NOT NULL) WHERE id <> kept_id",
    "content_duplicates": "SELECT doc_id, kept_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept_doc_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> kept_doc_id",
    "pending_photos": _P + "SELECT id FROM cur_photos WHERE duplicate_of IS NULL AND kind IN ('photo', 'forwarded') AND NOT EXISTS (SELECT 1 FROM faces WHERE photo_id = cur_photos.id)",
    "pending_faces": sql_with("cur_faces") + "SELECT id AS face_id FROM cur_faces WHERE NOT EXISTS (SELECT 1 FROM face_embeddings e WHERE e.face_id = cur_faces.id AND model = 'lite_a')",
    "unchanged_scan": "WITH known AS (SELECT path, size_bytes, mtime FROM photos WHERE scanned_at < (SELECT max(scanned_at) FROM photos) - INTERVAL 1 DAY) SELECT DISTINCT path, size_bytes, mtime FROM photos p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = p.path AND k.size_bytes = p.size_bytes AND k.mtime = p.mtime)",
}
