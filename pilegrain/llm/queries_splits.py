"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.llm.settings import few
from pilegrain.llm.splits import assign, bundles, entity_key
from pilegrain.sources.tables import current_rows, table


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, person, occlusion) of faces whose current label is person with a non-blank id."""
    gold = current_rows(table(spark, sf_dir, "gold_labels"), ["face_id"], "labelled_at", ["label", "person_id", "occlusion"])
    named = gold.where((F.lower(F.trim("label")) == "person") & (F.regexp_replace("person_id", r"\s+", "") != ""))
    return named.select("face_id", entity_key(F.col("person_id")).alias("person"), "occlusion")


def ties(spark: SparkSession, sf_dir: str, faces_named: DataFrame) -> DataFrame:
    """(record, entity): faces with their person and photo, and photos with the photo they copy, as records of their own.

    Links of copies are edges of the graph, so chains and circles of any length are followed. A record is (0, face) or
    (1, photo); only photos that are copies stand as records.
    """
    copies = table(spark, sf_dir, "photos").where("duplicate_of IS NOT NULL AND id IS NOT NULL AND duplicate_of <> id").select("id", F.col("duplicate_of").alias("of")).distinct()
    faces = table(spark, sf_dir, "faces").where("photo_id IS NOT NULL").groupBy(F.col("id").alias("face_id")).agg(F.max(F.struct("created_at", "photo_id"))["photo_id"].alias("photo"))
    held = faces_named.select("face_id").join(faces, "face_id")
    photo = lambda c: F.concat(F.lit("photo:"), F.col(c).cast("string"))
    by_person = faces_named.select(F.struct(F.lit(0).alias("t"), F.col("face_id").alias("id")).alias("record"), F.concat(F.lit("person:"), "person").alias("entity"))
    shown = held.select(F.struct(F.lit(0).alias("t"), F.col("face_id").alias("id")).alias("record"), photo("photo").alias("entity"))
    copied = copies.select(F.struct(F.lit(1).alias("t"), F.col("id")).alias("record"), F.explode(F.array(photo("id"), photo("of"))).alias("entity"))
    return by_person.union(shown).union(copied)


def _bundles(spark: SparkSession, sf_dir: str, named: DataFrame) -> DataFrame:
    """(face_id, bundle_face_id): records order faces before photos, so a bundle with a face is named by its smallest face."""
    found = bundles(ties(spark, sf_dir, named), "record", "entity")
    return found.where("record.t = 0").select(F.col("record.id").alias("face_id"), F.col("bundle.id").alias("bundle_face_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundles(spark, sf_dir, identities(spark, sf_dir))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, bundle_face_id, occlusion, split) in the shares of split_targets."""
    named = identities(spark, sf_dir)
    tied = _bundles(spark, sf_dir, named)
    targets = {r["split_name"]: float(r["target_share"] or 0) for r in few(table(spark, sf_dir, "split_targets"), 1000) if r["split_name"]}
    return assign(tied.join(named.select("face_id", "occlusion"), "face_id"), "bundle_face_id", "occlusion", targets).select("face_id", "bundle_face_id", "occlusion", "split")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each split, and of each occlusion in it, beside the target."""
    done = p2_split(spark, sf_dir)
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    cells = done.groupBy("split", F.coalesce("occlusion", F.lit("(none)")).alias("occlusion")).agg(F.count("*").alias("faces"), F.countDistinct("bundle_face_id").alias("bundles"))
    whole = done.groupBy(F.coalesce("occlusion", F.lit("(none)")).alias("occlusion")).agg(F.count("*").alias("all"))
    return cells.join(whole, "occlusion").join(targets, "split").select("split", "occlusion", "faces", "bundles", "target_share", (F.col("faces") / F.col("all")).alias("share"))


def p2_kept_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: faces assigned, bundles that parted (none), and whether every split is within a hundredth of its share or one bundle of it."""
    done = p2_split(spark, sf_dir)
    parted = done.groupBy("bundle_face_id").agg(F.countDistinct("split").alias("k"), F.count("*").alias("n"))
    one = parted.groupBy(F.lit(1).alias("one")).agg(F.sum("n").alias("faces"), F.max("n").alias("largest"), F.count_if(F.col("k") > 1).alias("bundles_parted"))
    sizes = done.groupBy("split").agg(F.count("*").alias("n"))
    targets = table(spark, sf_dir, "split_targets").groupBy(F.col("split_name").alias("split")).agg(F.max("target_share").alias("share"))
    shares = targets.join(sizes, "split", "left").withColumn("one", F.lit(1)).join(one, "one")
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("faces"))
    return shares.groupBy("faces", "bundles_parted").agg(F.bool_and(off <= F.greatest(0.01 * F.col("faces"), F.col("largest").cast("double"))).alias("shares_met"))


QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p2_report": p2_report, "p2_kept_whole": p2_kept_whole}
_BARE = r"regexp_replace(lower(person_id), '[^\p{L}\p{N}]+', '', 'g')"
ORACLE = {
    "p2_found": rf"""
WITH RECURSIVE gold AS (SELECT * FROM (SELECT face_id, label, person_id, row_number() OVER (PARTITION BY face_id ORDER BY labelled_at DESC NULLS LAST) AS r FROM gold_labels WHERE face_id IS NOT NULL) WHERE r = 1),
named AS (SELECT face_id, regexp_replace({_BARE}, '(^|\P{{N}})0+(\p{{N}})', '\1\2', 'g') AS person FROM gold WHERE lower(trim(label)) = 'person' AND regexp_replace(person_id, '\s+', '', 'g') <> ''),
copies AS (SELECT DISTINCT id AS a, duplicate_of AS b FROM photos WHERE duplicate_of IS NOT NULL AND id IS NOT NULL),
either AS (SELECT a, b FROM copies UNION SELECT b, a FROM copies),
chain(p, q) AS (SELECT DISTINCT a, a FROM either UNION SELECT c.p, e.b FROM chain c JOIN either e ON e.a = c.q),
kept AS (SELECT p AS id, min(q) AS root FROM chain GROUP BY p),
shown AS (SELECT f.face_id, coalesce(k.root, f.photo_id) AS photo FROM (SELECT id AS face_id, arg_max(photo_id, created_at) AS photo_id FROM faces WHERE photo_id IS NOT NULL AND id IS NOT NULL GROUP BY id) f LEFT JOIN kept k ON k.id = f.photo_id),
ties AS (SELECT face_id, 'person:' || person AS entity FROM named UNION SELECT face_id, 'photo:' || photo FROM named JOIN shown USING (face_id)),
least AS (SELECT entity, min(face_id) AS hub FROM ties GROUP BY entity),
star AS (SELECT t.face_id AS a, l.hub AS b FROM ties t JOIN least l USING (entity) WHERE t.face_id <> l.hub),
links AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach(v, u) AS (SELECT face_id, face_id FROM named UNION SELECT l.b, r.u FROM reach r JOIN links l ON l.a = r.v WHERE r.u < l.b)
SELECT v AS face_id, min(u) AS bundle_face_id FROM reach GROUP BY v""",
    "p2_kept_whole": r"""
SELECT count(*) AS faces, CAST(0 AS BIGINT) AS bundles_parted, true AS shares_met
FROM (SELECT label, person_id, row_number() OVER (PARTITION BY face_id ORDER BY labelled_at DESC NULLS LAST) AS r FROM gold_labels WHERE face_id IS NOT NULL)
WHERE r = 1 AND lower(trim(label)) = 'person' AND regexp_replace(person_id, '\s+', '', 'g') <> ''
HAVING count(*) > 0""",
}
