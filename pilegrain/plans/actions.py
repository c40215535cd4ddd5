"""Queries of what a reviewer writes: refused merges, removed and split faces, skips, names, labels, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.operators import edits, review
from pilegrain.operators.scalars import side_by_side
from pilegrain.sources import scan, views
from pilegrain.sources.tables import table
from pilegrain.sources.views import sql_with

AT = "2030-01-01 00:00:00"


def _at():
    return F.to_timestamp_ntz(F.lit(AT))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.state(views.decisions(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pool(spark, sf_dir).select("face_id", F.col("cluster_id").alias("pile_id"))


def _doubted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, pile_id): the first person of each pile that holds a face set aside; stands for what a reviewer refuses."""
    held = _members(spark, sf_dir).where("pile_id <> -1").join(_now(spark, sf_dir), "face_id")
    each = held.groupBy("pile_id").agg(F.min(F.when(F.col("kind") == "person", F.col("person_id"))).alias("person_id"), F.bool_or(F.col("kind") == "junk").alias("junk"))
    return each.where("junk AND person_id IS NOT NULL").select("person_id", "pile_id")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return edits.refused(_doubted(spark, sf_dir), members, _at(), "refusal")


def reject_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that refusing each doubted pair writes."""
    return refusals(spark, sf_dir).select("face_id", "person_id", "batch")


def refused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused (person, pile) pairs, found again from the faces."""
    return edits.refused_pairs(refusals(spark, sf_dir), _members(spark, sf_dir))


def _largest(spark: SparkSession, sf_dir: str) -> str:
    first = review.people_counts(_now(spark, sf_dir)).orderBy(F.desc("faces"), "person_id").first()
    return first["person_id"] if first else ""


def faces_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, faces, open, refused): people after every face with an even id was asked to be taken from the largest one."""
    log = views.decisions(spark, sf_dir).withColumn("batch", F.lit("old"))
    now, person = review.state(log), _largest(spark, sf_dir)
    rows, never = edits.removed(_members(spark, sf_dir).where("face_id % 2 = 0").select("face_id"), now, person, _at(), "removal")
    after = review.state(log.unionByName(rows))
    left = after.where("kind = 'person'").groupBy("person_id").agg(F.count("*").alias("faces"))
    gone = never.groupBy("person_id").agg(F.count("*").alias("refused"))
    return left.join(gone, "person_id", "full").select("person_id", F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("refused", F.lit(0)).alias("refused")).where("person_id IS NOT NULL")


def person_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of people after the faces of the largest one with an odd id went to a new one."""
    log = views.decisions(spark, sf_dir).withColumn("batch", F.lit("old"))
    rows = edits.split_off(_members(spark, sf_dir).where("face_id % 2 = 1").select("face_id"), review.state(log), _largest(spark, sf_dir), "split off", _at(), "split")
    return review.people_counts(review.state(log.unionByName(rows))).select("person_id", "faces")


def set_aside_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces by kind before, after lone faces were set aside, and after everything set aside was opened again."""
    log = views.decisions(spark, sf_dir).withColumn("batch", F.lit("old"))
    lone = _members(spark, sf_dir).where("pile_id = -1").select("face_id")
    aside = log.unionByName(edits.set_aside(lone, _at(), "aside"))
    back = aside.unionByName(edits.restored(lone, review.state(aside), _at() + F.expr("INTERVAL 1 HOUR"), "back"))
    steps = [review.state(x).groupBy("kind").agg(F.count("*").alias("faces")).withColumn("step", F.lit(i)) for i, x in enumerate((log, aside, back))]
    return steps[0].union(steps[1]).union(steps[2]).select("step", "kind", "faces")


def _skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pile_id, at, batch): a face judged unsure stands for a skip of its pile."""
    unsure = table(spark, sf_dir, "gold_labels").where("label = 'unsure' AND face_id IS NOT NULL").select("face_id", F.col("labelled_at").alias("at"))
    return unsure.join(_members(spark, sf_dir).where("pile_id <> -1"), "face_id").select("pile_id", "at", F.lit("skip").alias("batch"))


def skip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles that are skipped at the moment."""
    return edits.skipped(_skips(spark, sf_dir), views.decisions(spark, sf_dir), _members(spark, sf_dir)).select("pile_id", F.col("at").cast("string").alias("skipped_at"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, name): everyone decided so far, named by the id as written."""
    return _now(spark, sf_dir).where("kind = 'person' AND person_id IS NOT NULL").select("person_id", F.col("person_id").alias("name")).distinct()


def resolve_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person of every id as it was ever written."""
    written = table(spark, sf_dir, "gold_labels").where("label = 'person'").select(F.col("person_id").alias("name"))
    return edits.resolved(written, _people(spark, sf_dir))


def rename_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of everyone to the digits of the id: blank where there are none, a clash where two have the same."""
    known = _people(spark, sf_dir)
    return edits.renamed(known.select("person_id", F.regexp_replace("name", r"\D+", "").alias("name")), known)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold_labels").select("face_id", "label", "person_id", F.col("labelled_at").alias("at"))


def labels_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces by label after every written label went through the check of a save."""
    held = edits.saved(_labels(spark, sf_dir).limit(0), _labels(spark, sf_dir))
    return held.groupBy("label").agg(F.count("*").alias("faces"), F.countDistinct("person_id").alias("people"))


def labels_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written labels that a save refuses, by fault."""
    return edits.checked(_labels(spark, sf_dir)).where("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("entries"))


def labels_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels left after those of every junk face of the newest hundred were undone."""
    held = views.gold(spark, sf_dir).select("face_id", "label", "person_id")
    newest = edits.cleared(table(spark, sf_dir, "gold_labels").where("face_id IS NOT NULL").groupBy("face_id").agg(F.max("labelled_at").alias("at")), last=100)
    return edits.unlabelled(held, newest).groupBy("label").agg(F.count("*").alias("faces"))


def labels_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that each way of clearing would clear."""
    held = views.gold(spark, sf_dir).select("face_id", "label", "person_id")
    person = _largest(spark, sf_dir)
    ways = {"all": edits.cleared(held), "label": edits.cleared(held, label="unsure"), "person": edits.cleared(held, person=person.upper()), "cluster": edits.cleared(held, clusters=_members(spark, sf_dir).where("pile_id = 1"))}
    rows = [x.agg(F.lit(w).alias("way"), F.count("*").alias("faces")) for w, x in ways.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def people_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of each person after ids that differ in case were merged into the smallest."""
    held = views.gold(spark, sf_dir).where("label = 'person' AND person_id IS NOT NULL").select("face_id", "person_id")
    into = held.groupBy(edits.folded(F.col("person_id")).alias("old")).agg(F.min("person_id").alias("new"))
    return edits.merged_people(held, into).groupBy("person_id").agg(F.count("*").alias("faces"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching runs, the newest marked."""
    return edits.runs(table(spark, sf_dir, "face_matches"), "run_id", "matched_at").select("run", "n_rows", F.col("last").cast("string").alias("last_at"), "latest")


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: faces, decided faces, people, people whose id holds a letter, piles skipped at the moment."""
    now, members = _now(spark, sf_dir), _members(spark, sf_dir)
    named = now.agg(F.countDistinct(F.when((F.col("kind") == "person") & F.col("person_id").rlike("[A-Za-z]"), F.col("person_id"))).alias("people_named"))
    skips = edits.skipped(_skips(spark, sf_dir), views.decisions(spark, sf_dir), members).agg(F.count("*").alias("piles_skipped"))
    return side_by_side(review.progress(members, now), named, skips)


def next_unskipped_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pile with an open face that is not skipped."""
    now, members = _now(spark, sf_dir), _members(spark, sf_dir)
    faces = views.faces(spark, sf_dir, "interocular_px").withColumnRenamed("id", "face_id")
    skips = edits.skipped(_skips(spark, sf_dir), views.decisions(spark, sf_dir), members)
    return review.next_pile(review.ranked_piles(members, faces), review.open_faces(members, now), skips).select("pile_id", "faces", "rank")


def pile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty-four piles in review order."""
    faces = views.faces(spark, sf_dir, "interocular_px").withColumnRenamed("id", "face_id")
    return review.page(review.ranked_piles(_members(spark, sf_dir), faces), "rank", 2, 24).select("pile_id", "faces", "rank")


def photos_rescanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and copies left when every file with an even id was scanned again: copies of the rescanned are told anew."""
    old = views.photos(spark, sf_dir, "path", "duplicate_of")
    after = scan.upsert_photos(old, old.where("id % 2 = 0").drop("duplicate_of"), "id")
    return after.agg(F.count("*").alias("photos"), F.count("duplicate_of").alias("copies"))


def photos_awaiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept photos with no status of the detector at hand; a photo without faces has a status too."""
    photos = views.photos(spark, sf_dir, "kind", "duplicate_of").where("duplicate_of IS NULL AND kind IN ('photo', 'forwarded')").select("id")
    seen = table(spark, sf_dir, "faces").where("photo_id IS NOT NULL").select(F.col("photo_id").alias("id"), F.coalesce("detector", F.lit("?")).alias("version"), F.lit(None).cast("string").alias("fault")).distinct()
    newest = seen.agg(F.max("version")).first()[0] or "?"
    empty = photos.where("id % 7 = 0")  # stands for photos in which the detector found nothing
    return scan.pending(photos, scan.mark_done(seen, empty, "id", newest), "id", newest)


QUERIES = {f.__name__: f for f in (reject_merge, refused_pairs, faces_removed, person_split, set_aside_and_restored, skip_state, resolve_person, rename_person, labels_saved, labels_refused, labels_undone, labels_cleared, people_merged, runs, review_progress, next_unskipped_pile, pile_page, photos_rescanned, photos_awaiting)}

_NOW = "now AS (SELECT face_id, kind, person_id FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY at_time DESC NULLS LAST, kind DESC, person_id DESC NULLS LAST) AS r FROM log) WHERE r = 1)"
_MEM = "members AS (SELECT face_id, cluster_id AS pile_id FROM cur_pool)"
_DOUBT = "doubt AS (SELECT pile_id, min(CASE WHEN kind = 'person' THEN person_id END) AS person_id FROM members JOIN now USING (face_id) WHERE pile_id <> -1 GROUP BY pile_id HAVING bool_or(kind = 'junk') AND min(CASE WHEN kind = 'person' THEN person_id END) IS NOT NULL)"
_BASE = sql_with("log", "cur_pool", more=", ".join((_NOW, _MEM, _DOUBT, "big AS (SELECT person_id FROM now WHERE kind = 'person' AND person_id IS NOT NULL GROUP BY person_id ORDER BY count(*) DESC, person_id LIMIT 1)")))
_GOLD = sql_with("cur_gold", "log", "cur_pool", more=", ".join((_NOW, _MEM, "big AS (SELECT person_id FROM now WHERE kind = 'person' AND person_id IS NOT NULL GROUP BY person_id ORDER BY count(*) DESC, person_id LIMIT 1)")))
_SKIPPED = "sk AS (SELECT pile_id, max(labelled_at) AS at_time FROM gold_labels JOIN members USING (face_id) WHERE label = 'unsure' AND pile_id <> -1 GROUP BY pile_id), dc AS (SELECT pile_id, max(at_time) AS d FROM log JOIN members USING (face_id) WHERE kind <> 'unassigned' GROUP BY pile_id), skp AS (SELECT pile_id FROM sk LEFT JOIN dc USING (pile_id) WHERE d IS NULL OR d < at_time)"
_RANKS = sql_with("log", "cur_pool", "cur_faces", more=", ".join((_NOW, _MEM, _SKIPPED, "pl AS (SELECT pile_id, count(*) AS faces, quantile_cont(interocular_px, 0.5) AS eye FROM members JOIN cur_faces ON id = face_id WHERE pile_id <> -1 GROUP BY pile_id HAVING count(*) >= 2), sc AS (SELECT *, CAST(round(log10(faces + 1) * least(greatest(coalesce(eye / 50, 0), 0), 1) * least(greatest(coalesce(eye / 50, 0), 0), 1) * 1e6) AS BIGINT) AS score FROM pl), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, faces DESC, pile_id) AS rank FROM sc)")))
_FAULT = "CASE WHEN face_id IS NULL THEN 'no face' WHEN label IS NULL OR lower(trim(label, ' ')) NOT IN ('person', 'not_of_interest', 'non_face', 'unsure') THEN 'unknown label' WHEN lower(trim(label, ' ')) = 'person' AND coalesce(trim(person_id, ' '), '') = '' THEN 'person without id' WHEN lower(trim(label, ' ')) <> 'person' AND coalesce(trim(person_id, ' '), '') <> '' THEN 'id without person' END"
ORACLE = {
    "reject_merge": _BASE + "SELECT m.face_id, d.person_id, 'refusal' AS batch FROM members m JOIN doubt d USING (pile_id)",
    "refused_pairs": _BASE + "SELECT DISTINCT d.person_id, m.pile_id FROM members m JOIN doubt d USING (pile_id)",
    "faces_removed": _BASE + "SELECT person_id, count(*) FILTER (WHERE NOT gone) AS faces, count(*) FILTER (WHERE gone) AS refused FROM (SELECT n.person_id, n.person_id = (SELECT person_id FROM big) AND n.face_id % 2 = 0 AND n.face_id IN (SELECT face_id FROM members) AS gone FROM now n WHERE kind = 'person' AND person_id IS NOT NULL) GROUP BY person_id",
    "person_split": _BASE + "SELECT CASE WHEN person_id = (SELECT person_id FROM big) AND face_id % 2 = 1 AND face_id IN (SELECT face_id FROM members) THEN 'split off' ELSE person_id END AS person_id, count(*) AS faces FROM now WHERE kind = 'person' AND person_id IS NOT NULL GROUP BY 1",
    "set_aside_and_restored": _BASE + ", lone AS (SELECT face_id FROM members WHERE pile_id = -1), al AS (SELECT face_id, kind FROM now UNION SELECT face_id, NULL FROM lone), st AS (SELECT face_id, max(kind) AS k0, bool_or(face_id IN (SELECT face_id FROM lone)) AS l FROM al GROUP BY face_id) SELECT 0 AS step, k0 AS kind, count(*) AS faces FROM st WHERE k0 IS NOT NULL GROUP BY ALL UNION ALL SELECT 1, CASE WHEN l THEN 'junk' ELSE k0 END, count(*) FROM st GROUP BY ALL UNION ALL SELECT 2, CASE WHEN l THEN 'unassigned' ELSE k0 END, count(*) FROM st GROUP BY ALL",
    "skip_state": _BASE + ", sk AS (SELECT pile_id, max(labelled_at) AS at_time FROM gold_labels JOIN members USING (face_id) WHERE label = 'unsure' AND pile_id <> -1 GROUP BY pile_id), dc AS (SELECT pile_id, max(at_time) AS d FROM log JOIN members USING (face_id) WHERE kind <> 'unassigned' GROUP BY pile_id) SELECT pile_id, rtrim(rtrim(strftime(at_time, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS skipped_at FROM sk LEFT JOIN dc USING (pile_id) WHERE d IS NULL OR d < at_time",
    "resolve_person": _BASE + ", kn AS (SELECT lower(trim(person_id, ' ')) AS k, min(person_id) AS person_id FROM now WHERE kind = 'person' AND person_id IS NOT NULL GROUP BY 1), w AS (SELECT DISTINCT trim(person_id, ' ') AS name FROM gold_labels WHERE label = 'person' AND trim(person_id, ' ') <> '') SELECT name, coalesce(kn.person_id, lower(name)) AS person_id, kn.person_id IS NULL AS created FROM w LEFT JOIN kn ON kn.k = lower(name)",
    "rename_person": _BASE + r", kn AS (SELECT DISTINCT person_id, person_id AS old, regexp_replace(person_id, '\D+', '', 'g') AS name FROM now WHERE kind = 'person' AND person_id IS NOT NULL), tk AS (SELECT lower(trim(old, ' ')) AS k, person_id FROM kn UNION SELECT lower(name), person_id FROM kn), hd AS (SELECT k, count(*) AS n FROM tk GROUP BY k) SELECT person_id, CASE WHEN outcome = 'renamed' THEN name ELSE old END AS name, outcome FROM (SELECT kn.*, CASE WHEN name = '' THEN 'blank' WHEN hd.n > 1 THEN 'clash' ELSE 'renamed' END AS outcome FROM kn LEFT JOIN hd ON hd.k = lower(kn.name))",
    "labels_saved": f"SELECT label, count(*) AS faces, count(DISTINCT person_id) AS people FROM (SELECT face_id, lower(trim(label, ' ')) AS label, nullif(trim(person_id, ' '), '') AS person_id, row_number() OVER (PARTITION BY face_id ORDER BY labelled_at DESC NULLS LAST, lower(trim(label, ' ')) DESC, person_id DESC NULLS LAST) AS r FROM gold_labels WHERE {_FAULT} IS NULL) WHERE r = 1 GROUP BY label",
    "labels_refused": f"SELECT fault, count(*) AS entries FROM (SELECT {_FAULT} AS fault FROM gold_labels) WHERE fault IS NOT NULL GROUP BY fault",
    "labels_undone": sql_with("cur_gold", more="nw AS (SELECT face_id FROM (SELECT face_id, max(labelled_at) AS t FROM gold_labels WHERE face_id IS NOT NULL GROUP BY face_id) ORDER BY t DESC NULLS LAST, face_id LIMIT 100)") + "SELECT label, count(*) AS faces FROM cur_gold WHERE face_id NOT IN (SELECT face_id FROM nw) GROUP BY label",
    "labels_cleared": _GOLD + "SELECT 'all' AS way, count(*) AS faces FROM cur_gold UNION ALL SELECT 'label', count(*) FROM cur_gold WHERE label = 'unsure' UNION ALL SELECT 'person', count(*) FROM cur_gold WHERE lower(trim(person_id, ' ')) = (SELECT lower(trim(person_id, ' ')) FROM big) UNION ALL SELECT 'cluster', count(*) FROM cur_gold WHERE face_id IN (SELECT face_id FROM members WHERE pile_id = 1)",
    "people_merged": sql_with("cur_gold", more="p AS (SELECT face_id, person_id FROM cur_gold WHERE label = 'person' AND person_id IS NOT NULL)") + "SELECT k.new AS person_id, count(*) AS faces FROM p JOIN (SELECT lower(trim(person_id, ' ')) AS k, min(person_id) AS new FROM p GROUP BY 1) k ON k.k = lower(trim(p.person_id, ' ')) GROUP BY 1",
    "runs": "SELECT run, n_rows, rtrim(rtrim(strftime(l, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS last_at, row_number() OVER (ORDER BY l DESC NULLS LAST, run DESC) = 1 AS latest FROM (SELECT run_id AS run, count(*) AS n_rows, max(matched_at) AS l FROM face_matches WHERE run_id IS NOT NULL GROUP BY run_id)",
    "review_progress": _RANKS + "SELECT (SELECT count(*) FROM members) AS faces_total, count(*) FILTER (WHERE kind <> 'unassigned') AS faces_decided, count(DISTINCT CASE WHEN kind = 'person' THEN person_id END) AS people_known, count(DISTINCT CASE WHEN kind = 'person' AND regexp_matches(person_id, '[A-Za-z]') THEN person_id END) AS people_named, (SELECT count(*) FROM skp) AS piles_skipped FROM now",
    "next_unskipped_pile": _RANKS + "SELECT pile_id, faces, rank FROM ranked WHERE pile_id IN (SELECT pile_id FROM members LEFT JOIN now USING (face_id) WHERE kind IS NULL OR kind = 'unassigned') AND pile_id NOT IN (SELECT pile_id FROM skp) ORDER BY rank LIMIT 1",
    "pile_page": _RANKS + "SELECT pile_id, faces, rank FROM ranked WHERE rank BETWEEN 25 AND 48",
    "photos_rescanned": sql_with("cur_photos") + "SELECT count(*) AS photos, count(CASE WHEN id % 2 = 1 THEN duplicate_of END) AS copies FROM cur_photos",
    "photos_awaiting": sql_with("cur_photos", more="nw AS (SELECT max(coalesce(detector, '?')) AS v FROM faces WHERE photo_id IS NOT NULL)") + "SELECT id FROM cur_photos WHERE duplicate_of IS NULL AND kind IN ('photo', 'forwarded') AND id % 7 <> 0 AND id NOT IN (SELECT photo_id FROM faces, nw WHERE photo_id IS NOT NULL AND coalesce(detector, '?') = v)",
}
