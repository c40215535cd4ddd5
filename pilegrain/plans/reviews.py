"""Queries of the review: state, piles, coverage, labels, pool statistics, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pilegrain.functions import geometry
from pilegrain.operators import review
from pilegrain.operators.scalars import with_scalars
from pilegrain.plans.scores import micro
from pilegrain.session import cut
from pilegrain.sources import views
from pilegrain.sources.tables import table
from pilegrain.sources.views import sql_with


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.state(views.decisions(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pool(spark, sf_dir).select("face_id", F.col("cluster_id").alias("pile_id"))


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.faces(spark, sf_dir, "interocular_px", "det_score", "blur", "photo_id").withColumnRenamed("id", "face_id")


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _now(spark, sf_dir).select("face_id", "kind", "person_id")


def undo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the newest batch (an hour of labelling) is undone."""
    log = views.decisions(spark, sf_dir).withColumn("batch", F.date_trunc("hour", F.col("at").cast("timestamp")).cast("string"))
    newest = review.newest_batch(log).select("batch")
    return review.state(review.standing(log, newest)).select("face_id", "kind", "person_id")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress(_members(spark, sf_dir), _now(spark, sf_dir))


def people_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone ever decided with the faces held now, also none, and the clearest of them."""
    log = views.decisions(spark, sf_dir)
    return review.people_counts(review.state(log), log.where("kind = 'person' AND person_id IS NOT NULL"), _faces(spark, sf_dir))


def search_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty largest people whose id holds 12, in any case."""
    return review.people_counts(_now(spark, sf_dir)).where(F.lower("person_id").contains("12")).orderBy(F.desc("faces"), "person_id").limit(40)


def pile_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.attribution(_members(spark, sf_dir), _now(spark, sf_dir))


def open_per_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.open_faces(_members(spark, sf_dir), _now(spark, sf_dir)).groupBy("pile_id").agg(F.count("*").alias("open"))


def _piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ranked_piles(_members(spark, sf_dir), _faces(spark, sf_dir))


def pile_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piles(spark, sf_dir).select("pile_id", "faces", "score", "rank")


def next_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = review.open_faces(_members(spark, sf_dir), _now(spark, sf_dir))
    return review.next_pile(_piles(spark, sf_dir), opened).select("pile_id", "faces", "rank")


def person_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve clearest faces of every person."""
    held = _now(spark, sf_dir).where("kind = 'person' AND person_id IS NOT NULL").select("face_id", "person_id")
    return review.best_faces(held, _faces(spark, sf_dir), "person_id", 12)


def pile_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty-four faces of every pile in display order."""
    return review.best_faces(_members(spark, sf_dir).where("pile_id <> -1"), _faces(spark, sf_dir), "pile_id", 24)


def junk_and_lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, now = _members(spark, sf_dir), _now(spark, sf_dir)
    both = [review.bucket_of(members, now, k).select(F.lit(k).alias("bucket"), "face_id") for k in ("junk", "lone")]
    return both[0].union(both[1])


def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage(_piles(spark, sf_dir), _members(spark, sf_dir), _faces(spark, sf_dir))


def piles_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, faces = _members(spark, sf_dir), _faces(spark, sf_dir)
    return review.piles_needed(cut(coverage_curve(spark, sf_dir)), members, faces, [0.5, 0.7, 0.8, 0.9, 0.95])


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gold(spark, sf_dir).groupBy("label").agg(F.count("*").alias("faces"), F.countDistinct("person_id").alias("people"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by eye distance band, pivoted by the four labels."""
    eye = F.coalesce("interocular_px", F.lit(0.0))
    band = F.when(eye < 20, "tiny").when(eye < 40, "small").when(eye < 80, "medium").otherwise("large")
    rows = views.gold(spark, sf_dir).join(_faces(spark, sf_dir), "face_id")
    return rows.groupBy(band.alias("band")).agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("person", "not_of_interest", "non_face", "unsure")])


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.nullif(F.regexp_extract("taken_at", r"^\s*(\d{4})[-:]", 1), F.lit("")).cast("int")
    photos = views.photos(spark, sf_dir, "taken_at").select(F.col("id").alias("photo_id"), year.alias("year")).where("year IS NOT NULL")
    named = views.gold(spark, sf_dir).where("label = 'person' AND person_id IS NOT NULL").select("face_id", "person_id")
    return named.join(_faces(spark, sf_dir).select("face_id", "photo_id"), "face_id").join(photos, "photo_id")


def person_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dated(spark, sf_dir).groupBy("person_id").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    gap = F.col("last") - F.col("first")
    return rows.withColumn("band", F.when(gap >= 15, "15+").when(gap >= 10, "10-14").when(gap >= 5, "5-9").when(gap >= 1, "1-4").otherwise("0"))


def validation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of flags on the labelled set."""
    gold = views.gold(spark, sf_dir)
    people = gold.where("label = 'person' AND person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("n"))
    from pilegrain.operators.scalars import side_by_side

    spans = person_spans(spark, sf_dir).agg(F.count_if(F.col("last") - F.col("first") >= 5).alias("spans5"), F.count_if(F.col("last") - F.col("first") >= 10).alias("spans10"))
    one = side_by_side(gold.agg(F.count_if(F.col("label") == "person").alias("faces"), F.count_if(F.col("label") == "not_of_interest").alias("strangers")), people.agg(F.count("*").alias("people"), F.count_if(F.col("n") < 2).alias("singletons")), spans)
    return one.select("*", (F.col("people") < 25).alias("few_people"), (F.col("faces") < 1000).alias("few_faces"), (F.col("strangers") < 100).alias("few_strangers"), (F.col("singletons") > F.col("people") * 0.5).alias("many_singletons"), (F.col("spans5") < 10).alias("few_spans"))


def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to label, by size of the cluster."""
    left = _members(spark, sf_dir).join(views.gold(spark, sf_dir).select("face_id"), "face_id", "left_anti").groupBy("pile_id").agg(F.count("*").alias("n"))
    band = F.when(F.col("pile_id") == -1, "noise").when(F.col("n") >= 10, "10+").when(F.col("n") >= 5, "5-9").when(F.col("n") >= 2, "2-4").otherwise("single")
    return left.groupBy(band.alias("band")).agg(F.count("*").alias("sheets"), F.sum("n").alias("faces"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).groupBy("pile_id").agg(F.count("*").alias("faces"))


def clustering_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces, share of noise, clusters, the largest, and the middle of the sizes in descending order."""
    sizes = cluster_sizes(spark, sf_dir)
    grouped = F.when(F.col("pile_id") != -1, F.col("faces"))
    listed = F.sort_array(F.collect_list(grouped), asc=False)  # one number per cluster
    one = sizes.agg(F.sum("faces").alias("faces"), F.coalesce(F.sum(F.when(F.col("pile_id") == -1, F.col("faces"))), F.lit(0)).alias("noise"), F.count(grouped).alias("clusters"), F.max(grouped).alias("largest"), listed.alias("l"))
    return one.select("faces", "clusters", "largest", F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("middle"), micro(F.col("noise") / F.col("faces")).alias("noise_share"))


def clustering_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest clusters and their share of all faces."""
    sizes = cluster_sizes(spark, sf_dir)
    total = sizes.agg(F.sum("faces").alias("total"))
    top = sizes.where("pile_id <> -1").orderBy(F.desc("faces"), "pile_id").limit(10)
    return with_scalars(top, total).select("pile_id", "faces", micro(F.col("faces") / F.col("total")).alias("share"))


def noise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered and unclustered faces compared: medians and the share of readable faces."""
    rows = _members(spark, sf_dir).join(_faces(spark, sf_dir), "face_id")
    eye, blur = F.coalesce("interocular_px", F.lit(0.0)), F.coalesce("blur", F.lit(0.0))
    kind = F.when(F.col("pile_id") == -1, "noise").otherwise("clustered")
    return rows.groupBy(kind.alias("bucket")).agg(F.count("*").alias("faces"), micro(F.percentile(eye, 0.5)).alias("eye"), micro(F.percentile(blur, 0.5)).alias("blur"), micro(F.percentile("det_score", 0.5)).alias("score"), micro(F.avg((eye >= 40).cast("int"))).alias("readable"))


def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and pose buckets, and faces per photo by kind, as (section, bucket, faces, photos)."""
    rows = views.faces(spark, sf_dir, "photo_id", "interocular_px", "yaw_deg").join(views.photos(spark, sf_dir, "kind").select(F.col("id").alias("photo_id"), "kind"), "photo_id")
    eye, turn = F.col("interocular_px"), F.abs("yaw_deg")
    size = F.when(eye < 20, "tiny").when(eye < 40, "small").when(eye < 80, "medium").when(eye >= 80, "large")
    pose = F.when(turn < 15, "frontal").when(turn < 45, "semi").when(turn < 91, "profile")
    parts = [rows.where(c.isNotNull()).groupBy(F.lit(name).alias("section"), c.alias("bucket")).agg(F.count("*").alias("faces"), F.countDistinct("photo_id").alias("photos")) for name, c in (("size", size), ("pose", pose), ("kind", F.col("kind")))]
    return parts[0].union(parts[1]).union(parts[2])


def size_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the eye distance and the shares of tiny and usable faces by kind of photo.

    The median is read from a rank within the kind and the count, so no kind is gathered as a list.
    """
    rows = views.faces(spark, sf_dir, "photo_id", "interocular_px").where("interocular_px IS NOT NULL").join(views.photos(spark, sf_dir, "kind").select(F.col("id").alias("photo_id"), "kind"), "photo_id")
    values = rows.groupBy("kind", "interocular_px").agg(F.count("*").alias("n"))  # equal sizes combine first
    upto = values.withColumn("c", F.sum("n").over(Window.partitionBy("kind").orderBy("interocular_px"))).withColumn("t", F.sum("n").over(Window.partitionBy("kind")))
    middle = F.min(F.when(F.col("c") > F.floor(F.col("t") / 2), F.col("interocular_px")))
    return upto.groupBy("kind").agg(F.sum("n").alias("faces"), middle.alias("median"), micro(F.sum(F.when(F.col("interocular_px") < 20, F.col("n")).otherwise(0)) / F.sum("n")).alias("tiny"), micro(F.sum(F.when(F.col("interocular_px") >= 40, F.col("n")).otherwise(0)) / F.sum("n")).alias("usable"))


def face_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eye distance, yaw and roll from the five points of each face."""
    rows = views.faces(spark, sf_dir, "landmarks").withColumn("p", geometry.points(F.col("landmarks"))).where("size(p) = 5")
    p = F.col("p")
    return rows.select(F.col("id").alias("face_id"), micro(geometry.eye_distance(p)).alias("eye"), micro(geometry.yaw(p)).alias("yaw"), micro(geometry.roll(p)).alias("roll"))


#: Where the five points of an aligned face of 112 pixels lie.
ALIGNED = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]


def face_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that aligns each face; tested against a least-squares solver."""
    rows = views.faces(spark, sf_dir, "landmarks").withColumn("p", geometry.points(F.col("landmarks"))).where("size(p) = 5")
    return rows.select(F.col("id").alias("face_id"), geometry.aligning(F.col("p"), ALIGNED).alias("m")).select("face_id", "m.*")


def faces_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that remain when boxes of a photo overlap; a greedy algorithm without a SQL form."""
    boxes = views.faces(spark, sf_dir, "photo_id", "det_score", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2").select("photo_id", F.col("id").alias("face_id"), "det_score", F.col("bbox_x1").alias("x1"), F.col("bbox_y1").alias("y1"), F.col("bbox_x2").alias("x2"), F.col("bbox_y2").alias("y2"))
    return geometry.suppressed(boxes, "photo_id", "face_id", "det_score")


def face_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of a photo from the largest box; compared with the index that the detector wrote."""
    rows = views.faces(spark, sf_dir, "photo_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    area = (F.col("bbox_x2") - F.col("bbox_x1")) * (F.col("bbox_y2") - F.col("bbox_y1"))
    place = F.row_number().over(Window.partitionBy("photo_id").orderBy(area.desc(), "id")) - 1
    return rows.select(F.col("id").alias("face_id"), place.alias("place"))


def name_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person ids of the labels as written that are within two edits of another."""
    written = table(spark, sf_dir, "gold_labels").where("label = 'person'").select("person_id").distinct()
    return review.near_names(written, "person_id")


def next_person_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(person_id, '(\\\\d+)\\\\s*$', 1) AS BIGINT)")
    return views.gold(spark, sf_dir).where("person_id IS NOT NULL").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


QUERIES = {f.__name__: f for f in (latest_decision, undo_state, progress, people_counts, search_people, pile_attribution, open_per_pile, pile_ranking, next_pile, person_faces, pile_members, junk_and_lone, coverage_curve, piles_needed, label_summary, readability, person_spans, validation_flags, label_queue, cluster_sizes, clustering_summary, clustering_top, noise_quality, pool_stats, size_bias, face_pose, face_transform, faces_suppressed, face_order, name_near_duplicates, next_person_number)}

_M = lambda x: f"CAST(round(({x}) * 1e6) AS BIGINT)"
_NOW = "now AS (SELECT face_id, kind, person_id FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY at_time DESC NULLS LAST, kind DESC, person_id DESC NULLS LAST) AS r FROM log) WHERE r = 1)"
_MEM = "members AS (SELECT face_id, cluster_id AS pile_id FROM cur_pool)"
_FACE = "f AS (SELECT id AS face_id, interocular_px, det_score, blur, photo_id FROM cur_faces)"
_RANKED = "pl AS (SELECT pile_id, count(*) AS faces, quantile_cont(interocular_px, 0.5) AS eye FROM members JOIN f USING (face_id) WHERE pile_id <> -1 GROUP BY pile_id HAVING count(*) >= 2), sc AS (SELECT *, CAST(round(log10(faces + 1) * least(greatest(coalesce(eye / 50, 0), 0), 1) * least(greatest(coalesce(eye / 50, 0), 0), 1) * 1e6) AS BIGINT) AS score FROM pl), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, faces DESC, pile_id) AS rank FROM sc)"
_OPEN = "op AS (SELECT m.face_id, m.pile_id FROM members m LEFT JOIN now n USING (face_id) WHERE n.kind IS NULL OR n.kind = 'unassigned')"
_STATE = sql_with("log", more=_NOW)
_POOLED = sql_with("log", "cur_pool", more=_NOW + ", " + _MEM)
_RANK = sql_with("cur_pool", "cur_faces", more=_MEM + ", " + _FACE + ", " + _RANKED)
_CURVE = "cn AS (SELECT pile_id, count(*) FILTER (WHERE interocular_px >= 30) AS readable, count(*) FILTER (WHERE interocular_px >= 50) AS clear FROM members JOIN f USING (face_id) GROUP BY pile_id), curve AS (SELECT rank, pile_id, CAST(sum(faces) OVER (ORDER BY rank) AS BIGINT) AS all_upto, CAST(sum(readable) OVER (ORDER BY rank) AS BIGINT) AS readable_upto, CAST(sum(clear) OVER (ORDER BY rank) AS BIGINT) AS clear_upto FROM ranked JOIN cn USING (pile_id))"
_BEST = "row_number() OVER (PARTITION BY {k} ORDER BY coalesce(interocular_px, 0) DESC, coalesce(det_score, 0) DESC, face_id) - 1"
_BAND = "CASE WHEN coalesce(interocular_px, 0) < 20 THEN 'tiny' WHEN interocular_px < 40 THEN 'small' WHEN interocular_px < 80 THEN 'medium' ELSE 'large' END"
_SPANS = r"ph AS (SELECT id AS photo_id, CAST(nullif(regexp_extract(taken_at, '^\s*(\d{4})[-:]', 1), '') AS INT) AS year FROM cur_photos), sp AS (SELECT person_id, min(year) AS first, max(year) AS last FROM cur_gold JOIN f USING (face_id) JOIN ph USING (photo_id) WHERE label = 'person' AND person_id IS NOT NULL AND year IS NOT NULL GROUP BY person_id)"
_PT = "p AS (SELECT id AS face_id, CAST(landmarks AS DOUBLE[][]) AS l FROM cur_faces WHERE landmarks IS NOT NULL), q AS (SELECT face_id, l[1][1] AS x1, l[1][2] AS y1, l[2][1] AS x2, l[2][2] AS y2, l[3][1] AS nx, l[3][2] AS ny FROM p WHERE len(l) = 5)"
_KINDED = "kf AS (SELECT c.*, p.kind AS pkind FROM cur_faces c JOIN cur_photos p ON p.id = c.photo_id)"
ORACLE = {
    "latest_decision": _STATE + "SELECT * FROM now",
    "undo_state": sql_with("log", more="kept AS (SELECT * FROM log WHERE date_trunc('hour', at_time) < (SELECT max(date_trunc('hour', at_time)) FROM log)), " + _NOW.replace("FROM log)", "FROM kept)")) + "SELECT * FROM now",
    "progress": _POOLED + "SELECT (SELECT count(*) FROM members) AS faces_total, count(*) FILTER (WHERE kind <> 'unassigned') AS faces_decided, count(DISTINCT CASE WHEN kind = 'person' THEN person_id END) AS people_known FROM now",
    "people_counts": sql_with("log", "cur_faces", more=_NOW + ", " + _FACE) + "SELECT p.person_id, count(n.face_id) AS faces, arg_max(n.face_id, n.place) AS sample FROM (SELECT DISTINCT person_id FROM log WHERE kind = 'person' AND person_id IS NOT NULL) p LEFT JOIN (SELECT person_id, face_id, -row_number() OVER (ORDER BY coalesce(interocular_px, 0) DESC, face_id) AS place FROM now LEFT JOIN f USING (face_id) WHERE kind = 'person') n USING (person_id) GROUP BY p.person_id",
    "search_people": _STATE + "SELECT person_id, count(*) AS faces, min(face_id) AS sample FROM now WHERE kind = 'person' AND contains(lower(person_id), '12') GROUP BY person_id ORDER BY faces DESC, person_id LIMIT 40",
    "pile_attribution": _POOLED + "SELECT pile_id, kind, person_id, count(*) AS faces FROM members JOIN now USING (face_id) WHERE pile_id <> -1 GROUP BY ALL",
    "open_per_pile": sql_with("log", "cur_pool", more=_NOW + ", " + _MEM + ", " + _OPEN) + "SELECT pile_id, count(*) AS open FROM op GROUP BY pile_id",
    "pile_ranking": _RANK + "SELECT pile_id, faces, score, rank FROM ranked",
    "next_pile": sql_with("log", "cur_pool", "cur_faces", more=", ".join((_NOW, _MEM, _FACE, _RANKED, _OPEN))) + "SELECT pile_id, faces, rank FROM ranked WHERE pile_id IN (SELECT pile_id FROM op) ORDER BY rank LIMIT 1",
    "person_faces": sql_with("log", "cur_faces", more=_NOW + ", " + _FACE) + f"SELECT * FROM (SELECT person_id, face_id, {_BEST.format(k='person_id')} AS position FROM now JOIN f USING (face_id) WHERE kind = 'person' AND person_id IS NOT NULL) WHERE position < 12",
    "pile_members": sql_with("cur_pool", "cur_faces", more=_MEM + ", " + _FACE) + f"SELECT * FROM (SELECT pile_id, face_id, {_BEST.format(k='pile_id')} AS position FROM members JOIN f USING (face_id) WHERE pile_id <> -1) WHERE position < 24",
    "junk_and_lone": sql_with("log", "cur_pool", more=_NOW + ", " + _MEM + ", " + _OPEN) + "SELECT 'junk' AS bucket, face_id FROM members WHERE face_id IN (SELECT face_id FROM now WHERE kind = 'junk') UNION ALL SELECT 'lone', face_id FROM op WHERE pile_id = -1",
    "coverage_curve": _RANK.rstrip() + ", " + _CURVE + " SELECT * FROM curve",
    "piles_needed": _RANK.rstrip() + ", " + _CURVE + ", tc AS (SELECT count(*) AS clear FROM members JOIN f USING (face_id) WHERE interocular_px >= 50), tg(target) AS (VALUES (0.5::DOUBLE), (0.7), (0.8), (0.9), (0.95)) SELECT target, min(rank) FILTER (WHERE clear_upto >= target * clear) AS piles FROM tg, tc, curve GROUP BY target",
    "label_summary": sql_with("cur_gold") + "SELECT label, count(*) AS faces, count(DISTINCT person_id) AS people FROM cur_gold GROUP BY label",
    "readability": sql_with("cur_gold", "cur_faces", more=_FACE) + f"SELECT {_BAND} AS band, " + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS {x}" for x in ("person", "not_of_interest", "non_face", "unsure")) + " FROM cur_gold JOIN f USING (face_id) GROUP BY 1",
    "person_spans": sql_with("cur_gold", "cur_faces", "cur_photos", more=_FACE + ", " + _SPANS) + "SELECT person_id, first, last, CASE WHEN last - first >= 15 THEN '15+' WHEN last - first >= 10 THEN '10-14' WHEN last - first >= 5 THEN '5-9' WHEN last - first >= 1 THEN '1-4' ELSE '0' END AS band FROM sp",
    "validation_flags": sql_with("cur_gold", "cur_faces", "cur_photos", more=_FACE + ", " + _SPANS + ", pp AS (SELECT person_id, count(*) AS n FROM cur_gold WHERE label = 'person' AND person_id IS NOT NULL GROUP BY person_id), o AS (SELECT (SELECT count(*) FROM cur_gold WHERE label = 'person') AS faces, (SELECT count(*) FROM cur_gold WHERE label = 'not_of_interest') AS strangers, (SELECT count(*) FROM pp) AS people, (SELECT count(*) FROM pp WHERE n < 2) AS singletons, (SELECT count(*) FROM sp WHERE last - first >= 5) AS spans5, (SELECT count(*) FROM sp WHERE last - first >= 10) AS spans10)") + "SELECT *, people < 25 AS few_people, faces < 1000 AS few_faces, strangers < 100 AS few_strangers, singletons > people * 0.5 AS many_singletons, spans5 < 10 AS few_spans FROM o",
    "label_queue": sql_with("cur_pool", "cur_gold", more=_MEM + ", l AS (SELECT pile_id, count(*) AS n FROM members WHERE face_id NOT IN (SELECT face_id FROM cur_gold) GROUP BY pile_id)") + "SELECT CASE WHEN pile_id = -1 THEN 'noise' WHEN n >= 10 THEN '10+' WHEN n >= 5 THEN '5-9' WHEN n >= 2 THEN '2-4' ELSE 'single' END AS band, count(*) AS sheets, CAST(sum(n) AS BIGINT) AS faces FROM l GROUP BY 1",
    "cluster_sizes": sql_with("cur_pool") + "SELECT cluster_id AS pile_id, count(*) AS faces FROM cur_pool GROUP BY 1",
    "clustering_summary": sql_with("cur_pool", more="s AS (SELECT cluster_id, count(*) AS n FROM cur_pool GROUP BY 1)") + f"SELECT CAST(sum(n) AS BIGINT) AS faces, count(*) FILTER (WHERE cluster_id <> -1) AS clusters, max(n) FILTER (WHERE cluster_id <> -1) AS largest, list_reverse_sort(list(n) FILTER (WHERE cluster_id <> -1))[count(*) FILTER (WHERE cluster_id <> -1) // 2 + 1] AS middle, {_M('coalesce(sum(n) FILTER (WHERE cluster_id = -1), 0) / sum(n)')} AS noise_share FROM s",
    "clustering_top": sql_with("cur_pool") + f"SELECT cluster_id AS pile_id, count(*) AS faces, {_M('count(*) / (SELECT count(*) FROM cur_pool)')} AS share FROM cur_pool WHERE cluster_id <> -1 GROUP BY 1 ORDER BY faces DESC, pile_id LIMIT 10",
    "noise_quality": sql_with("cur_pool", "cur_faces", more=_MEM + ", " + _FACE) + f"SELECT CASE WHEN pile_id = -1 THEN 'noise' ELSE 'clustered' END AS bucket, count(*) AS faces, {_M('quantile_cont(coalesce(interocular_px, 0), 0.5)')} AS eye, {_M('quantile_cont(coalesce(blur, 0), 0.5)')} AS blur, {_M('quantile_cont(det_score, 0.5)')} AS score, {_M('avg(CASE WHEN coalesce(interocular_px, 0) >= 40 THEN 1 ELSE 0 END)')} AS readable FROM members JOIN f USING (face_id) GROUP BY 1",
    "pool_stats": sql_with("cur_faces", "cur_photos", more=_KINDED) + "SELECT 'size' AS section, CASE WHEN interocular_px < 20 THEN 'tiny' WHEN interocular_px < 40 THEN 'small' WHEN interocular_px < 80 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS faces, count(DISTINCT photo_id) AS photos FROM kf WHERE interocular_px IS NOT NULL GROUP BY 2 UNION ALL SELECT 'pose', CASE WHEN abs(yaw_deg) < 15 THEN 'frontal' WHEN abs(yaw_deg) < 45 THEN 'semi' ELSE 'profile' END, count(*), count(DISTINCT photo_id) FROM kf WHERE abs(yaw_deg) < 91 GROUP BY 2 UNION ALL SELECT 'kind', pkind, count(*), count(DISTINCT photo_id) FROM kf GROUP BY 2",
    "size_bias": sql_with("cur_faces", "cur_photos", more=_KINDED) + f"SELECT pkind AS kind, count(*) AS faces, list_sort(list(interocular_px))[count(*) // 2 + 1] AS median, {_M('count(*) FILTER (WHERE interocular_px < 20) / count(*)')} AS tiny, {_M('count(*) FILTER (WHERE interocular_px >= 40) / count(*)')} AS usable FROM kf WHERE interocular_px IS NOT NULL GROUP BY 1",
    "face_pose": sql_with("cur_faces", more=_PT) + f"SELECT face_id, {_M('sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))')} AS eye, {_M('CASE WHEN sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) < 1e-6 THEN 0 ELSE least(greatest(((nx - (x1 + x2) / 2) * (x2 - x1) + (ny - (y1 + y2) / 2) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * 180, -90), 90) END')} AS yaw, {_M('degrees(atan2(y2 - y1, x2 - x1))')} AS roll FROM q",
    "face_order": sql_with("cur_faces") + "SELECT id AS face_id, row_number() OVER (PARTITION BY photo_id ORDER BY (bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) DESC, id) - 1 AS place FROM cur_faces",
    "name_near_duplicates": "WITH n AS (SELECT DISTINCT lower(trim(person_id, ' ')) AS n FROM gold_labels WHERE label = 'person' AND trim(person_id, ' ') <> '') SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n) AS distance FROM n a JOIN n b ON a.n < b.n AND abs(length(a.n) - length(b.n)) <= 2 WHERE levenshtein(a.n, b.n) <= 2",
    "next_person_number": sql_with("cur_gold") + r"SELECT coalesce(max(TRY_CAST(regexp_extract(person_id, '(\d+)\s*$', 1) AS BIGINT)), 0) + 1 AS next_number FROM cur_gold WHERE person_id IS NOT NULL",
}
