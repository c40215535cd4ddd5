"""A review as an append-only log: the current state is the latest decision of each face.

log has face_id, kind (person, junk, unassigned), person_id, at and batch. Nothing is ever changed:
an action appends rows, undoing a batch appends a tombstone and the state leaves tombstoned batches
out. State comes from one aggregation that combines map-side and is used by every reader.
members is (face_id, pile_id); pile_id -1 is a face in no pile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.operators.ranking import global_rank, group_median, running_sum
from pilegrain.operators.scalars import side_by_side, with_scalars


def standing(log: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """log without undone batches."""
    return log if tombstones is None else log.join(tombstones.select("batch").distinct(), "batch", "left_anti")


def state(log: DataFrame) -> DataFrame:
    """(face_id, kind, person_id, at): the latest decision of each face, equal times by the larger kind and person."""
    last = F.max(F.struct("at", "kind", "person_id")).alias("d")
    return log.groupBy("face_id").agg(last).select("face_id", "d.kind", "d.person_id", "d.at")


def is_open(kind: Column) -> Column:
    return kind.isNull() | (kind == "unassigned")


def open_faces(members: DataFrame, now: DataFrame) -> DataFrame:
    return members.join(now.select("face_id", "kind"), "face_id", "left").where(is_open(F.col("kind"))).select("face_id", "pile_id")


def act(faces: DataFrame, kind: str, at: Column, batch: str, person: str | None = None) -> DataFrame:
    """Rows to append for faces: assign (kind person), set aside (junk), or take back (unassigned)."""
    return faces.select("face_id", F.lit(kind).alias("kind"), F.lit(person).cast("string").alias("person_id"), at.alias("at"), F.lit(batch).alias("batch"))


def owned(faces: DataFrame, now: DataFrame, person: str) -> DataFrame:
    """Those of faces that the person holds at the moment; repairs act on no others."""
    return faces.join(now.where((F.col("kind") == "person") & (F.col("person_id") == person)).select("face_id"), "face_id", "left_semi")


def newest_batch(log: DataFrame, skips: DataFrame | None = None, refusals: DataFrame | None = None, protected: str = "seed") -> DataFrame:
    """One row (what, batch, at): the newest of decision, skip and refusal; equal times in this order."""
    rows = log.where(F.col("batch") != protected).select(F.lit("decision").alias("what"), F.lit(3).alias("_t"), F.col("batch").cast("string").alias("batch"), "at")
    for other, what, t in ((skips, "skip", 2), (refusals, "refusal", 1)):
        if other is not None:
            rows = rows.union(other.select(F.lit(what), F.lit(t), F.col("batch").cast("string"), "at"))
    return rows.agg(F.max(F.struct("at", "_t", "batch", "what")).alias("m")).where("m IS NOT NULL").select("m.what", "m.batch", "m.at")


def seeded(log: DataFrame, gold: DataFrame, at: Column) -> DataFrame:
    """Rows that take labelled people over; faces with any decision are left alone, so it may run again."""
    fresh = gold.join(log.select("face_id").distinct(), "face_id", "left_anti")
    return fresh.select("face_id", F.lit("person").alias("kind"), "person_id", at.alias("at"), F.lit("seed").alias("batch"))


def people_counts(now: DataFrame, people: DataFrame | None = None, faces: DataFrame | None = None) -> DataFrame:
    """(person_id, faces, sample) of everyone who holds a face, with people also of those who hold none; the sample is the clearest face where faces is given, else the smallest id."""
    held = now.where("kind = 'person' AND person_id IS NOT NULL").select("person_id", "face_id")
    best = F.min("face_id")
    if faces is not None:
        held = held.join(faces.select("face_id", "interocular_px"), "face_id", "left")
        best = (-F.max(F.struct(F.coalesce("interocular_px", F.lit(0.0)).alias("eye"), (-F.col("face_id")).alias("i")))["i"])
    counts = held.groupBy("person_id").agg(F.count("*").alias("faces"), best.alias("sample"))
    if people is None:
        return counts
    return people.select("person_id").distinct().join(counts, "person_id", "left").withColumn("faces", F.coalesce("faces", F.lit(0)))


def page(rows: DataFrame, rank: str, number: int, size: int) -> DataFrame:
    """Rows of a page, counted from 1, of a table with places from 1."""
    return rows.where(F.col(rank).between((number - 1) * size + 1, number * size))


def progress(members: DataFrame, now: DataFrame) -> DataFrame:
    total = members.agg(F.count("*").alias("faces_total"))
    done = now.agg(F.count_if(F.col("kind") != "unassigned").alias("faces_decided"), F.countDistinct(F.when(F.col("kind") == "person", F.col("person_id"))).alias("people_known"))
    return side_by_side(total, done)


def attribution(members: DataFrame, now: DataFrame) -> DataFrame:
    """Who the decided faces of each pile belong to."""
    rows = members.where("pile_id <> -1").join(now, "face_id")
    return rows.groupBy("pile_id", "kind", "person_id").agg(F.count("*").alias("faces"))


def pile_score(n: Column, eye: Column, coherence: Column) -> Column:
    """Reach (log of the size) times readability squared times coherence, the last two within 0 and 1."""
    within = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.log10(F.greatest(n, F.lit(0)) + 1) * within(eye / 50) * within(eye / 50) * within(coherence)


def ranked_piles(members: DataFrame, faces: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """(pile_id, faces, eye, score, rank) of piles of two or more; eye is the median eye distance."""
    rows = members.where("pile_id <> -1").join(faces.select("face_id", "interocular_px"), "face_id")
    piles = group_median(rows, "pile_id", "interocular_px", "eye").withColumnRenamed("rows", "faces").where("faces >= 2")
    if coherence is not None:
        piles = piles.join(coherence, "pile_id", "left")
    c = F.coalesce("coherence", F.lit(1.0)) if coherence is not None else F.lit(1.0)
    scored = piles.withColumn("score", F.round(pile_score(F.col("faces"), F.col("eye"), c) * 1e6).cast("long"))
    return global_rank(scored.select("pile_id", "faces", "eye", "score"), [F.desc("score"), F.desc("faces"), F.asc("pile_id")])


def next_pile(piles: DataFrame, open_: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """The best-ranked pile with an open face that was not skipped, with its place among all piles."""
    left = piles.join(open_.select("pile_id").distinct(), "pile_id", "left_semi")
    if skipped is not None:
        left = left.join(skipped.select("pile_id"), "pile_id", "left_anti")
    return left.orderBy("rank").limit(1)


def best_faces(members: DataFrame, faces: DataFrame, by: str, most: int) -> DataFrame:
    """The clearest faces of each group with their position from 0; missing sizes count as 0."""
    order = Window.partitionBy(by).orderBy(F.coalesce("interocular_px", F.lit(0.0)).desc(), F.coalesce("det_score", F.lit(0.0)).desc(), "face_id")
    rows = members.join(faces.select("face_id", "interocular_px", "det_score"), "face_id")
    return rows.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < most).select(by, "face_id", "position")


def bucket_of(members: DataFrame, now: DataFrame, kind: str) -> DataFrame:
    """Faces in nobody's album: junk that was set aside, or lone faces that are open."""
    if kind == "junk":
        return members.join(now.where("kind = 'junk'").select("face_id"), "face_id", "left_semi")
    return open_faces(members.where("pile_id = -1"), now)


def coverage(piles: DataFrame, members: DataFrame, faces: DataFrame) -> DataFrame:
    """piles in review order with running counts of all, readable (30 px) and clear (50 px) faces."""
    eye = F.coalesce("interocular_px", F.lit(0.0))
    counts = members.join(faces.select("face_id", "interocular_px"), "face_id").groupBy("pile_id").agg(F.count_if(eye >= 30).alias("readable"), F.count_if(eye >= 50).alias("clear"))
    rows = piles.select("pile_id", "faces", "rank").join(counts, "pile_id")
    return running_sum(rows, "rank", {"all_upto": "faces", "readable_upto": "readable", "clear_upto": "clear"}).select("rank", "pile_id", "all_upto", "readable_upto", "clear_upto")


def piles_needed(curve: DataFrame, members: DataFrame, faces: DataFrame, targets: list[float]) -> DataFrame:
    """(target, piles): how many piles in order reach each share of all clear faces; null where none does."""
    clear = members.join(faces.select("face_id", "interocular_px"), "face_id").agg(F.count_if(F.coalesce("interocular_px", F.lit(0.0)) >= 50).alias("clear"))
    reached = with_scalars(curve, clear).agg(*[F.min(F.when(F.col("clear_upto") >= t * F.col("clear"), F.col("rank"))).alias(f"t{i}") for i, t in enumerate(targets)])
    return reached.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{i}").alias("piles")) for i, t in enumerate(targets)])).alias("r")).select("r.*")


def near_names(names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """(a, b, distance): pairs of names within an edit distance.

    Two names that near share a text left after at most so many deletions from each, so pairs meet on
    equal remainders only; names with a common beginning alone never meet.
    """
    rows = names.select(F.lower(F.trim(F.col(name))).alias("n")).where("n <> ''").distinct()
    left = F.array("n")
    for _ in range(most):
        shorter = F.transform(left, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
        left = F.array_distinct(F.concat(left, F.flatten(shorter)))
    keyed = rows.select("n", F.explode(left).alias("k"))
    a, b = keyed.select(F.col("n").alias("a"), "k"), keyed.select(F.col("n").alias("b"), "k")
    met = a.join(b, "k").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most).select("a", "b", "distance")
