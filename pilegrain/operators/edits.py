"""Writes of a review and of a labelling session: every write is rows to append, every state an aggregation of them.

Refusals are (face_id, person_id, at, batch) rows, skips (pile_id, at, batch), names (person_id, name, at), labels (face_id,
label, person_id, at). Nothing is changed in place; the latest row of a key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.operators import review

#: Labels that a face may be given.
LABELS = ["person", "not_of_interest", "non_face", "unsure"]


def folded(name: Column) -> Column:
    return F.lower(F.trim(name))


# ---------------------------------------------------------------- merges refused, faces taken out


def refused(pairs: DataFrame, members: DataFrame, at: Column, batch: str) -> DataFrame:
    """Rows that refuse (person_id, pile_id) pairs: one for every face of the pile, so a refusal outlives the pile's number."""
    return members.join(pairs.select("person_id", "pile_id").distinct(), "pile_id").select("face_id", "person_id", at.alias("at"), F.lit(batch).alias("batch"))


def refused_pairs(refusals: DataFrame, members: DataFrame) -> DataFrame:
    """(person_id, pile_id): pairs with a refused face, whatever piles the faces lie in now."""
    return refusals.join(members, "face_id").where("pile_id <> -1").select("person_id", "pile_id").distinct()


def removed(faces: DataFrame, now: DataFrame, person: str, at: Column, batch: str) -> tuple[DataFrame, DataFrame]:
    """(log rows, refusals): faces taken from a person who holds them, and never to be suggested for that person again."""
    held = review.owned(faces, now, person)
    return review.act(held, "unassigned", at, batch), held.select("face_id", F.lit(person).alias("person_id"), at.alias("at"), F.lit(batch).alias("batch"))


def split_off(faces: DataFrame, now: DataFrame, person: str, to: str, at: Column, batch: str) -> DataFrame:
    """Log rows that give faces of one person to another; faces that the person does not hold stay."""
    return review.act(review.owned(faces, now, person), "person", at, batch, to)


def set_aside(faces: DataFrame, at: Column, batch: str) -> DataFrame:
    return review.act(faces, "junk", at, batch)


def restored(faces: DataFrame, now: DataFrame, at: Column, batch: str) -> DataFrame:
    """Log rows that open faces again which are set aside at the moment."""
    return review.act(faces.join(now.where("kind = 'junk'").select("face_id"), "face_id", "left_semi"), "unassigned", at, batch)


def undone(log: DataFrame, refusals: DataFrame, skips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """log, refusals and skips without the newest batch of any of them; a batch leaves the log and the refusals together."""
    newest = review.newest_batch(log, skips, refusals)
    of = lambda *what: newest.where(F.col("what").isin(*what)).select("batch")
    return log.join(of("decision", "refusal"), "batch", "left_anti"), refusals.join(of("decision", "refusal"), "batch", "left_anti"), skips.join(of("skip"), "batch", "left_anti")


# ---------------------------------------------------------------- skips


def skipped(skips: DataFrame, log: DataFrame, members: DataFrame) -> DataFrame:
    """(pile_id, at): piles whose latest skip is newer than every decision on their faces."""
    last = skips.groupBy("pile_id").agg(F.max("at").alias("at"))
    decided = members.join(log.where("kind <> 'unassigned'"), "face_id").groupBy("pile_id").agg(F.max("at").alias("_d"))
    return last.join(decided, "pile_id", "left").where("_d IS NULL OR _d < at").select("pile_id", "at")


# ---------------------------------------------------------------- people and their names


def resolved(written: DataFrame, known: DataFrame) -> DataFrame:
    """(name, person_id, created): each written name's person, found in any case among known (person_id, name), else a new one whose id is the folded name; blanks give none."""
    names = written.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    ids = known.where(F.trim("name") != "").groupBy(folded(F.col("name")).alias("k")).agg(F.min("person_id").alias("person_id"))
    return names.withColumn("k", folded(F.col("name"))).join(ids, "k", "left").select("name", F.coalesce("person_id", "k").alias("person_id"), F.col("person_id").isNull().alias("created"))


def renamed(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(person_id, name, outcome) of asked renames (person_id, name): renamed, blank, unknown person, or clash with a name that another person has or asks for."""
    people = known.groupBy("person_id").agg(F.max("name").alias("_old"))
    taken = known.select(folded(F.col("name")).alias("k"), "person_id").union(asked.select(folded(F.col("name")).alias("k"), "person_id"))
    holders = taken.distinct().groupBy("k").agg(F.count("*").alias("_holders"))
    rows = asked.select("person_id", F.trim("name").alias("name")).withColumn("k", folded(F.col("name"))).join(people, "person_id", "left").join(holders, "k", "left")
    outcome = F.when(F.coalesce("name", F.lit("")) == "", "blank").when(F.col("_old").isNull(), "unknown").when(F.col("_holders") > 1, "clash").otherwise("renamed")
    return rows.select("person_id", F.when(outcome == "renamed", F.col("name")).otherwise(F.col("_old")).alias("name"), outcome.alias("outcome"))


# ---------------------------------------------------------------- labels


def checked(entries: DataFrame) -> DataFrame:
    """entries with a column fault: null where the label may be saved, else what is wrong with it."""
    label = folded(F.col("label"))
    blank = F.coalesce(F.trim("person_id"), F.lit("")) == ""
    fault = F.when(F.col("face_id").isNull(), "no face").when(label.isNull() | ~label.isin(LABELS), "unknown label").when((label == "person") & blank, "person without id").when((label != "person") & ~blank, "id without person")
    return entries.withColumn("fault", fault)


def saved(held: DataFrame, entries: DataFrame) -> DataFrame:
    """(face_id, label, person_id, at): held labels after the sound entries; the latest of a face wins, equal times by the larger label."""
    cols = ["face_id", "label", "person_id", "at"]
    good = checked(entries).where("fault IS NULL").select("face_id", folded(F.col("label")).alias("label"), F.nullif(F.trim("person_id"), F.lit("")).alias("person_id"), "at")
    rows = held.select(*cols).union(good)
    return rows.groupBy("face_id").agg(F.max(F.struct("at", "label", "person_id")).alias("d")).select("face_id", "d.label", "d.person_id", "d.at")


def unlabelled(held: DataFrame, faces: DataFrame) -> DataFrame:
    """Labels without those of the faces given: what undoing them leaves."""
    return held.join(faces.select("face_id").distinct(), "face_id", "left_anti")


def cleared(held: DataFrame, label: str | None = None, person: str | None = None, last: int | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """The labels to clear: by label, by person in any case, by cluster (face_id rows), of these the last so many; with nothing given, all."""
    rows = held
    if label is not None:
        rows = rows.where(F.col("label") == label)
    if person is not None:
        rows = rows.where(folded(F.col("person_id")) == person.strip().lower())
    if clusters is not None:
        rows = rows.join(clusters.select("face_id").distinct(), "face_id", "left_semi")
    return rows if last is None else rows.orderBy(F.desc("at"), "face_id").limit(last)


def merged_people(held: DataFrame, into: DataFrame) -> DataFrame:
    """Labels with person ids replaced as into (old, new) says, in any case; chains are not followed, so a merge may run again."""
    new = into.groupBy(folded(F.col("old")).alias("_k")).agg(F.min("new").alias("_new"))
    rows = held.withColumn("_k", folded(F.col("person_id"))).join(new, "_k", "left")
    return rows.withColumn("person_id", F.coalesce("_new", "person_id")).select(*held.columns)


# ---------------------------------------------------------------- runs, settings, crops


def runs(rows: DataFrame, run: str, at: str) -> DataFrame:
    """(run, rows, first, last, latest): every run, the newest marked; equal times by the larger name."""
    each = rows.where(F.col(run).isNotNull()).groupBy(F.col(run).alias("run")).agg(F.count("*").alias("n_rows"), F.min(at).alias("first"), F.max(at).alias("last"))
    return each.withColumn("latest", F.row_number().over(Window.orderBy(F.desc_nulls_last("last"), F.desc("run"))) == 1)  # one row per run


def settings(log: DataFrame) -> DataFrame:
    """(key, value): the latest value of each key of a log (key, value, at)."""
    return log.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("at", "value"))["value"].alias("value"))


def keyed_by_model(rows: DataFrame, model: str) -> DataFrame:
    """Vectors of a table keyed by face alone, keyed by (face_id, model): rows that name no model get the one given, nothing is lost."""
    named = rows if "model" in rows.columns else rows.withColumn("model", F.lit(None).cast("string"))
    return named.withColumn("model", F.coalesce("model", F.lit(model)))


def crop_path(crop: Column, context: Column, prefer_context: bool = False) -> Column:
    """The file to show for a face: its crop, or the wider one where there is none (the other way round on request); blank is none."""
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in (crop, context))
    return F.coalesce(b, a) if prefer_context else F.coalesce(a, b)
