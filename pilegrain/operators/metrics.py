"""How well a grouping agrees with known identities, from the contingency table alone.

truth is (face_id, person), predicted (face_id, cluster); only faces in both count. A face in
cluster -1 is a group of its own. No pair of faces is ever formed: every figure is a sum over cells, rows and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.operators.scalars import side_by_side, with_scalars


def own_groups(predicted: DataFrame) -> DataFrame:
    """Predicted groups as text keys; noise gives every face its own."""
    key = F.when(F.col("cluster") == -1, F.concat(F.lit("lone "), F.col("face_id").cast("string"))).otherwise(F.col("cluster").cast("string"))
    return predicted.select("face_id", key.alias("cluster"))


def cells(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(person, cluster, n, n_person, n_cluster)."""
    both = truth.join(own_groups(predicted), "face_id").groupBy("person", "cluster").agg(F.count("*").alias("n"))
    person = both.groupBy("person").agg(F.sum("n").alias("n_person"))
    cluster = both.groupBy("cluster").agg(F.sum("n").alias("n_cluster"))
    return both.join(person, "person").join(cluster, "cluster")


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def pairwise(table: DataFrame) -> DataFrame:
    """One row: pairs together in both, in the prediction, in truth; precision, recall, F1."""
    hit = table.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_scored"))
    grouped = table.select("cluster", "n_cluster").distinct().agg(F.coalesce(F.sum(_pairs(F.col("n_cluster"))), F.lit(0)).alias("predicted_pairs"))
    true = table.select("person", "n_person").distinct().agg(F.coalesce(F.sum(_pairs(F.col("n_person"))), F.lit(0)).alias("true_pairs"))
    one = side_by_side(hit, grouped, true)
    scored = one.withColumn("precision", _share(F.col("hits"), F.col("predicted_pairs"))).withColumn("recall", _share(F.col("hits"), F.col("true_pairs")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def per_face(table: DataFrame) -> DataFrame:
    """BCubed precision and recall of the faces of each cell."""
    return table.select("person", "cluster", "n", (F.col("n") / F.col("n_cluster")).alias("precision"), (F.col("n") / F.col("n_person")).alias("recall"))


def bcubed(table: DataFrame) -> DataFrame:
    """One row: means of the faces' precision and recall, and F1 of the means."""
    total = F.sum("n")
    means = per_face(table).agg(total.alias("n_scored"), (F.sum(F.col("n") * F.col("precision")) / total).alias("precision"), (F.sum(F.col("n") * F.col("recall")) / total).alias("recall"))
    return means.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def information(table: DataFrame) -> DataFrame:
    """One row: normalised mutual information (arithmetic mean) and adjusted Rand index; one single group on both sides gives 1."""
    one = pairwise(table)
    total = table.agg(F.sum("n").alias("_N"))
    entropy = lambda key, n, name: with_scalars(table.select(key, n).distinct(), total).agg(F.sum(-F.col(n) / F.col("_N") * F.log(F.col(n) / F.col("_N"))).alias(name))
    mutual = with_scalars(table, total).agg(F.sum(F.col("n") / F.col("_N") * F.log(F.col("n") * F.col("_N") / (F.col("n_person") * F.col("n_cluster")))).alias("mutual"))
    joined = side_by_side(one, mutual, entropy("person", "n_person", "h_person"), entropy("cluster", "n_cluster", "h_cluster"))
    mean = (F.col("h_person") + F.col("h_cluster")) / 2
    everything = _pairs(F.col("n_scored"))
    expected = F.col("predicted_pairs") * F.col("true_pairs") / everything
    most = (F.col("predicted_pairs") + F.col("true_pairs")) / 2
    return joined.select("n_scored", F.when(mean > 0, F.col("mutual") / mean).otherwise(1.0).alias("nmi"), F.when(everything == 0, 1.0).when(most == expected, 1.0).otherwise((F.col("hits") - expected) / (most - expected)).alias("ari"))


def counts(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: faces scored, people, groups of scored faces, share of noise."""
    both = truth.join(predicted, "face_id")
    noise = F.col("cluster") == -1
    return both.agg(F.count("*").alias("n_scored"), F.countDistinct("person").alias("n_people"), F.countDistinct(F.when(~noise, F.col("cluster"))).alias("n_clusters"), F.avg(noise.cast("int")).alias("noise_share"))


def contamination(truth: DataFrame, predicted: DataFrame, junk: DataFrame) -> DataFrame:
    """One row: junk faces that stand in a cluster with an identity, of all junk faces that were grouped over."""
    named = truth.join(predicted.where("cluster <> -1"), "face_id").select("cluster").distinct()
    rows = junk.join(predicted, "face_id")
    inside = rows.join(named, "cluster", "left_semi").agg(F.count("*").alias("inside"))
    return side_by_side(inside, rows.agg(F.count("*").alias("n_junk"))).withColumn("share", _share(F.col("inside"), F.col("n_junk")))


def by_slice(truth: DataFrame, predicted: DataFrame, slices: DataFrame, least: int = 10) -> DataFrame:
    """BCubed of the faces of each slice of at least so many faces; groups are counted over all sliced faces."""
    rows = truth.join(own_groups(predicted), "face_id").join(slices, "face_id")
    small = rows.groupBy("person", "cluster", "slice").agg(F.count("*").alias("m"))
    both = small.groupBy("person", "cluster").agg(F.sum("m").alias("n"))
    person = both.groupBy("person").agg(F.sum("n").alias("n_person"))
    cluster = both.groupBy("cluster").agg(F.sum("n").alias("n_cluster"))
    full = small.join(both, ["person", "cluster"]).join(person, "person").join(cluster, "cluster")
    scored = full.groupBy("slice").agg(F.sum("m").alias("faces"), (F.sum(F.col("m") * F.col("n") / F.col("n_cluster")) / F.sum("m")).alias("precision"), (F.sum(F.col("m") * F.col("n") / F.col("n_person")) / F.sum("m")).alias("recall"))
    return scored.where(F.col("faces") >= least).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def per_person(table: DataFrame) -> DataFrame:
    """(person, faces, piles, precision, recall, largest share, failure): mixed below 0.9 precision, split below 0.9 recall."""
    rows = per_face(table).groupBy("person").agg(F.sum("n").alias("faces"), F.count("*").alias("piles"), F.max("n").alias("largest"), (F.sum(F.col("n") * F.col("precision")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("recall")) / F.sum("n")).alias("recall"))
    mixed, split = F.col("precision") < 0.9, F.col("recall") < 0.9
    return rows.withColumn("failure", F.when(mixed & split, "both").when(mixed, "mixed").when(split, "split").otherwise("none"))


def error_bar(table: DataFrame, people: int, draws: int = 200, seed: int = 5) -> DataFrame:
    """One row: percentiles 5, 50, 95 and the least F1 over random sets of so many people; each draw counts only its own people.

    A person is in a draw when its hash ranks among the first; draws are independent groups. Only hashes low enough to
    be among them, six standard deviations allowed for, are ranked.
    """
    names = table.select("person").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    share = min(1.0, (people + 6 * people**0.5 + 10) / max(1, table.select("person").distinct().count()))
    names = names.where(F.shiftrightunsigned(F.xxhash64("person", "draw", F.lit(seed)), 11) / F.lit(float(1 << 53)) < share)
    order = Window.partitionBy("draw").orderBy(F.shiftrightunsigned(F.xxhash64("person", "draw", F.lit(seed)), 11), "person")
    chosen = names.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= people).drop("_r")
    rows = table.select("person", "cluster", "n", "n_person").join(chosen, "person")
    cluster = rows.groupBy("draw", "cluster").agg(F.sum("n").alias("n_cluster"))
    scored = rows.join(cluster, ["draw", "cluster"]).groupBy("draw").agg((F.sum(F.col("n") * F.col("n") / F.col("n_cluster")) / F.sum("n")).alias("p"), (F.sum(F.col("n") * F.col("n") / F.col("n_person")) / F.sum("n")).alias("r"))
    marks = F.percentile(f1(F.col("p"), F.col("r")), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return scored.agg(F.count("*").alias("draws"), marks.alias("marks"), F.min(f1(F.col("p"), F.col("r"))).alias("least")).select("draws", F.col("marks")[0].alias("p05"), F.col("marks")[1].alias("p50"), F.col("marks")[2].alias("p95"), "least")


def split_identities(people: DataFrame, every: int = 5) -> DataFrame:
    """people (person, faces, span) with side: every fifth by span, faces and name is held out."""
    from pilegrain.operators.ranking import global_rank

    ranked = global_rank(people, [F.desc("span"), F.desc("faces"), F.asc("person")], "place")
    return ranked.withColumn("side", F.when((F.col("place") - 1) % every == every - 1, "holdout").otherwise("tune"))
