"""Queries that run a grouping of the real vectors and judge it, and that tune the merging of its piles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.operators import cluster, edits, metrics, review, sampling, vectors
from pilegrain.operators.ranking import global_rank
from pilegrain.operators.scalars import side_by_side
from pilegrain.plans import actions, scores
from pilegrain.plans.scores import micro
from pilegrain.session import cut, release
from pilegrain.sources import views
from pilegrain.sources.views import sql_with

DIM = 256
DIALS = [0.60, 0.51, 0.45]
FLOOR = 0.30
CUTS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.51, 0.55, 0.60]
PURE = 0.8


def _grouped(spark: SparkSession, sf_dir: str, cuts: list[float]) -> tuple[DataFrame, DataFrame]:
    """(id) of all vectors, and edges with the components of all pairs at each cut."""
    faces = cut(vectors.packed(views.face_embeddings(spark, sf_dir)))
    release(spark)  # the vectors as stored
    ids, blocks = cut(faces.select("id")), vectors.blocks_of(faces)
    del faces
    release(spark)  # the vectors that are not in blocks
    graph = cut(vectors.spanning(blocks, cuts))
    del blocks
    release(spark)
    return ids, graph


def _run(graph: DataFrame, faces: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """One row of scores of the components at a cut: all faces are grouped, only labelled ones are scored."""
    groups = cut(cluster.by_components(faces, graph.where(F.col("sim") >= least)).select(F.col("id").alias("face_id"), F.col("label").alias("cluster")))
    cells = cut(metrics.cells(truth, groups))
    b3 = metrics.bcubed(cells).select(F.col("n_scored"), micro(F.col("precision")).alias("b3_precision"), micro(F.col("recall")).alias("b3_recall"), micro(F.col("f1")).alias("b3_f1"))
    pairs = metrics.pairwise(cells).select(micro(F.col("f1")).alias("pairwise_f1"))
    sizes = groups.where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(1)).alias("largest"))
    lone = groups.agg(F.count_if(F.col("cluster") == -1).alias("lone"), F.count("*").alias("faces"))
    return side_by_side(b3, pairs, sizes, lone).select(F.lit(least).alias("least"), "faces", "clusters", "lone", "largest", "n_scored", "b3_precision", "b3_recall", "b3_f1", "pairwise_f1")


def experiment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all vectors by components at every dial, score each grouping against the labels: rows for the table of results."""
    faces, graph = _grouped(spark, sf_dir, DIALS)
    truth = cut(scores._truth(spark, sf_dir))
    rows = [_run(graph, faces, truth, t) for t in DIALS]
    return rows[0].union(rows[1]).union(rows[2])


def largest_pile_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the largest pile of each cut is: welded (two labelled people or more), person (one), junk (none, and eyes below 0.6 of the median of all), else unknown; core is the share of the strictest cut's largest pile within it."""
    vectors_, graph = _grouped(spark, sf_dir, DIALS)
    truth = scores._truth(spark, sf_dir)
    eyes = cut(views.faces(spark, sf_dir, "interocular_px").select(F.col("id").alias("face_id"), "interocular_px"))
    middle = eyes.join(vectors_.select(F.col("id").alias("face_id")), "face_id").agg(F.percentile("interocular_px", 0.5).alias("pool_eye"))
    rows = core = None
    for t in DIALS:
        groups = cluster.by_components(vectors_, graph.where(F.col("sim") >= t)).where("label <> -1")
        top = groups.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select("label")
        held = cut(groups.join(F.broadcast(top), "label").select(F.col("id").alias("face_id")))
        core = held if core is None else core
        figures = side_by_side(held.agg(F.count("*").alias("faces")), held.join(truth, "face_id").agg(F.countDistinct("person").alias("people")), held.join(eyes, "face_id").agg(F.percentile("interocular_px", 0.5).alias("eye")), held.join(core, "face_id", "left_semi").agg(F.count("*").alias("_both")), core.agg(F.count("*").alias("_core")), middle)
        verdict = F.when(F.col("people") >= 2, "welded").when(F.col("people") == 1, "person").when(F.col("eye") < 0.6 * F.col("pool_eye"), "junk").otherwise("unknown")
        one = figures.where("faces > 0").select(F.lit(t).alias("least"), "faces", "people", verdict.alias("verdict"), micro(F.col("_both") / F.col("_core")).alias("core"))
        rows = one if rows is None else rows.union(one)
    return rows


def experiment_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BCubed of the grouping at 0.51 by slice of the labels."""
    groups = cut(cluster.by_components(*_grouped(spark, sf_dir, [0.51])).select(F.col("id").alias("face_id"), F.col("label").alias("cluster")))
    slices = views.gold(spark, sf_dir).where("occlusion IS NOT NULL").select("face_id", F.col("occlusion").alias("slice"))
    return scores._quantised(metrics.by_slice(scores._truth(spark, sf_dir), groups, slices), "precision", "recall", "f1")


# ---------------------------------------------------------------- merging piles


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pool(spark, sf_dir).where("cluster_id <> -1").select("face_id", F.col("cluster_id").alias("pile_id"))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pile_id, n, s) of the pool's clusters over their faces with a vector."""
    rows = views.face_vectors(spark, sf_dir).join(_members(spark, sf_dir), F.col("id") == F.col("face_id")).select("pile_id", "v")
    return vectors.group_sums(rows, "pile_id", "v", DIM)


def _owners(members: DataFrame, now: DataFrame) -> DataFrame:
    """(pile_id, person_id, share): who holds most decided faces of a pile, equal counts by the smaller id, and their share of these."""
    each = members.join(now.where("kind = 'person' AND person_id IS NOT NULL"), "face_id").groupBy("pile_id", "person_id").agg(F.count("*").alias("n"))
    return each.groupBy("pile_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "person_id")).alias("o"), F.sum("n").alias("all")).select("pile_id", "o.person_id", (-F.col("o.m") / F.col("all")).alias("share"))


def _unit(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), vectors.unit(F.transform("s", lambda x: x / 1e6)).alias("v"))


def merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles that may belong to a known person: every pair of a person's vector and a pile at or above FLOOR, the pile with an open face, not the person's and not refused; the nearest first.

    A person's vector is the sum over the person's piles of centroid times size.
    """
    members, now = cut(_members(spark, sf_dir)), cut(actions._now(spark, sf_dir))
    sums, owners = cut(_sums(spark, sf_dir)), cut(_owners(members, now))
    held = sums.join(owners, "pile_id").select("person_id", F.posexplode("s").alias("i", "x")).groupBy("person_id", "i").agg(F.sum("x").alias("x"))
    people = held.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("s"))
    people = cut(people.withColumn("number", F.xxhash64("person_id")))
    left, right = _unit(people, "number"), _unit(sums, "pile_id")
    pairs = vectors.with_cosine(vectors.blocked(left, right, None, FLOOR), left, right).where(F.col("sim") >= FLOOR)
    named = pairs.join(people.select(F.col("number").alias("src"), "person_id"), "src").select("person_id", F.col("dst").alias("pile_id"), micro(F.col("sim")).alias("sim"))
    opened = review.open_faces(members, now).groupBy("pile_id").agg(F.count("*").alias("open"))
    refused = edits.refused_pairs(actions.refusals(spark, sf_dir), members)
    rows = named.join(opened, "pile_id").join(owners.select("pile_id", "person_id"), ["pile_id", "person_id"], "left_anti").join(refused, ["person_id", "pile_id"], "left_anti")
    return global_rank(rows.select("person_id", "pile_id", "sim", "open"), [F.desc("sim"), F.asc("person_id"), F.asc("pile_id")], "place")


def merge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, merges, precision and recall of asking about every two known piles at each cut, and the cut of fewest questions per merge.

    A pile is known by a person with at least PURE of its decided faces.
    """
    members, now = cut(_members(spark, sf_dir)), cut(actions._now(spark, sf_dir))
    known = cut(_owners(members, now).where(F.col("share") >= PURE).select("pile_id", "person_id"))
    centres = cut(_unit(_sums(spark, sf_dir).join(known, "pile_id"), "pile_id"))
    pairs = vectors.edges(centres, min(CUTS)).join(known.select(F.col("pile_id").alias("src"), F.col("person_id").alias("a")), "src").join(known.select(F.col("pile_id").alias("dst"), F.col("person_id").alias("b")), "dst")
    each = pairs.select((F.col("a") == F.col("b")).alias("right"), F.explode(F.filter(F.array(*[F.lit(c) for c in CUTS]), lambda c: F.col("sim") >= c)).alias("cut"))
    counts = each.groupBy("cut").agg(F.count("*").alias("questions"), F.count_if("right").alias("merges"))
    possible = known.join(centres.select(F.col("id").alias("pile_id")), "pile_id").groupBy("person_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("possible"))
    rows = counts.withColumn("_k", F.lit(1)).join(F.broadcast(possible.withColumn("_k", F.lit(1))), "_k")
    marked = rows.select("cut", "questions", "merges", micro(F.col("merges") / F.col("questions")).alias("precision"), micro(F.when(F.col("possible") > 0, F.col("merges") / F.col("possible")).otherwise(0.0)).alias("recall"))
    best = marked.where("merges > 0").agg(F.max(F.struct("precision", "cut"))["cut"].alias("_best"), F.lit(1).alias("_k"))
    return marked.withColumn("_k", F.lit(1)).join(F.broadcast(best), "_k", "left").withColumn("cheapest", F.coalesce(F.col("cut") == F.col("_best"), F.lit(False))).drop("_k", "_best")


def closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest two faces of every two piles that have a pair at or above 0.45: pairs are told block against block and leave their task as one row a pair of piles."""
    members = _members(spark, sf_dir).select(F.col("face_id").alias("id"), F.col("pile_id").alias("g"))
    faces = cut(vectors.packed(views.face_embeddings(spark, sf_dir).join(members, "id")))
    found = vectors.closest(vectors.blocks_of(faces), 0.45)
    return found.select(F.col("x").alias("pile_a"), F.col("y").alias("pile_b"), micro(F.col("sim")).alias("sim"), "pairs")


def pile_ranking_coherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles ranked with their coherence: the length of the mean of their unit vectors; a pile without vectors counts as coherent."""
    sums = _sums(spark, sf_dir)
    length = F.sqrt(F.aggregate(F.transform("s", lambda x: (x / 1e6) * (x / 1e6)), F.lit(0.0), lambda a, x: a + x)) / F.col("n")
    faces = views.faces(spark, sf_dir, "interocular_px").withColumnRenamed("id", "face_id")
    return review.ranked_piles(_members(spark, sf_dir), faces, sums.select("pile_id", length.alias("coherence"))).select("pile_id", "faces", "score", "rank")


def pile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the eye distance in the largest pile and in the library."""
    faces = views.faces(spark, sf_dir, "interocular_px").withColumnRenamed("id", "face_id")
    members = _members(spark, sf_dir)
    largest = members.groupBy("pile_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pile_id").limit(1)
    own = faces.join(members.join(F.broadcast(largest.select("pile_id")), "pile_id"), "face_id").select(F.lit("largest pile").alias("of"), "interocular_px")
    rows = own.union(faces.select(F.lit("library"), "interocular_px")).where("interocular_px IS NOT NULL")
    marks = F.percentile("interocular_px", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("of").agg(F.count("*").alias("faces"), marks.alias("m")).select("of", "faces", *[micro(F.col("m")[i]).alias(f"q{i + 1}") for i in range(3)])


# ---------------------------------------------------------------- people left out, splits, pinned samples


def worst_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BCubed scores when the people of the lowest F1 are left out one after another, up to five."""
    people = metrics.per_person(scores._cells(spark, sf_dir)).withColumn("f1", micro(metrics.f1(F.col("precision"), F.col("recall"))))
    worst = people.orderBy("f1", "person").limit(5).select("person", F.monotonically_increasing_id().alias("_i"))
    ranked = global_rank(worst, [F.asc("_i")], "place").select("person", "place")
    marked = people.join(F.broadcast(ranked), "person", "left").withColumn("place", F.coalesce("place", F.lit(6)))
    each = marked.select("person", "faces", "precision", "recall", F.explode(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: k < F.col("place"))).alias("dropped"))
    total = F.sum("faces")
    means = each.groupBy("dropped").agg(F.count("*").alias("people"), total.alias("faces"), (F.sum(F.col("faces") * F.col("precision")) / total).alias("precision"), (F.sum(F.col("faces") * F.col("recall")) / total).alias("recall"))
    return means.select("dropped", "people", "faces", micro(F.col("precision")).alias("precision"), micro(F.col("recall")).alias("recall"))


def split_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and faces that each side of the identity split would hold."""
    return scores.identity_split(spark, sf_dir).groupBy("side").agg(F.count("*").alias("people"), F.sum("faces").alias("faces"))


def pinned_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred faces of the pool by id, labelled people first: what is pinned is never trimmed away."""
    pinned = views.gold(spark, sf_dir).where("label = 'person' AND person_id IS NOT NULL").select("face_id")
    return sampling.trimmed(views.pool(spark, sf_dir).select("face_id"), 500, pinned)


QUERIES = {f.__name__: f for f in (experiment_run, largest_pile_verdict, experiment_slices, merge_queue, merge_cut, closest_pairs, pile_ranking_coherent, pile_quality, worst_people, split_preview, pinned_trim)}

_MI = lambda x: f"CAST(round(({x}) * 1e6) AS BIGINT)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_GROUPS = f", t(least) AS (VALUES {', '.join(f'({c}::DOUBLE)' for c in DIALS)}), e AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS sim FROM fv a JOIN fv b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {min(DIALS)}), l AS (SELECT least, src AS a, dst AS b FROM e, t WHERE sim >= least UNION ALL SELECT least, dst, src FROM e, t WHERE sim >= least), reach(least, v, u) AS (SELECT least, a, a FROM l UNION SELECT l.least, l.b, r.u FROM reach r JOIN l ON l.a = r.v AND l.least = r.least WHERE r.u < l.b), comp AS (SELECT least, v, min(u) AS c FROM reach GROUP BY least, v), g AS (SELECT t.least, fv.id AS face_id, comp.c FROM fv CROSS JOIN t LEFT JOIN comp ON comp.least = t.least AND comp.v = fv.id), truth AS (SELECT face_id, person_id AS person FROM cur_gold WHERE label = 'person' AND person_id IS NOT NULL), c0 AS (SELECT least, person, coalesce(c::VARCHAR, 'lone ' || face_id) AS cluster, count(*) AS n FROM truth JOIN g USING (face_id) GROUP BY ALL), cells AS (SELECT *, sum(n) OVER (PARTITION BY least, person) AS np, sum(n) OVER (PARTITION BY least, cluster) AS nc FROM c0)"
_VECTORS = sql_with("cur_gold", "cur_pool", "cur_faces", "log", "fv").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
_OWN = ", now AS (SELECT face_id, kind, person_id FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY at_time DESC NULLS LAST, kind DESC, person_id DESC NULLS LAST) AS r FROM log) WHERE r = 1), members AS (SELECT face_id, cluster_id AS pile_id FROM cur_pool WHERE cluster_id <> -1), o0 AS (SELECT pile_id, person_id, count(*) AS n FROM members JOIN now USING (face_id) WHERE kind = 'person' AND person_id IS NOT NULL GROUP BY ALL), own AS (SELECT pile_id, person_id, n / t AS share FROM (SELECT *, sum(n) OVER (PARTITION BY pile_id) AS t, row_number() OVER (PARTITION BY pile_id ORDER BY n DESC, person_id) AS r FROM o0) WHERE r = 1), q AS (SELECT pile_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM fv JOIN members ON face_id = id), d AS (SELECT pile_id, i, count(*) AS n, sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) AS s FROM q GROUP BY ALL), c1 AS (SELECT pile_id AS id, list(s / 1e6 ORDER BY i) AS s FROM d GROUP BY pile_id), centres AS (SELECT id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS v FROM c1)"
_PEOPLE = ", p1 AS (SELECT person_id AS id, i, sum(s) / 1e6 AS s FROM d JOIN own USING (pile_id) GROUP BY ALL), p2 AS (SELECT id, list(s ORDER BY i) AS s FROM p1 GROUP BY id), people AS (SELECT id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS v FROM p2), doubt AS (SELECT pile_id, min(CASE WHEN kind = 'person' THEN person_id END) AS person_id FROM members JOIN now USING (face_id) GROUP BY pile_id HAVING bool_or(kind = 'junk')), op AS (SELECT pile_id, count(*) AS open FROM members LEFT JOIN now USING (face_id) WHERE kind IS NULL OR kind = 'unassigned' GROUP BY pile_id)"
ORACLE = {
    "experiment_run": _VECTORS + _GROUPS + f", b AS (SELECT least, sum(n) AS n_scored, sum(n * (n / nc)) / sum(n) AS p, sum(n * (n / np)) / sum(n) AS r, sum(n * (n - 1) // 2) AS hits FROM cells GROUP BY least), pp AS (SELECT least, sum(nc * (nc - 1) // 2) AS pp FROM (SELECT DISTINCT least, cluster, nc FROM cells) GROUP BY least), tp AS (SELECT least, sum(np * (np - 1) // 2) AS tp FROM (SELECT DISTINCT least, person, np FROM cells) GROUP BY least), pf AS (SELECT least, CASE WHEN pp > 0 THEN hits / pp ELSE 0 END AS p, CASE WHEN tp > 0 THEN hits / tp ELSE 0 END AS r FROM b JOIN pp USING (least) JOIN tp USING (least)), sz AS (SELECT least, count(*) AS faces, count(DISTINCT c) AS clusters, count(*) FILTER (WHERE c IS NULL) AS lone FROM g GROUP BY least), lg AS (SELECT least, max(k) AS largest FROM (SELECT least, count(*) AS k FROM g WHERE c IS NOT NULL GROUP BY least, c) GROUP BY least) "
    f"SELECT least, faces, clusters, lone, coalesce(largest, 1) AS largest, CAST(n_scored AS BIGINT) AS n_scored, {_MI('b.p')} AS b3_precision, {_MI('b.r')} AS b3_recall, {_MI('CASE WHEN b.p + b.r > 0 THEN 2 * b.p * b.r / (b.p + b.r) ELSE 0 END')} AS b3_f1, {_MI('CASE WHEN pf.p + pf.r > 0 THEN 2 * pf.p * pf.r / (pf.p + pf.r) ELSE 0 END')} AS pairwise_f1 FROM sz LEFT JOIN b USING (least) LEFT JOIN pf USING (least) LEFT JOIN lg USING (least)",
    "largest_pile_verdict": _VECTORS + _GROUPS + f", lp AS (SELECT least, c, row_number() OVER (PARTITION BY least ORDER BY count(*) DESC, c) AS r FROM g WHERE c IS NOT NULL GROUP BY least, c), hd AS (SELECT g.least, g.face_id FROM g JOIN lp ON lp.least = g.least AND lp.c = g.c WHERE r = 1), co AS (SELECT face_id FROM hd WHERE least = (SELECT max(least) FROM hd)), pe AS (SELECT quantile_cont(interocular_px, 0.5) AS m FROM cur_faces WHERE id IN (SELECT id FROM fv)) SELECT least, faces, people, CASE WHEN people >= 2 THEN 'welded' WHEN people = 1 THEN 'person' WHEN eye < 0.6 * m THEN 'junk' ELSE 'unknown' END AS verdict, {_MI('n / (SELECT count(*) FROM co)')} AS core FROM (SELECT hd.least, count(*) AS faces, count(DISTINCT truth.person) AS people, quantile_cont(interocular_px, 0.5) AS eye, count(co.face_id) AS n FROM hd LEFT JOIN truth USING (face_id) LEFT JOIN cur_faces ON cur_faces.id = hd.face_id LEFT JOIN co ON co.face_id = hd.face_id GROUP BY hd.least), pe",
    "experiment_slices": _VECTORS + _GROUPS + f", rows AS (SELECT truth.person, coalesce(g.c::VARCHAR, 'lone ' || g.face_id) AS cluster, occlusion AS slice FROM truth JOIN g USING (face_id) JOIN (SELECT face_id, occlusion FROM cur_gold WHERE occlusion IS NOT NULL) USING (face_id) WHERE g.least = 0.51), k AS (SELECT *, count(*) OVER (PARTITION BY person, cluster) AS n, count(*) OVER (PARTITION BY person) AS a, count(*) OVER (PARTITION BY cluster) AS b FROM rows) SELECT slice, faces, {_MI('p')} AS precision, {_MI('r')} AS recall, {_MI(_F1)} AS f1 FROM (SELECT slice, count(*) AS faces, avg(n / b) AS p, avg(n / a) AS r FROM k GROUP BY slice) WHERE faces >= 10",
    "merge_queue": _VECTORS + _OWN + _PEOPLE + f" SELECT person_id, pile_id, sim, open, row_number() OVER (ORDER BY sim DESC, person_id, pile_id) AS place FROM (SELECT p.id AS person_id, c.id AS pile_id, {_MI('list_dot_product(p.v, c.v)')} AS sim, open FROM people p, centres c JOIN op ON op.pile_id = c.id WHERE list_dot_product(p.v, c.v) >= {FLOOR} AND NOT EXISTS (SELECT 1 FROM own WHERE own.pile_id = c.id AND own.person_id = p.id) AND NOT EXISTS (SELECT 1 FROM doubt WHERE doubt.pile_id = c.id AND doubt.person_id = p.id))",
    "merge_cut": _VECTORS + _OWN + f", kn AS (SELECT own.pile_id, person_id, v FROM own JOIN centres ON id = pile_id WHERE share >= {PURE}), t(cut) AS (VALUES {', '.join(f'({c}::DOUBLE)' for c in CUTS)}), ps AS (SELECT a.person_id = b.person_id AS ok, list_dot_product(a.v, b.v) AS sim FROM kn a JOIN kn b ON a.pile_id < b.pile_id), po AS (SELECT coalesce(sum(k * (k - 1) // 2), 0) AS possible FROM (SELECT count(*) AS k FROM kn GROUP BY person_id)), r AS (SELECT cut, count(*) AS questions, count(*) FILTER (WHERE ok) AS merges FROM ps, t WHERE sim >= cut GROUP BY cut), m AS (SELECT cut, questions, merges, {_MI('merges / questions')} AS precision, {_MI('CASE WHEN possible > 0 THEN merges / possible ELSE 0 END')} AS recall FROM r, po) SELECT *, coalesce(cut = (SELECT cut FROM m WHERE merges > 0 ORDER BY precision DESC, cut DESC LIMIT 1), false) AS cheapest FROM m",
    "closest_pairs": _VECTORS + f", mb AS (SELECT face_id, cluster_id AS pile_id FROM cur_pool WHERE cluster_id <> -1), x AS (SELECT m.pile_id, fv.* FROM fv JOIN mb m ON m.face_id = fv.id), e AS (SELECT a.pile_id AS x, b.pile_id AS y, list_dot_product(a.v, b.v) AS sim FROM x a JOIN x b ON a.id < b.id AND a.pile_id <> b.pile_id) SELECT least(x, y) AS pile_a, greatest(x, y) AS pile_b, {_MI('max(sim)')} AS sim, count(*) AS pairs FROM e WHERE sim >= 0.45 GROUP BY ALL",
    "pile_ranking_coherent": _VECTORS + _OWN + f", co AS (SELECT pile_id, sqrt(sum((s / 1e6) * (s / 1e6))) / min(n) AS c FROM d GROUP BY pile_id), pl AS (SELECT pile_id, count(*) AS faces, quantile_cont(interocular_px, 0.5) AS eye FROM members JOIN cur_faces f ON f.id = members.face_id GROUP BY pile_id HAVING count(*) >= 2), sc AS (SELECT pile_id, faces, {_MI('log10(faces + 1) * least(greatest(coalesce(eye / 50, 0), 0), 1) * least(greatest(coalesce(eye / 50, 0), 0), 1) * least(greatest(coalesce(c, 1), 0), 1)')} AS score FROM pl LEFT JOIN co USING (pile_id)) SELECT *, row_number() OVER (ORDER BY score DESC, faces DESC, pile_id) AS rank FROM sc",
    "pile_quality": sql_with("cur_pool", "cur_faces", more="m AS (SELECT face_id, cluster_id FROM cur_pool WHERE cluster_id <> -1), b AS (SELECT cluster_id FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), r AS (SELECT 'largest pile' AS of, interocular_px AS x FROM cur_faces WHERE id IN (SELECT face_id FROM m WHERE cluster_id IN (SELECT cluster_id FROM b)) UNION ALL SELECT 'library', interocular_px FROM cur_faces)") + "SELECT of, count(*) AS faces, " + ", ".join(f"{_MI(f'quantile_cont(x, {q})')} AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM r WHERE x IS NOT NULL GROUP BY of",
    "worst_people": scores._BASE.rstrip() + f", pe AS (SELECT person, CAST(sum(n) AS BIGINT) AS faces, sum(n * (n / nc)) / sum(n) AS p, sum(n * (n / np)) / sum(n) AS r FROM cells GROUP BY person), rk AS (SELECT *, row_number() OVER (ORDER BY {_MI(_F1)}, person) AS place FROM pe), k(dropped) AS (SELECT unnest(range(0, 6))) SELECT CAST(dropped AS INT) AS dropped, count(*) AS people, CAST(sum(faces) AS BIGINT) AS faces, {_MI('sum(faces * p) / sum(faces)')} AS precision, {_MI('sum(faces * r) / sum(faces)')} AS recall FROM rk, k WHERE place > dropped GROUP BY dropped",
    "split_preview": "SELECT side, count(*) AS people, CAST(sum(faces) AS BIGINT) AS faces FROM (" + scores.ORACLE["identity_split"] + ") GROUP BY side",
    "pinned_trim": sql_with("cur_gold", "cur_pool", more="pin AS (SELECT face_id FROM cur_gold WHERE label = 'person' AND person_id IS NOT NULL), o AS (SELECT face_id, face_id IN (SELECT face_id FROM pin) AS pinned, row_number() OVER (ORDER BY face_id IN (SELECT face_id FROM pin) DESC, face_id) AS r FROM cur_pool)") + "SELECT face_id, pinned FROM o WHERE pinned OR r <= 500",
}
