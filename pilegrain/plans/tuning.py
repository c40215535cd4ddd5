"""Queries that choose what to label next and where to cut, and check a library before a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pilegrain.operators import review, vectors
from pilegrain.operators.components import nested_components
from pilegrain.operators.ranking import global_rank
from pilegrain.operators.sampling import SEED, random_order
from pilegrain.operators.scalars import with_scalars
from pilegrain.plans.graphs import _SWEEP, CUTS, DIM, _rows, _vectors
from pilegrain.plans.scores import micro
from pilegrain.session import cut
from pilegrain.sources import views
from pilegrain.sources.tables import table
from pilegrain.sources.views import sql_with

MERGE_CUTS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35]


def run_id(model: Column, algorithm: Column, threshold: Column) -> Column:
    """Readable key of a clustering run: the model without its file ending, the algorithm, the threshold."""
    return F.concat_ws("-", F.regexp_replace(model, r"\.onnx$", ""), algorithm, F.regexp_replace(threshold.cast("string"), r"\.0$", ""))


def linkage_gigabytes(rows: int, neighbours: int = 50, bytes_per_link: int = 24) -> float:
    """Upper estimate of what one task holds for linkage over a graph of so many rows; compare it with the executor's memory before a run."""
    return rows * (neighbours * bytes_per_link * 2 + 200) / 1e9


def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "face_embeddings").where("model IS NOT NULL").select("model").distinct()
    return rows.select(run_id(F.col("model"), F.lit("components"), F.lit(0.51)).alias("run_id"))


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pool(spark, sf_dir).join(views.gold(spark, sf_dir).select("face_id"), "face_id", "left_anti")


def next_label_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the largest unlabelled cluster of two or more, the smaller id first among equals."""
    left = _left(spark, sf_dir)
    best = left.where("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "cluster_id").limit(1)
    return left.join(F.broadcast(best), "cluster_id").select("cluster_id", "face_id")


def even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five faces of every cluster, evenly spaced over its days."""
    ranked = global_rank(views.pool(spark, sf_dir).where("cluster_id <> -1").select("cluster_id", "day", "face_id"), [F.asc("cluster_id"), F.asc("day"), F.asc("face_id")])
    span = ranked.groupBy("cluster_id").agg(F.min("rank").alias("from"), F.count("*").alias("n"))
    rows = ranked.join(span, "cluster_id").withColumn("i", F.col("rank") - F.col("from"))
    slot = lambda i: F.floor(i * F.least(F.lit(5), F.col("n")) / F.col("n"))
    return rows.where((F.col("i") == 0) | (slot(F.col("i")) > slot(F.col("i") - 1))).select("cluster_id", "face_id")


def crop_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty blurred faces of middle size in a fixed random order."""
    rows = views.faces(spark, sf_dir, "interocular_px", "blur").where("interocular_px >= 40 AND interocular_px < 80 AND blur < 40").withColumnRenamed("id", "face_id")
    return rows.orderBy(random_order("face_id", SEED), "face_id").limit(40).select("face_id")


def era_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest unlabelled clusters of which at least half is from before 2012."""
    early = F.count_if(F.substring("day", 1, 4).between("1900", "2011"))
    piles = _left(spark, sf_dir).where("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("faces"), early.alias("early"))
    return piles.where("faces >= 2 AND early >= 2 AND early * 2 >= faces").orderBy(F.desc("faces"), "cluster_id").limit(20)


def _people(spark: SparkSession, sf_dir: str, share: int = 2) -> DataFrame:
    """(id, v): mean direction of each label over the rows that count as labelled: in the table of test vectors those with an even id."""
    rows = _rows(spark, sf_dir).where(F.col("vec_id") % share == 0).select(F.col("label").cast("long").alias("person"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.group_sums(rows, "person", "v", DIM).select(F.col("person").alias("id"), vectors.unit(F.transform("s", lambda x: x / 1e6)).alias("v"))


def topup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten unlabelled rows nearest to each person, above a floor. In the table of test vectors every row has a label; rows with an odd id stand for unlabelled ones."""
    rest = _vectors(spark, sf_dir).where("id % 2 = 1")
    return vectors.nearest(_people(spark, sf_dir), rest, 10, 0.1).select(F.col("src").alias("person"), F.col("dst").alias("id"), "place", micro(F.col("sim")).alias("sim"))


def merge_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions, right ones, precision and recall of person-row merges at each cut."""
    rows = _rows(spark, sf_dir).select(F.col("vec_id").alias("dst"), F.col("label").cast("long").alias("truth"))
    pairs = vectors.with_cosine(vectors.blocked(_people(spark, sf_dir), _vectors(spark, sf_dir), None, min(MERGE_CUTS)), _people(spark, sf_dir), _vectors(spark, sf_dir)).join(rows, "dst")
    each = pairs.select((F.col("src") == F.col("truth")).alias("right"), F.explode(F.filter(F.array(*[F.lit(c) for c in MERGE_CUTS]), lambda c: F.col("sim") >= c)).alias("cut"))
    counts = each.groupBy("cut").agg(F.count("*").alias("suggested"), F.count_if("right").alias("hits"))
    return with_scalars(counts, rows.agg(F.count("*").alias("n"))).select("cut", "suggested", "hits", micro(F.col("hits") / F.col("suggested")).alias("precision"), micro(F.col("hits") / F.col("n")).alias("recall"))


def random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of a fixed random partner for every row, by its place among the ids: the level that chance reaches."""
    v = _vectors(spark, sf_dir)
    placed = cut(global_rank(v.select("id"), [F.asc("id")]))
    partner = F.pmod(F.col("rank") * 7919 + 104_729, F.col("m")) + 1
    asked = with_scalars(placed, placed.agg(F.max("rank").alias("m"))).select(F.col("id").alias("src"), partner.alias("rank"))
    pairs = asked.join(placed.select(F.col("id").alias("dst"), "rank"), "rank").select("src", "dst").where("src <> dst")
    sims = vectors.with_cosine(pairs, v, v).select(micro(F.col("sim")).alias("sim"))
    return sims.agg(F.count("*").alias("pairs"), F.sum("sim").alias("sum"), F.percentile("sim", 0.95).cast("long").alias("p95"))


def biggest_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest pile at each cut and how many labels stand in it."""
    graph = cut(vectors.edges(_vectors(spark, sf_dir), min(CUTS)))
    known = _rows(spark, sf_dir).select(F.col("vec_id").alias("vertex"), "label")
    rows = None
    for t, groups in nested_components(graph, CUTS):
        groups = groups.join(known, "vertex")
        one = groups.groupBy("component").agg(F.count("*").alias("faces"), F.countDistinct("label").alias("people")).orderBy(F.desc("faces"), "component").limit(1).select(F.lit(t).alias("least"), "component", "faces", "people")
        rows = one if rows is None else rows.union(one)
    return rows


def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, good, figure) over the vectors and labels of a library."""
    rows = table(spark, sf_dir, "face_embeddings").where("model IS NOT NULL")
    usable = vectors.usable(F.col("embedding"), 256)
    by = rows.agg(F.countDistinct("model").alias("models"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("dead"), F.count("*").alias("rows"))
    gold = views.gold(spark, sf_dir)
    named = gold.agg(F.countDistinct(F.when(F.col("label") == "person", F.col("person_id"))).alias("people"), F.count_if((F.col("label") == "person") & F.col("person_id").isNull()).alias("unnamed"))
    orphans = gold.join(views.faces(spark, sf_dir, "photo_id").select(F.col("id").alias("face_id")), "face_id", "left_anti").agg(F.count("*").alias("orphans"))
    from pilegrain.operators.scalars import side_by_side

    one = side_by_side(by, named, orphans)
    checks = [("one model", F.col("models") == 1, "models"), ("few dead vectors", F.col("dead") * 20 <= F.col("rows"), "dead"), ("enough people", F.col("people") >= 25, "people"), ("all people named", F.col("unnamed") == 0, "unnamed"), ("labels have faces", F.col("orphans") == 0, "orphans")]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("good"), F.col(c).alias("figure")) for n, ok, c in checks])).alias("r")).select("r.*")


def refused_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that hold an open face and a person, without the pairs that a reviewer has refused."""
    now = review.state(views.decisions(spark, sf_dir))
    members = views.pool(spark, sf_dir).select("face_id", F.col("cluster_id").alias("pile_id")).where("pile_id <> -1")
    opened = review.open_faces(members, now).select("pile_id").distinct()
    refused = members.join(now.where("kind = 'junk'").select("face_id"), "face_id").select("pile_id").distinct()
    held = members.join(now.where("kind = 'person' AND person_id IS NOT NULL"), "face_id").groupBy("person_id", "pile_id").agg(F.count("*").alias("faces"))
    return held.join(opened, "pile_id", "left_semi").join(refused, "pile_id", "left_anti")


QUERIES = {f.__name__: f for f in (run_ids, next_label_group, even_picks, crop_sample, era_piles, topup_candidates, merge_tuning, random_pairs, biggest_pile, preflight_checks, refused_merges)}

_LEFT = sql_with("cur_pool", "cur_gold", more="lf AS (SELECT * FROM cur_pool WHERE face_id NOT IN (SELECT face_id FROM cur_gold))")
_MI = lambda x: f"CAST(round(({x}) * 1e6) AS BIGINT)"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CAST(label AS BIGINT) AS truth FROM embeddings)"
_PEOPLE = "p0 AS (SELECT truth, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v WHERE id % 2 = 0), p1 AS (SELECT truth AS id, i, sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) / 1e6 AS s FROM p0 GROUP BY ALL), p2 AS (SELECT id, list(s ORDER BY i) AS s FROM p1 GROUP BY id), people AS (SELECT id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS v FROM p2)"
_NOW = "now AS (SELECT face_id, kind, person_id FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY at_time DESC NULLS LAST, kind DESC, person_id DESC NULLS LAST) AS r FROM log) WHERE r = 1), members AS (SELECT face_id, cluster_id AS pile_id FROM cur_pool WHERE cluster_id <> -1)"
_GOOD = "(len(embedding) = 256 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
ORACLE = {
    "run_ids": "SELECT DISTINCT replace(model, '.onnx', '') || '-components-0.51' AS run_id FROM face_embeddings WHERE model IS NOT NULL",
    "next_label_group": _LEFT + "SELECT cluster_id, face_id FROM lf WHERE cluster_id = (SELECT cluster_id FROM lf WHERE cluster_id <> -1 GROUP BY cluster_id HAVING count(*) > 1 ORDER BY count(*) DESC, cluster_id LIMIT 1)",
    "even_picks": sql_with("cur_pool", more="o AS (SELECT cluster_id, face_id, row_number() OVER (PARTITION BY cluster_id ORDER BY day, face_id) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM cur_pool WHERE cluster_id <> -1)") + "SELECT cluster_id, face_id FROM o WHERE i = 0 OR floor(i * least(5, n) / n) > floor((i - 1) * least(5, n) / n)",
    "crop_sample": sql_with("cur_faces") + f"SELECT id AS face_id FROM cur_faces WHERE interocular_px >= 40 AND interocular_px < 80 AND blur < 40 ORDER BY md5('{SEED}:' || id), id LIMIT 40",
    "era_piles": _LEFT + "SELECT cluster_id, count(*) AS faces, count(*) FILTER (WHERE substr(day, 1, 4) BETWEEN '1900' AND '2011') AS early FROM lf WHERE cluster_id <> -1 GROUP BY cluster_id HAVING faces >= 2 AND early >= 2 AND early * 2 >= faces ORDER BY faces DESC, cluster_id LIMIT 20",
    "topup_candidates": f"WITH {_V}, {_PEOPLE} SELECT person, id, place, {_MI('sim')} AS sim FROM (SELECT p.id AS person, v.id, list_dot_product(p.v, v.v) AS sim, row_number() OVER (PARTITION BY p.id ORDER BY list_dot_product(p.v, v.v) DESC, v.id) AS place FROM people p, v WHERE v.id % 2 = 1 AND list_dot_product(p.v, v.v) >= 0.1) WHERE place <= 10",
    "merge_tuning": f"WITH {_V}, {_PEOPLE}, t(cut) AS (VALUES {', '.join(f'({c}::DOUBLE)' for c in MERGE_CUTS)}) SELECT cut, count(*) AS suggested, count(*) FILTER (WHERE p.id = truth) AS hits, {_MI('count(*) FILTER (WHERE p.id = truth) / count(*)')} AS precision, {_MI('count(*) FILTER (WHERE p.id = truth) / (SELECT count(*) FROM v)')} AS recall FROM people p, v, t WHERE list_dot_product(p.v, v.v) >= cut GROUP BY cut",
    "random_pairs": f"WITH {_V}, r AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM v), m AS (SELECT count(*) AS m FROM v), s AS (SELECT {_MI('list_dot_product(a.v, b.v)')} AS sim FROM r a, m JOIN r b ON b.k = (a.k * 7919 + 104729) % m + 1 WHERE a.id <> b.id) SELECT count(*) AS pairs, CAST(sum(sim) AS BIGINT) AS sum, CAST(trunc(quantile_cont(sim, 0.95)) AS BIGINT) AS p95 FROM s",
    "biggest_pile": _SWEEP + "SELECT least, component, faces, people FROM (SELECT least, c AS component, count(*) AS faces, count(DISTINCT label) AS people, row_number() OVER (PARTITION BY least ORDER BY count(*) DESC, c) AS r FROM comp JOIN embeddings ON vec_id = comp.v GROUP BY least, c) WHERE r = 1",
    "preflight_checks": sql_with("cur_gold", more=f"e AS (SELECT count(DISTINCT model) AS models, count(*) FILTER (WHERE NOT coalesce({_GOOD}, false)) AS dead, count(*) AS n FROM face_embeddings WHERE model IS NOT NULL), g AS (SELECT count(DISTINCT CASE WHEN label = 'person' THEN person_id END) AS people, count(*) FILTER (WHERE label = 'person' AND person_id IS NULL) AS unnamed, count(*) FILTER (WHERE face_id NOT IN (SELECT id FROM faces WHERE id IS NOT NULL)) AS orphans FROM cur_gold)") + "SELECT 'one model' AS check, models = 1 AS good, models AS figure FROM e UNION ALL SELECT 'few dead vectors', dead * 20 <= n, dead FROM e UNION ALL SELECT 'enough people', people >= 25, people FROM g UNION ALL SELECT 'all people named', unnamed = 0, unnamed FROM g UNION ALL SELECT 'labels have faces', orphans = 0, orphans FROM g",
    "refused_merges": sql_with("log", "cur_pool", more=_NOW) + "SELECT person_id, pile_id, count(*) AS faces FROM members JOIN now USING (face_id) WHERE kind = 'person' AND person_id IS NOT NULL AND pile_id IN (SELECT pile_id FROM members LEFT JOIN now USING (face_id) WHERE kind IS NULL OR kind = 'unassigned') AND pile_id NOT IN (SELECT pile_id FROM members JOIN now USING (face_id) WHERE kind = 'junk') GROUP BY ALL",
}
