"""Queries over vectors: similarity graph, groupings, sweeps, piles, merge suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pilegrain.operators import cluster, vectors
from pilegrain.operators.components import nested_components
from pilegrain.operators.scalars import side_by_side
from pilegrain.plans.scores import micro
from pilegrain.session import cut
from pilegrain.sources.tables import table

LEAST, DIM = 0.35, 64
CUTS = [0.45, 0.42, 0.40, 0.38, 0.36, 0.35]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, label) of the test vectors: usable ones with an id, repeated rows once."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding"), DIM))
    return rows.groupBy("vec_id").agg(F.max(F.struct("embedding", "label")).alias("r")).select("vec_id", "r.embedding", "r.label")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return cluster.by_components(v, vectors.edges(v, LEAST))


def edges_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.edges(_vectors(spark, sf_dir), LEAST).select("src", "dst", micro(F.col("sim")).alias("sim"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every row whose id is divisible by ten, against all rows."""
    v = _vectors(spark, sf_dir)
    return vectors.nearest(v.where("id % 10 = 0"), v, 5, same=True).select("src", "dst", "place", micro(F.col("sim")).alias("sim"))


def piles_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piles(spark, sf_dir)


def pile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piles(spark, sf_dir).groupBy("label").agg(F.count("*").alias("size"))


def sweep_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles, lone rows and the largest pile at each cut of one graph, and how much the largest grew."""
    v = _vectors(spark, sf_dir)
    graph = cut(vectors.edges(v, min(CUTS)))
    n = v.count()
    rows = None
    for t, groups in nested_components(graph, CUTS):
        sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
        one = sizes.agg(F.lit(t).alias("least"), F.count("*").alias("piles"), F.count_if(F.col("size") >= 5).alias("piles5"), F.coalesce(F.sum("size"), F.lit(0)).alias("grouped"), F.coalesce(F.max("size"), F.lit(1)).alias("largest"))
        rows = one if rows is None else rows.union(one)
    grown = F.lag("largest").over(Window.orderBy(F.desc("least")))
    return rows.withColumn("lone", F.lit(n) - F.col("grouped")).withColumn("growth", micro(F.col("largest") / grown))


def weld_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step with the largest growth of at least two from a pile of five or more, and the next stricter cut as the safe one."""
    rows = sweep_thresholds(spark, sf_dir)
    along = Window.orderBy(F.desc("least"))
    steps = rows.withColumn("before", F.lag("largest").over(along)).withColumn("safe", F.lag("least").over(along)).where("before >= 5 AND growth >= 2000000")
    return steps.orderBy(F.desc("growth"), "least").limit(1).select("least", "safe", "growth", "largest")


def strictest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the largest pile at the strictest cut, its share of all rows, and whether that already is over a fiftieth, so that no cut of the sweep is safe."""
    rows = sweep_thresholds(spark, sf_dir).orderBy(F.desc("least")).limit(1)
    whole = F.col("grouped") + F.col("lone")
    return rows.select("least", "largest", micro(F.col("largest") / whole).alias("share"), (F.col("largest") * 50 > whole).alias("welded_already"))


def tightness_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles by the mean cosine of their pairs."""
    v = _vectors(spark, sf_dir)
    rows = v.join(_piles(spark, sf_dir), "id").where("label <> -1")
    tight = vectors.group_sums(rows, "label", "v", DIM).withColumn("mean", vectors.tightness(None))
    band = F.when(F.col("mean") >= 0.45, "tight").when(F.col("mean") >= 0.35, "fair").when(F.col("mean") >= 0.2, "loose").otherwise("scattered")
    return tight.groupBy(band.alias("band")).agg(F.count("*").alias("piles"), F.sum("n").alias("faces"))


def pile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piles with size, coherence (length of the mean vector) and score, and their place."""
    v = _vectors(spark, sf_dir)
    rows = v.join(_piles(spark, sf_dir), "id").where("label <> -1")
    sums = vectors.group_sums(rows, "label", "v", DIM)
    length = F.sqrt(F.aggregate(F.transform("s", lambda x: (x / 1e6) * (x / 1e6)), F.lit(0.0), lambda a, x: a + x)) / F.col("n")
    scored = sums.select(F.col("label").alias("pile_id"), F.col("n").alias("faces"), micro(length).alias("coherence"))
    score = micro(F.log10(F.col("faces") + 1) * F.least(F.col("coherence") / 1e6, F.lit(1.0)))
    return scored.withColumn("score", score)


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known labels whose mean vector comes near a pile's, strongest first within the label."""
    v = _vectors(spark, sf_dir)
    people = vectors.group_sums(_rows(spark, sf_dir).select(F.col("label").cast("long").alias("person"), F.col("embedding").cast("array<double>").alias("v")), "person", "v", DIM)
    rows = v.join(_piles(spark, sf_dir), "id").where("label <> -1")
    centres = vectors.group_sums(rows, "label", "v", DIM)
    as_unit = lambda df, key: df.select(F.col(key).alias("id"), vectors.unit(F.transform("s", lambda x: x / 1e6)).alias("v"))
    return vectors.nearest(as_unit(people, "person"), as_unit(centres, "label"), 3, 0.1).select(F.col("src").alias("person"), F.col("dst").alias("pile_id"), "place", micro(F.col("sim")).alias("sim"))


def cross_group_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row of the lower half of ids its best cosine in the upper half."""
    v = _vectors(spark, sf_dir)
    half = v.agg(F.expr("max(id) div 2").alias("h")).first()["h"] or 0
    return vectors.nearest(v.where(F.col("id") <= half), v.where(F.col("id") > half), 1).select("src", "dst", micro(F.col("sim")).alias("sim"))


POOLS, MARKS = [1, 2, 4, 8], [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]


def cross_group_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of the lower half of ids have a neighbour at each cosine in an eighth, a quarter, half and all of the upper half: what chance alone supplies with the size of the pool."""
    v = _vectors(spark, sf_dir)
    half = v.agg(F.expr("max(id) div 2").alias("h")).first()["h"] or 0
    low, high = cut(v.where(F.col("id") <= half)), cut(v.where(F.col("id") > half))
    rows = None
    for k in POOLS:
        best = vectors.nearest(low, high.where(F.col("id") % 8 < k), 1)
        one = best.select(F.lit(k).alias("eighths"), F.explode(F.array(*[F.struct(F.lit(t).alias("least"), (F.col("sim") >= t).alias("met")) for t in MARKS])).alias("m")).groupBy("eighths", "m.least").agg(F.count_if("m.met").alias("rows_met"), F.count("*").alias("rows"))
        rows = one if rows is None else rows.union(one)
    return rows


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and soundness of each model's vectors."""
    rows = table(spark, sf_dir, "face_embeddings").where("model IS NOT NULL")
    good = vectors.usable(F.col("embedding"), 256)
    length = F.when(good, F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))))
    return rows.groupBy("model").agg(F.count("*").alias("rows"), F.countDistinct("face_id").alias("faces"), F.countDistinct("embed_version").alias("versions"), F.countDistinct("platform").alias("platforms"), F.count_if(good).alias("usable"), F.count_if(F.abs(length - 1) > 0.05).alias("not_unit"), F.count_if(F.col("embedding").isNull()).alias("missing"))


def model_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces embedded more than once by one model: whether the vectors of different days agree."""
    rows = table(spark, sf_dir, "face_embeddings").where(vectors.usable(F.col("embedding"), 256)).select("face_id", "model", "created_at", vectors.unit(F.col("embedding")).alias("v"))
    ends = rows.groupBy("face_id", "model").agg(F.min(F.struct("created_at", "v")).alias("a"), F.max(F.struct("created_at", "v")).alias("b")).where("a.created_at < b.created_at")
    return ends.select("face_id", "model", micro(vectors.dot(F.col("a.v"), F.col("b.v"))).alias("sim"))


def chinese_whispers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.group(_vectors(spark, sf_dir), "whispers", LEAST, 50)


def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.group(_vectors(spark, sf_dir), "linkage", LEAST, 50)


def grouping_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may not be in a grouping, counted for each strategy: rows lost or told twice, groups of one, labels that are not the smallest id of their group, groups across components of the graph (density numbers its groups and knows no graph)."""
    v = cut(_vectors(spark, sf_dir))
    graph = cut(vectors.neighbour_graph(v, 50, LEAST))
    whole = cut(cluster.by_components(v, graph)).select("id", F.col("label").alias("component"))
    out = None
    for name in ("components", "whispers", "linkage", "density"):
        rows = cut(cluster.STRATEGIES[name](v, graph).select("id", "label").join(whole, "id"))
        groups = rows.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.countDistinct("component").alias("k"))
        bad = groups.agg(F.count_if(F.col("n") < 2).alias("of_one"), F.count_if((F.col("least") != F.col("label")) & F.lit(name != "density")).alias("wrong_label"), F.count_if((F.col("k") > 1) & F.lit(name != "density")).alias("across"))
        one = side_by_side(bad, rows.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def density_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.group(_vectors(spark, sf_dir), "density").select("id", "label", F.round("probability", 4).alias("probability"))


QUERIES = {f.__name__: f for f in (edges_similarity, knn_topk, piles_components, pile_sizes, sweep_thresholds, weld_point, strictest_cut, tightness_bands, pile_index, merge_pairs, cross_group_best, cross_group_supply, vector_checks, model_parity, chinese_whispers, average_linkage, density_groups, grouping_properties)}

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_E = f"WITH RECURSIVE {_V}, e AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {LEAST})"
_REACH = ", l AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), reach(v, u) AS (SELECT a, a FROM l UNION SELECT l.b, r.u FROM reach r JOIN l ON l.a = r.v WHERE r.u < l.b), comp AS (SELECT v AS id, min(u) AS label FROM reach GROUP BY v)"
_PILES = _E + _REACH + ", piles AS (SELECT v.id, v.v, coalesce(label, -1) AS label FROM v LEFT JOIN comp USING (id))"
_MI = lambda x: f"CAST(round(({x}) * 1e6) AS BIGINT)"
_SUMS = ", q AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM piles WHERE label <> -1), d AS (SELECT label, i, count(*) AS n, sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) AS s FROM q GROUP BY ALL), sums AS (SELECT label, min(n) AS n, sum((s / 1e6) * (s / 1e6)) AS sq FROM d GROUP BY label)"
_SWEEP = "WITH RECURSIVE " + _V + f", e AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {min(CUTS)}), t(least) AS (VALUES {', '.join(f'({c}::DOUBLE)' for c in CUTS)}), l AS (SELECT least, src AS a, dst AS b FROM e, t WHERE sim >= least UNION ALL SELECT least, dst, src FROM e, t WHERE sim >= least), reach(least, v, u) AS (SELECT least, a, a FROM l UNION SELECT l.least, l.b, r.u FROM reach r JOIN l ON l.a = r.v AND l.least = r.least WHERE r.u < l.b), comp AS (SELECT least, v, min(u) AS c FROM reach GROUP BY least, v), sz AS (SELECT least, c, count(*) AS size FROM comp GROUP BY ALL), o AS (SELECT t.least, count(c) AS piles, count(*) FILTER (WHERE size >= 5) AS piles5, CAST(coalesce(sum(size), 0) AS BIGINT) AS grouped, coalesce(max(size), 1) AS largest FROM t LEFT JOIN sz ON sz.least = t.least GROUP BY t.least), sweep AS (SELECT *, (SELECT count(*) FROM v) - grouped AS lone, CAST(round(largest / lag(largest) OVER (ORDER BY least DESC) * 1e6) AS BIGINT) AS growth FROM o) "
_CENTRES = ", c1 AS (SELECT label AS id, list(s / 1e6 ORDER BY i) AS s FROM d GROUP BY label), c2 AS (SELECT id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS v FROM c1), p0 AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p1 AS (SELECT CAST(label AS BIGINT) AS id, i, sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) / 1e6 AS s FROM p0 GROUP BY ALL), p2 AS (SELECT id, list(s ORDER BY i) AS s FROM p1 GROUP BY id), p3 AS (SELECT id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS v FROM p2)"
_GOOD = "(len(embedding) = 256 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
ORACLE = {
    "edges_similarity": _E + f" SELECT src, dst, {_MI('sim')} AS sim FROM e",
    "knn_topk": f"WITH {_V} SELECT src, dst, place, {_MI('sim')} AS sim FROM (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS place FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 10 = 0) WHERE place <= 5",
    "piles_components": _PILES + " SELECT id, label FROM piles",
    "pile_sizes": _PILES + " SELECT label, count(*) AS size FROM piles GROUP BY label",
    "sweep_thresholds": _SWEEP + "SELECT * FROM sweep",
    "weld_point": _SWEEP + "SELECT least, safe, growth, largest FROM (SELECT *, lag(largest) OVER (ORDER BY least DESC) AS before, lag(least) OVER (ORDER BY least DESC) AS safe FROM sweep) WHERE before >= 5 AND growth >= 2000000 ORDER BY growth DESC, least LIMIT 1",
    "strictest_cut": _SWEEP + f"SELECT least, largest, {_MI('largest / (grouped + lone)')} AS share, largest * 50 > grouped + lone AS welded_already FROM sweep ORDER BY least DESC LIMIT 1",
    "tightness_bands": _PILES + _SUMS + " SELECT CASE WHEN m >= 0.45 THEN 'tight' WHEN m >= 0.35 THEN 'fair' WHEN m >= 0.2 THEN 'loose' ELSE 'scattered' END AS band, count(*) AS piles, CAST(sum(n) AS BIGINT) AS faces FROM (SELECT n, (sq - n) / (n * (n - 1)) AS m FROM sums) GROUP BY 1",
    "pile_index": _PILES + _SUMS + f" SELECT pile_id, faces, coherence, {_MI('log10(faces + 1) * least(coherence / 1e6, 1.0)')} AS score FROM (SELECT label AS pile_id, n AS faces, {_MI('sqrt(sq) / n')} AS coherence FROM sums)",
    "merge_pairs": _PILES + _SUMS + _CENTRES + f" SELECT person, pile_id, place, {_MI('sim')} AS sim FROM (SELECT p3.id AS person, c2.id AS pile_id, list_dot_product(p3.v, c2.v) AS sim, row_number() OVER (PARTITION BY p3.id ORDER BY list_dot_product(p3.v, c2.v) DESC, c2.id) AS place FROM p3, c2) WHERE place <= 3 AND sim >= 0.1",
    "cross_group_best": f"WITH {_V}, h AS (SELECT max(id) // 2 AS h FROM v) SELECT src, dst, {_MI('sim')} AS sim FROM (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS place FROM v a, v b, h WHERE a.id <= h AND b.id > h) WHERE place = 1",
    "cross_group_supply": f"WITH {_V}, h AS (SELECT max(id) // 2 AS h FROM v), k(eighths) AS (VALUES {', '.join(f'({k})' for k in POOLS)}), t(least) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in MARKS)}), b AS (SELECT k.eighths, a.id, max(list_dot_product(a.v, c.v)) AS sim FROM v a, v c, h, k WHERE a.id <= h AND c.id > h AND c.id % 8 < k.eighths GROUP BY ALL) SELECT eighths, least, count(*) FILTER (WHERE sim >= least) AS rows_met, count(*) AS rows FROM b, t GROUP BY ALL",
    "grouping_properties": "SELECT strategy, CAST(0 AS BIGINT) AS of_one, CAST(0 AS BIGINT) AS wrong_label, CAST(0 AS BIGINT) AS across, n AS rows, n AS ids FROM (VALUES ('components'), ('whispers'), ('linkage'), ('density')) s(strategy), (SELECT count(*) AS n FROM embeddings)",
    "vector_checks": f"SELECT model, count(*) AS rows, count(DISTINCT face_id) AS faces, count(DISTINCT embed_version) AS versions, count(DISTINCT platform) AS platforms, count(*) FILTER (WHERE g) AS usable, count(*) FILTER (WHERE g AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.05) AS not_unit, count(*) FILTER (WHERE embedding IS NULL) AS missing FROM (SELECT *, coalesce({_GOOD}, false) AS g FROM face_embeddings WHERE model IS NOT NULL) GROUP BY model",
}
