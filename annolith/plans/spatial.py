"""Queries over boxes and page graphs: SPA, and JOI11-14."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.functions import boxes
from annolith.functions.boxes import Box, box
from annolith.operators import graphs, matching

from .registry import query
from .standins import FACES, PAGES, PAIRS, faces, read, with_

c = F.col
PAGE = ["image_id"]


def sides(s, d):
    f = faces(s, d).select("image_id", "ad", "id", "coder", "x1", "y1", "x2", "y2", "confidence")
    return f.where("coder = 'h'"), f.where("coder = 'p'")


def accepted(s, d, least=0.2, contained=None):
    return matching.candidates(*sides(s, d), PAGE, least, contained)


@query("spa01_area", with_(FACES, "SELECT image_id, id, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS area FROM faces"))
def spa01(s, d):
    return faces(s, d).select("image_id", "id", boxes.area(box()).alias("area"))


@query("joi11_overlap_candidates", with_(FACES, PAIRS, "SELECT image_id, a, b, round(iou, 6) AS iou, round(containment, 6) AS containment FROM pairs_ WHERE iou >= 0.1 OR (containment >= 0.95 AND iou >= 0.02)"))
def joi11(s, d):
    return accepted(s, d, 0.1, 0.95).select("image_id", "a", "b", F.round("iou", 6).alias("iou"), F.round("containment", 6).alias("containment"))


@query("joi12_near_duplicates", with_(FACES, "SELECT count(*) AS pairs, round(max(iou), 6) AS most FROM (SELECT inter / (aa + ab - inter) AS iou FROM (SELECT CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS DOUBLE) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, CAST(a.x2 - a.x1 AS DOUBLE) * (a.y2 - a.y1) AS aa, CAST(b.x2 - b.x1 AS DOUBLE) * (b.y2 - b.y1) AS ab FROM faces a JOIN faces b ON a.image_id = b.image_id AND a.id < b.id)) WHERE iou >= 0.5"))
def joi12(s, d):
    f = faces(s, d).select("image_id", "id", "x1", "y1", "x2", "y2")
    return matching.candidates(f, f, PAGE, 0.5).where("a < b").agg(F.count("*").alias("pairs"), F.round(F.max("iou"), 6).alias("most"))


@query("joi13_matched_ads_only", with_(FACES, "m AS (SELECT image_id, ad FROM faces GROUP BY ALL HAVING count(*) FILTER (coder = 'h') > 0 AND count(*) FILTER (coder = 'p') > 0)", "SELECT h.image_id, h.ad, h.id AS a, p.id AS b FROM faces h JOIN faces p ON h.image_id = p.image_id AND h.ad = p.ad JOIN m ON m.image_id = h.image_id AND m.ad = h.ad WHERE h.coder = 'h' AND p.coder = 'p'"))
def joi13(s, d):
    h, p = sides(s, d)
    both = h.select("image_id", "ad").distinct().join(p.select("image_id", "ad").distinct(), ["image_id", "ad"])
    return both.join(h.select("image_id", "ad", c("id").alias("a")), ["image_id", "ad"]).join(p.select("image_id", "ad", c("id").alias("b")), ["image_id", "ad"])


@query("joi14_center_inside", with_(FACES, "SELECT h.image_id, h.id AS a, p.id AS b FROM faces h JOIN faces p USING (image_id) WHERE h.coder = 'h' AND p.coder = 'p' AND (p.x1 + p.x2) / 2.0 BETWEEN h.x1 AND h.x2 AND (p.y1 + p.y2) / 2.0 BETWEEN h.y1 AND h.y2"))
def joi14(s, d):
    h, p = sides(s, d)
    outer, inner = F.struct("x1", "y1", "x2", "y2").alias("o"), F.struct("x1", "y1", "x2", "y2").alias("i")
    both = h.select("image_id", c("id").alias("a"), outer).join(p.select("image_id", c("id").alias("b"), inner), "image_id")
    return both.where(boxes.center_inside(box(row=c("i")), box(row=c("o")))).select("image_id", "a", "b")


@query("joi15_spread_assignment", with_(FACES, "SELECT image_id, id, CASE WHEN x1 + x2 < 140 THEN image_id * 2 ELSE image_id * 2 + 1 END AS page, CASE WHEN x1 + x2 < 140 THEN least(1.0, x1 / 140.0::DOUBLE * 2) ELSE greatest(0.0, x1 / 140.0::DOUBLE * 2 - 1) END AS px1 FROM faces"))
def joi15(s, d):
    left, x = c("x1") + c("x2") < 140, c("x1") / F.lit(140.0) * 2
    return faces(s, d).select("image_id", "id", F.when(left, c("image_id") * 2).otherwise(c("image_id") * 2 + 1).alias("page"), F.when(left, F.least(F.lit(1.0), x)).otherwise(F.greatest(F.lit(0.0), x - 1)).alias("px1"))


GREEDY = """, r AS (SELECT image_id, list([{'s': -score, 'a': CAST(a AS BIGINT), 'b': CAST(b AS BIGINT), 'iou': iou}] ORDER BY -score, {A}a, {A}b) AS rows FROM (SELECT *, {SCORE} AS score FROM pairs_ WHERE {WHERE}) GROUP BY 1),
k AS (SELECT image_id, unnest(list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: q.a = x[1].a OR q.b = x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m FROM r)
SELECT image_id, m.a AS a, m.b AS b, round(m.iou, 6) AS iou FROM k"""


def greedy_sql(score, where, sign=""):
    return "WITH " + FACES + ",\n" + PAIRS + GREEDY.replace("{SCORE}", score).replace("{WHERE}", where).replace("{A}", sign)


def shown(pairs):
    return pairs.select("image_id", "a", "b", F.round("iou", 6).alias("iou"))


@query("spa07_greedy_strict", greedy_sql("iou", "iou >= 0.2"))
def spa07(s, d):
    return shown(matching.greedy(accepted(s, d), PAGE, c("iou")))


@query("spa07_greedy_lenient", greedy_sql("greatest(iou, containment * 0.19::DOUBLE)", "iou >= 0.1 OR (containment >= 0.95 AND iou >= 0.02)"))
def spa07b(s, d):
    return shown(matching.greedy(accepted(s, d, 0.1, 0.95), PAGE, F.greatest(c("iou"), c("containment") * 0.19)))


@query("spa08_greedy_reversed_ties", greedy_sql("iou", "true", "-"))
def spa08(s, d):
    return shown(matching.greedy(accepted(s, d, 0.0), PAGE, c("iou"), reverse_ties=True))


def best_ctes(name: str, least: float) -> str:
    """CTEs for WITH RECURSIVE: <name>_best (image_id, k, total) of a matching with as many pairs as can be at this IoU and, among
    those, the largest sum of IoU. Boxes of one side are taken in turn, each with a free partner or none."""
    n = name
    return f"""{n}_e AS (SELECT DISTINCT image_id, a, b, iou FROM pairs_ WHERE iou >= {least}),
{n}_a AS (SELECT image_id, a, row_number() OVER (PARTITION BY image_id ORDER BY a) AS i, count(*) OVER (PARTITION BY image_id) AS n FROM (SELECT DISTINCT image_id, a FROM {n}_e)),
{n}_b AS (SELECT image_id, b, 1::BIGINT << (row_number() OVER (PARTITION BY image_id ORDER BY b) - 1) AS bit FROM (SELECT DISTINCT image_id, b FROM {n}_e)),
{n}_y AS (SELECT e.image_id, i, bit, iou FROM {n}_e e JOIN {n}_a x ON x.image_id = e.image_id AND x.a = e.a JOIN {n}_b z ON z.image_id = e.image_id AND z.b = e.b UNION ALL SELECT image_id, i, NULL, NULL FROM {n}_a),
{n}_w AS (SELECT image_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS k, 0.0::DOUBLE AS total FROM (SELECT DISTINCT image_id FROM {n}_a)
  UNION ALL SELECT w.image_id, y.i, w.used | coalesce(y.bit, 0), w.k + (y.bit IS NOT NULL)::BIGINT, w.total + coalesce(y.iou, 0) FROM {n}_w w JOIN {n}_y y ON y.image_id = w.image_id AND y.i = w.i + 1 AND (y.bit IS NULL OR w.used & y.bit = 0)),
{n}_best AS (SELECT image_id, m.k AS k, m.total AS total FROM (SELECT image_id, max({{'k': k, 'total': total}}) AS m FROM {n}_w GROUP BY 1) WHERE m.k > 0)"""


def recursive(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query("spa09_optimal_matching")
def spa09(s, d):
    return shown(matching.optimal(accepted(s, d), PAGE))


@query("spa11_most_pairs", recursive(FACES, PAIRS, best_ctes("o", 0.2), "SELECT image_id, k AS pairs FROM o_best"))
def spa11(s, d):
    return matching.most_pairs(accepted(s, d), PAGE).groupBy("image_id").agg(F.count("*").alias("pairs"))


@query("spa12_match_status", greedy_sql("iou", "iou >= 0.2").replace("SELECT image_id, m.a AS a, m.b AS b, round(m.iou, 6) AS iou FROM k", "SELECT f.image_id, f.id, m.b AS partner, CASE WHEN m.b IS NULL THEN 'missed' ELSE 'found' END AS status FROM faces f LEFT JOIN k ON k.image_id = f.image_id AND m.a = f.id WHERE coder = 'h'"))
def spa12(s, d):
    h, _ = sides(s, d)
    pairs = matching.greedy(accepted(s, d), PAGE, c("iou"))
    return matching.tagged(h, pairs, PAGE, "a", "found", "missed").select("image_id", "id", "partner", "status")


@query("spa13_suppression", "WITH " + FACES + """, r AS (SELECT image_id, list([{'c': -confidence, 'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] ORDER BY -confidence, id) AS rows FROM faces GROUP BY 1),
k AS (SELECT image_id, list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: greatest(0, least(q.x2, x[1].x2) - greatest(q.x1, x[1].x1)) * greatest(0, least(q.y2, x[1].y2) - greatest(q.y1, x[1].y1)) / ((q.x2 - q.x1) * (q.y2 - q.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - greatest(0, least(q.x2, x[1].x2) - greatest(q.x1, x[1].x1)) * greatest(0, least(q.y2, x[1].y2) - greatest(q.y1, x[1].y1)))::DOUBLE >= 0.35)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM r)
SELECT image_id, CAST(i - 1 AS INTEGER) AS place, kept[i].id AS id FROM (SELECT image_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)""")
def spa13(s, d):
    return matching.suppressed(faces(s, d), PAGE, 0.35)


@query("spa14_fused_detections")
def spa14(s, d):
    return matching.fused(faces(s, d), PAGE, 0.35).select("image_id", "cluster", "members", *[F.round(k, 6).alias(k) for k in Box._fields])


@query("spa15_merged_candidates")
def spa15(s, d):
    return matching.fused(faces(s, d), PAGE, 0.2, 0.42).groupBy("image_id").agg(F.count("*").alias("clusters"), F.max("members").alias("largest"))


@query("spa16_even_subsample", with_(FACES, "l AS (SELECT image_id, list(id ORDER BY id) AS ids FROM faces GROUP BY 1)", "SELECT image_id, CASE WHEN len(ids) <= 4 THEN list_aggregate(ids, 'sum') ELSE list_aggregate([ids[CAST(round_even(i * (len(ids) - 1) / 3.0::DOUBLE, 0) AS INTEGER) + 1] FOR i IN [0, 1, 2, 3]], 'sum') END::BIGINT AS picked FROM l"))
def spa16(s, d):
    ids = faces(s, d).groupBy("image_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select("image_id", F.aggregate(boxes.evenly(c("ids"), 4), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("picked"))


@query("spa18_tile_to_page", with_(FACES, "SELECT image_id, id, 100 + x1 * 300 / 1000.0::DOUBLE AS px1, 200 + y2 * 400 / 1000.0::DOUBLE AS py2 FROM faces"))
def spa18(s, d):
    b = boxes.placed(box(), Box(*(F.lit(x) for x in (100, 200, 400, 600))))
    return faces(s, d).select("image_id", "id", b.x1.alias("px1"), b.y2.alias("py2"))


@query("spa19_entity_clusters")
def spa19(s, d):
    return matching.clustered(faces(s, d).withColumnRenamed("coder", "source"), PAGE, 0.2).groupBy("image_id").agg(F.max("cluster").alias("last"), F.count("*").alias("members"))


@query("spa20_mean_pair_iou", "WITH " + FACES + ", p AS (SELECT a.image_id, a.ad, CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS DOUBLE) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, CAST(a.x2 - a.x1 AS DOUBLE) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM faces a JOIN faces b ON a.image_id = b.image_id AND a.ad = b.ad AND a.id < b.id) SELECT image_id, ad, round(avg(i / (t - i)), 6) AS mean_iou, count(*) AS pairs FROM p GROUP BY ALL")
def spa20(s, d):
    return matching.mean_pair_iou(faces(s, d), ["image_id", "ad"]).withColumn("mean_iou", F.round("mean_iou", 6))


EDGES = "e AS (SELECT h.image_id, h.id AS a, p.id AS b FROM faces h JOIN faces p ON h.image_id = p.image_id AND h.id < p.id AND h.legibility = p.legibility)"
LABELS = "n AS (SELECT image_id, a, b FROM e UNION SELECT image_id, b, a FROM e), w AS (SELECT image_id, a AS node, a AS c FROM n UNION SELECT w.image_id, n.b, w.c FROM w JOIN n ON n.image_id = w.image_id AND n.a = w.node), l AS (SELECT image_id, node, min(c) AS component FROM w GROUP BY ALL)"


def edges(s, d):
    f = faces(s, d).select("image_id", "legibility", "id")
    return f.select("image_id", "legibility", c("id").alias("a")).join(f.select("image_id", "legibility", c("id").alias("b")), ["image_id", "legibility"]).where("a < b").select("image_id", "a", "b")


@query("spa21_components", "WITH RECURSIVE " + FACES + ", " + EDGES + ", " + LABELS + " SELECT * FROM l")
def spa21(s, d):
    return graphs.components(edges(s, d), PAGE)


@query("spa21_pair_set", "WITH RECURSIVE " + FACES + ", " + EDGES + ", " + LABELS + " SELECT x.image_id, x.node AS a, y.node AS b FROM l x JOIN l y ON x.image_id = y.image_id AND x.component = y.component AND x.node < y.node")
def spa21b(s, d):
    return graphs.pair_set(graphs.components(edges(s, d), PAGE), PAGE)


@query("spa22_weakest_strength", "WITH RECURSIVE " + FACES + ", " + EDGES + ", " + LABELS + " SELECT l.image_id, component, count(*) AS members, min(confidence) AS strength FROM l JOIN faces f ON f.image_id = l.image_id AND f.id = node GROUP BY ALL")
def spa22(s, d):
    l = graphs.components(edges(s, d), PAGE)
    return l.join(faces(s, d).select("image_id", c("id").alias("node"), "confidence"), ["image_id", "node"]).groupBy("image_id", "component").agg(F.count("*").alias("members"), F.min("confidence").alias("strength"))


@query("spa23_overlap_graph", "WITH RECURSIVE " + FACES + ", " + PAIRS + ", e AS (SELECT image_id, a, b FROM pairs_ WHERE iou >= 0.02 OR containment >= 0.25), n AS (SELECT image_id, a, b FROM e UNION SELECT image_id, b, a FROM e), w AS (SELECT image_id, a AS node, a AS c FROM n UNION SELECT w.image_id, n.b, w.c FROM w JOIN n ON n.image_id = w.image_id AND n.a = w.node), l AS (SELECT image_id, node, min(c) AS component FROM w GROUP BY ALL), k AS (SELECT f.image_id, coalesce(component, id) AS component, count(*) FILTER (coder = 'h') AS humans, count(*) FILTER (coder = 'p') AS others FROM faces f LEFT JOIN l ON l.image_id = f.image_id AND node = id GROUP BY ALL) SELECT CASE WHEN humans = 1 AND others = 1 THEN 'one_to_one' WHEN humans = 1 AND others > 1 THEN 'split' WHEN humans > 1 AND others = 1 THEN 'merge' WHEN humans > 1 AND others > 1 THEN 'complex' WHEN humans >= 1 THEN 'uncovered_human' ELSE 'unmatched_predicted' END AS kind, count(*) AS n FROM k GROUP BY 1")
def spa23(s, d):
    e = matching.candidates(*sides(s, d), PAGE, 0.02, 0.25, 0.0).select("image_id", "a", "b")
    l = graphs.components(e, PAGE)
    f = faces(s, d).select("image_id", c("id").alias("node"), "coder").join(l, ["image_id", "node"], "left")
    k = f.groupBy("image_id", F.coalesce("component", "node").alias("component")).agg(F.count_if(c("coder") == "h").alias("humans"), F.count_if(c("coder") == "p").alias("others"))
    return k.groupBy(graphs.component_kind().alias("kind")).agg(F.count("*").alias("n"))


@query("spa24_relative_geometry", with_(FACES, "SELECT image_id, id, round((x2 - x1) * (y2 - y1) / 12000.0::DOUBLE, 6) AS area_ratio, round((x1 + x2) / 2.0::DOUBLE / 120, 6) AS center_x FROM faces WHERE (x2 - x1) * (y2 - y1) / 12000.0::DOUBLE <= 1 AND (x1 + x2) / 2.0::DOUBLE / 120 <= 1 AND (y1 + y2) / 2.0::DOUBLE / 100 <= 1"))
def spa24(s, d):
    g = boxes.relative_to(box(), Box(F.lit(0), F.lit(0), F.lit(120), F.lit(100)))
    return faces(s, d).withColumn("g", g).where("g is not null").select("image_id", "id", F.round("g.area_ratio", 6).alias("area_ratio"), F.round("g.center_x", 6).alias("center_x"))


@query("spa25_largest_credit", with_(FACES, "a AS (SELECT *, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS area FROM faces)", "m AS (SELECT *, area = max(area) OVER (PARTITION BY image_id, ad) AS top, count(*) OVER (PARTITION BY image_id, ad) AS n, count(*) FILTER (gender = 'feminine') OVER (PARTITION BY image_id, ad) AS f FROM a)", "t AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY image_id, ad) AS tops FROM m)", "SELECT round(sum(CASE WHEN top AND gender = 'feminine' THEN 1.0::DOUBLE / tops ELSE 0 END), 4) AS credit, round(sum(f / n::DOUBLE / n), 4) AS expected FROM t"))
def spa25(s, d):
    w = Window.partitionBy("image_id", "ad")
    f = faces(s, d).withColumn("area", boxes.area(box())).withColumn("top", c("area") == F.max("area").over(w)).withColumn("n", F.count("*").over(w)).withColumn("f", F.count_if(c("gender") == "feminine").over(w)).withColumn("tops", F.count_if("top").over(w))
    return f.agg(F.round(F.sum(F.when(c("top") & (c("gender") == "feminine"), 1.0 / c("tops")).otherwise(0.0)), 4).alias("credit"), F.round(F.sum(c("f") / c("n") / c("n")), 4).alias("expected"))


@query("spa26_unique_maximum", with_(FACES, "SELECT image_id, ad, id FROM (SELECT *, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS area FROM faces) QUALIFY area = max(area) OVER (PARTITION BY image_id, ad) AND count(*) OVER (PARTITION BY image_id, ad, area) = 1"))
def spa26(s, d):
    f = faces(s, d).withColumn("area", boxes.area(box()))
    top = f.groupBy("image_id", "ad").agg(F.max(F.struct("area", "id")).alias("m"), F.max("area").alias("most"))
    ties = f.groupBy("image_id", "ad", "area").count()
    return top.join(ties, ["image_id", "ad"]).where("area = most and count = 1").select("image_id", "ad", "m.id")


@query("spa28_novel_items", with_(FACES, PAIRS, "SELECT image_id, id FROM faces f WHERE coder = 'p' AND NOT EXISTS (SELECT 1 FROM pairs_ WHERE pairs_.image_id = f.image_id AND b = f.id AND iou >= 0.1) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY id) <= 9"))
def spa28(s, d):
    h, p = sides(s, d)
    near = accepted(s, d, 0.1).select("image_id", c("b").alias("id"))
    new = p.select("image_id", "id").join(near, ["image_id", "id"], "left_anti")
    return new.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("id"))).where("k <= 9").drop("k")


@query("spa29_join_eligibility", "SELECT o_custkey, bool_and(k IS NOT NULL) AS eligible FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k GROUP BY 1")
def spa29(s, d):
    have = read(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("k", F.lit(True))
    return read(s, d, "orders").select("o_custkey", "o_orderkey").join(have, "o_orderkey", "left").groupBy("o_custkey").agg(F.bool_and(F.coalesce("k", F.lit(False))).alias("eligible"))


@query("spa30_unmatched", greedy_sql("iou", "iou >= 0.2").replace("SELECT image_id, m.a AS a, m.b AS b, round(m.iou, 6) AS iou FROM k", "SELECT f.image_id, f.id FROM faces f LEFT JOIN k ON k.image_id = f.image_id AND m.b = f.id WHERE coder = 'p' AND m.b IS NULL"))
def spa30(s, d):
    _, p = sides(s, d)
    pairs = matching.greedy(accepted(s, d), PAGE, c("iou")).select("image_id", c("b").alias("id"))
    return p.select("image_id", "id").join(pairs, ["image_id", "id"], "left_anti")


@query("spa31_envelope", with_(FACES, "SELECT p.image_id, p.id, CAST(min(h.x1) AS INTEGER) AS x1, CAST(max(h.x2) AS INTEGER) AS x2 FROM faces p JOIN faces h USING (image_id) WHERE p.coder = 'p' AND h.coder = 'h' AND abs(h.x1 + h.x2 - p.x1 - p.x2) <= 72 AND abs(h.y1 + h.y2 - p.y1 - p.y2) <= 72 GROUP BY ALL"))
def spa31(s, d):
    h, p = sides(s, d)
    a = h.select("image_id", c("x1").alias("hx1"), c("x2").alias("hx2"), (c("x1") + c("x2")).alias("hx"), (c("y1") + c("y2")).alias("hy"))
    return p.join(a, "image_id").where((F.abs(c("hx") - c("x1") - c("x2")) <= 72) & (F.abs(c("hy") - c("y1") - c("y2")) <= 72)).groupBy("image_id", "id").agg(F.min("hx1").alias("x1"), F.max("hx2").alias("x2"))


@query("spa32_tiles", "SELECT p_partkey, CAST(floor((900 + p_size) * x) AS INTEGER) AS x1, CAST(floor(600 * y) AS INTEGER) AS y1, CAST(ceil((900 + p_size) * (x + 0.6::DOUBLE)) AS INTEGER) AS x2, CAST(ceil(600 * (y + 0.6::DOUBLE)) AS INTEGER) AS y2 FROM part CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.4::DOUBLE]) AS x) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.4::DOUBLE]) AS y)")
def spa32(s, d):
    return read(s, d, "part").select("p_partkey", F.inline(boxes.tiles(900 + c("p_size"), F.lit(600))))


@query("srt06_reading_order", with_(FACES, "SELECT image_id, id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y1 + y2, x1 + x2, id) AS INTEGER) AS place FROM faces"))
def srt06(s, d):
    return matching.reading_order(faces(s, d), PAGE).select("image_id", "id", "place")
