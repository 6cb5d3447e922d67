"""Further queries of the inventory: variants over the same operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.functions import boxes
from annolith.functions import values as V
from annolith.functions.boxes import Box, box
from annolith.operators import checks, graphs, matching, tables
from annolith.operators import sampling as S

from .ledgers import DRAWS, SERIES, SUMS, two_years
from .registry import query
from .scores import LABELLED, labelled, six
from .spatial import PAGE, accepted, greedy_sql, sides
from .standins import FACES, PAGES, PAIRS, faces, pages, read, with_

c = F.col


@query("prj06_conditional", with_(FACES, "SELECT image_id, id, CASE WHEN smile = 'yes' AND intensity >= 3 THEN 'broad' WHEN smile = 'yes' THEN 'mild' WHEN smile = 'no' THEN 'none' ELSE 'unknown' END AS grade FROM faces"))
def prj06(s, d):
    yes = c("smile") == "yes"
    return faces(s, d).select("image_id", "id", V.chosen([(yes & (c("intensity") >= 3), "broad"), (yes, "mild"), (c("smile") == "no", "none")], "unknown").alias("grade"))


@query("prj18_ordinal_gates", with_(FACES, "SELECT image_id, id, legibility >= 1 AND intensity >= 2 AS down, legibility >= 1 OR intensity >= 2 AS up FROM faces"))
def prj18(s, d):
    a, b = c("legibility") >= 1, c("intensity") >= 2
    return faces(s, d).select("image_id", "id", V.gates_down(a, b).alias("down"), V.gates_up(a, b).alias("up"))


@query("prj20_predicates", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity BETWEEN 10 AND 20 AND l_linestatus IS DISTINCT FROM 'F'")
def prj20(s, d):
    return read(s, d, "lineitem").where(c("l_returnflag").isin("R", "A") & c("l_quantity").between(10, 20) & ~c("l_linestatus").eqNullSafe("F")).agg(F.count("*").alias("n"))


@query("prj24_cohort_invariants", with_(FACES, "SELECT 'ordinal range' AS \"check\", 'error' AS level, true AS passed, 0::BIGINT AS affected_rows, 'intensity 1 to 4' AS detail"))
def prj24(s, d):
    return checks.require(checks.audit(faces(s, d), [("ordinal range", "error", ~c("intensity").between(1, 4), "intensity 1 to 4")]))


@query("prj27_allowed_keys", "SELECT event_id, '{\"k\":' || (props->>'k') || '}' AS clean FROM events")
def prj27(s, d):
    noisy = F.from_json(F.concat(F.lit('{"comment":"x",'), F.substring("props", 2, 10_000)), "k bigint")
    return read(s, d, "events").select("event_id", F.to_json(noisy).alias("clean"))


@query("prj28_leak_check", "SELECT count(*) FILTER (url LIKE '%/home/%' OR url LIKE 'C:\\%') AS paths, count(*) FILTER (regexp_matches(html, '\"(session|assignment)_id\"')) AS keys FROM pages")
def prj28(s, d):
    return read(s, d, "pages").agg(F.count_if(c("url").rlike(r"/home/|^C:\\")).alias("paths"), F.count_if(c("html").rlike('"(session|assignment)_id"')).alias("keys"))


@query("prj30_effective_value", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 4 THEN o_orderstatus ELSE 'corrected' END AS effective FROM orders")
def prj30(s, d):
    r = c("o_orderkey") % 5
    return read(s, d, "orders").select("o_orderkey", F.when(r == 0, None).when(r < 4, c("o_orderstatus")).otherwise("corrected").alias("effective"))


@query("prj31_flatten_positions", "SELECT l_orderkey, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS position FROM lineitem")
def prj31(s, d):
    lines = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return tables.numbered(lines, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "position")


@query("prj35_output_integrity", with_(FACES, "SELECT count(*) FILTER (smile NOT IN ('yes', 'no', 'not_assessable')) AS bad_labels, count(*) FILTER (ad NOT BETWEEN 0 AND 2) AS bad_ads FROM faces"))
def prj35(s, d):
    return faces(s, d).agg(F.count_if(~c("smile").isin("yes", "no", "not_assessable")).alias("bad_labels"), F.count_if(~c("ad").between(0, 2)).alias("bad_ads"))


@query("prj37_offline_revalidation", "SELECT event_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 3 = 0)")
def prj37(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "event_type")
    return e.where("event_type = 'error'").join(e.where("user_id % 3 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


@query("prj40_trigger_reasons", with_(FACES, "SELECT image_id, id, concat_ws(',', CASE WHEN legibility = 0 THEN 'zero label' END, CASE WHEN confidence < 0.75 THEN 'low confidence' END) AS reasons FROM faces WHERE legibility = 0 OR confidence < 0.75"))
def prj40(s, d):
    why = F.filter(F.array(F.when(c("legibility") == 0, "zero label"), F.when(c("confidence") < 0.75, "low confidence")), lambda x: x.isNotNull())
    return faces(s, d).withColumn("why", why).where(F.size("why") > 0).select("image_id", "id", F.array_join("why", ",").alias("reasons"))


@query("joi03_zero_filled", with_(PAGES, "SELECT y.year, coalesce(a.n, 0) AS urgent, coalesce(b.n, 0) AS low FROM (SELECT DISTINCT year FROM pages_) y LEFT JOIN (SELECT year, count(*) AS n FROM pages_ WHERE medium = '1-URGENT' GROUP BY 1) a ON a.year = y.year LEFT JOIN (SELECT year, count(*) AS n FROM pages_ WHERE medium = '5-LOW' GROUP BY 1) b ON b.year = y.year"))
def joi03(s, d):
    return pages(s, d).groupBy("year").agg(F.count_if(c("medium") == "1-URGENT").alias("urgent"), F.count_if(c("medium") == "5-LOW").alias("low"))


@query("joi17_blind_status", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'missed' ELSE 'found' END AS status FROM customer")
def joi17(s, d):
    k = read(s, d, "customer")
    status = k.select("c_custkey", F.when(c("c_acctbal") < 0, "missed").otherwise("found").alias("status"))
    return checks.checked_join(k.select("c_custkey"), status, ["c_custkey"], "inner", one_left=True)


@query("joi21_latest_failure", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) GROUP BY 1")
def joi21(s, d):
    e = read(s, d, "events")
    done = e.where("event_type = 'purchase' and value > 100").select("user_id")
    return tables.latest(e.where("event_type = 'error'").join(done, "user_id", "left_anti").select("user_id", "event_id", "ts"), ["user_id"], c("ts")).select("user_id", "event_id")


@query("joi22_paired_runs", "SELECT a.user_id, a.n AS first, b.n AS second FROM (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) b ON a.user_id = b.user_id")
def joi22(s, d):
    e = read(s, d, "events")
    return e.groupBy("user_id").agg(F.count_if(c("event_id") % 2 == 0).alias("first"), F.count_if(c("event_id") % 2 == 1).alias("second")).where("first > 0 and second > 0")


@query("joi23_retry_replacement", "SELECT a.event_id, CASE WHEN a.event_type = 'error' AND b.value IS NOT NULL THEN b.value ELSE a.value END AS value, a.event_type = 'error' AND b.value IS NOT NULL AS replaced FROM events a LEFT JOIN (SELECT event_id - 1 AS event_id, value FROM events WHERE event_type <> 'error') b ON a.event_id = b.event_id")
def joi23(s, d):
    e = read(s, d, "events")
    retry = e.where("event_type <> 'error'").select((c("event_id") - 1).alias("event_id"), "value")
    return tables.override(e.select("event_id", "value", "event_type"), retry, ["event_id"], ["value"], c("event_type") == "error").select("event_id", "value", "replaced")


@query("agg02_null_keys_dropped", with_(FACES, "SELECT smile, count(*) AS n FROM faces WHERE smile <> 'not_assessable' GROUP BY 1"))
def agg02(s, d):
    known = faces(s, d).withColumn("smile", F.nullif("smile", F.lit("not_assessable")))
    return known.where("smile is not null").groupBy("smile").agg(F.count("*").alias("n"))


@query("agg05_distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT nullif(l_tax, 0)) AS taxes FROM lineitem")
def agg05(s, d):
    return read(s, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(F.nullif(c("l_tax") + 0.0, F.lit(0.0))).alias("taxes"))


@query("agg07_value_counts", "SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def agg07(s, d):
    return read(s, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))


@query("agg15_share_within", with_(FACES, "SELECT gender, smile, n, round(n / CAST(sum(n) OVER (PARTITION BY gender) AS DOUBLE), 6) AS share FROM (SELECT gender, smile, count(*) AS n FROM faces GROUP BY ALL)"))
def agg15(s, d):
    return six(tables.share_within(faces(s, d).groupBy("gender", "smile").agg(F.count("*").alias("n")), ["gender"], "n"), "share")


@query("agg16_pivot", with_(PAGES, "SELECT year, count(*) FILTER (medium = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (medium = '5-LOW') AS \"5-LOW\" FROM pages_ GROUP BY 1"))
def agg16(s, d):
    return tables.crosstab(pages(s, d), "year", "medium", ["1-URGENT", "5-LOW"])


@query("agg19_nested_counts", with_(FACES, "SELECT count(DISTINCT image_id) AS pages, count(DISTINCT image_id * 3 + ad) AS ads, count(*) AS people, count(*) FILTER (smile = 'yes') AS smiles FROM faces"))
def agg19(s, d):
    per_ad = faces(s, d).groupBy("image_id", "ad").agg(F.count("*").alias("k"), F.count_if(c("smile") == "yes").alias("y")).groupBy("image_id").agg(F.count("*").alias("a"), F.sum("k").alias("k"), F.sum("y").alias("y"))
    return per_ad.agg(F.count("*").alias("pages"), F.sum("a").alias("ads"), F.sum("k").alias("people"), F.sum("y").alias("smiles"))


@query("agg33_argmax_label", with_(FACES, "k AS (SELECT image_id, count(*) FILTER (smile = 'yes') AS y, count(*) FILTER (smile = 'no') AS n, count(*) FILTER (smile = 'not_assessable') AS u FROM faces GROUP BY 1)", "SELECT image_id, CASE WHEN y >= n AND y >= u THEN 'yes' WHEN u >= n THEN 'unknown' ELSE 'no' END AS label FROM k"))
def agg33(s, d):
    k = faces(s, d).groupBy("image_id").agg(*[F.count_if(c("smile") == v).alias(n) for v, n in (("yes", "y"), ("no", "n"), ("not_assessable", "u"))])
    top = F.array_max(F.array(F.struct(c("n").alias("k"), F.lit("no").alias("v")), F.struct(c("u").alias("k"), F.lit("unknown").alias("v")), F.struct(c("y").alias("k"), F.lit("yes").alias("v"))))
    return k.select("image_id", top["v"].alias("label"))


@query("agg34_category_audit", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price, round(avg((p_size > 25)::INTEGER), 6) AS large FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def agg34(s, d):
    k = read(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.round(F.avg((c("p_size") > 25).cast("double")), 6).alias("large"))
    return k.orderBy(F.desc("n"), "p_brand").limit(30)


@query("agg38_role_actions", "SELECT event_type, CAST(user_id % 3 AS INTEGER) AS role, count(*) AS n FROM events GROUP BY ALL")
def agg38(s, d):
    return read(s, d, "events").groupBy("event_type", (c("user_id") % 3).cast("int").alias("role")).agg(F.count("*").alias("n"))


@query("spa02_iou_containment", with_(FACES, PAIRS, "SELECT image_id, a, b, round(iou, 6) AS iou, round(containment, 6) AS containment FROM pairs_ WHERE iou >= 0.05"))
def spa02(s, d):
    h, p = sides(s, d)
    return matching.candidates(h, p, PAGE, 0.05).select("image_id", "a", "b", F.round("iou", 6).alias("iou"), F.round("containment", 6).alias("containment"))


@query("spa04_scale_normalised", with_(FACES, "SELECT image_id, id, CASE WHEN x2 > x1 AND y2 > y1 AND greatest(x2, y2) <= 80 THEN round(x1 / 1000.0::DOUBLE, 6) END AS x1, CASE WHEN x2 > x1 AND y2 > y1 AND greatest(x2, y2) <= 80 THEN round(y2 / 1000.0::DOUBLE, 6) END AS y2 FROM faces"))
def spa04(s, d):
    # boxes on 0 to 1000, half of them already on 0 to 1; those over 80 are put out of range and become null
    unit = c("id") % 2 == 0
    given = {k: F.when(F.greatest("x2", "y2") <= 80, F.when(unit, c(k) / 1000.0).otherwise(c(k).cast("double"))).otherwise(2000.0 + c(k)) for k in ("x1", "y1", "x2", "y2")}
    b = boxes.unit_scaled(Box(*given.values()))
    return faces(s, d).select("image_id", "id", F.round(b.x1, 6).alias("x1"), F.round(b.y2, 6).alias("y2"))


@query(
    "spa04_scale_by_field",
    with_(FACES, """SELECT image_id, id, CASE WHEN ok THEN round(x1 / f, 6) END AS x1, CASE WHEN ok THEN round(y2 / f, 6) END AS y2 FROM (
      SELECT image_id, id, x1, y2, CASE id % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END AS f, id % 5 <> 0 AND x1 < x2 AND y1 < y2 AS ok FROM faces)"""),
)
def spa04_field(s, d):
    # a third of the faces has both fields, the rest a unit field of three numbers or none; a fifth is turned round
    right = F.when(c("id") % 5 == 0, c("x1") - 1).otherwise(c("x2"))
    corners = F.array(*[x.cast("double") for x in (c("x1"), c("y1"), right, c("y2"))])
    unit = F.when(c("id") % 3 == 0, corners).when(c("id") % 3 == 1, F.slice(corners, 1, 3))
    found = faces(s, d).select("image_id", "id", boxes.by_field(unit, corners).alias("b"))
    return found.select("image_id", "id", F.round(c("b")[0], 6).alias("x1"), F.round(c("b")[3], 6).alias("y2"))


@query("spa05_fraction_covered", with_(FACES, PAIRS, "SELECT image_id, a, b, round(inter / ar_a, 6) AS of_a, round(inter / ar_b, 6) AS of_b FROM pairs_ WHERE inter > 0"))
def spa05(s, d):
    h, p = sides(s, d)
    pack = F.struct("x1", "y1", "x2", "y2")
    both = h.select("image_id", c("id").alias("a"), pack.alias("ab")).join(p.select("image_id", c("id").alias("b"), pack.alias("bb")), "image_id")
    ab, bb = box(row=c("ab")), box(row=c("bb"))
    return both.where(boxes.intersection(ab, bb) > 0).select("image_id", "a", "b", F.round(boxes.fraction_of(ab, bb), 6).alias("of_a"), F.round(boxes.fraction_of(bb, ab), 6).alias("of_b"))


@query("spa06_same_face", with_(FACES, "SELECT count(*) AS same FROM (SELECT *, CAST(greatest(0, least(hx2, px2) - greatest(hx1, px1)) AS DOUBLE) * greatest(0, least(hy2, py2) - greatest(hy1, py1)) AS i, CAST(hx2 - hx1 AS DOUBLE) * (hy2 - hy1) + CAST(px2 - px1 AS DOUBLE) * (py2 - py1) AS t, greatest(hx2 - hx1, hy2 - hy1, px2 - px1, py2 - py1, 1) AS side, (hx1 + hx2) / 2.0::DOUBLE - (px1 + px2) / 2.0::DOUBLE AS dx, (hy1 + hy2) / 2.0::DOUBLE - (py1 + py2) / 2.0::DOUBLE AS dy FROM (SELECT image_id, x1 AS hx1, y1 AS hy1, x2 AS hx2, y2 AS hy2 FROM faces WHERE coder = 'h') JOIN (SELECT image_id, x1 AS px1, y1 AS py1, x2 AS px2, y2 AS py2 FROM faces WHERE coder = 'p') USING (image_id)) WHERE i / (t - i) >= 0.2 OR sqrt(dx * dx + dy * dy) <= 0.42::DOUBLE * side"))
def spa06(s, d):
    h, p = sides(s, d)
    pack = F.struct("x1", "y1", "x2", "y2")
    both = h.select("image_id", pack.alias("ab")).join(p.select("image_id", pack.alias("bb")), "image_id")
    return both.where(boxes.same_face(box(row=c("ab")), box(row=c("bb")))).agg(F.count("*").alias("same"))


@query("spa17_recentered", with_(FACES, "SELECT image_id, id, round(x1 + (70 - (x1 + x2) / 2.0::DOUBLE) * 0.5, 6) AS x1, round(greatest(0, least(1000, y2 + (50 - (y1 + y2) / 2.0::DOUBLE) * 0.5)), 6) AS y2 FROM faces"))
def spa17(s, d):
    b = boxes.recentered(box(), Box(*(F.lit(v) for v in (60, 40, 80, 60))), 0.5)
    return faces(s, d).select("image_id", "id", F.round(b.x1, 6).alias("x1"), F.round(b.y2, 6).alias("y2"))


@query("spa27_novelty_flags", with_(FACES, PAIRS, "SELECT id, f.image_id, coalesce(m, false) AS known FROM faces f LEFT JOIN (SELECT image_id, b, true AS m FROM pairs_ WHERE iou >= 0.2 GROUP BY ALL) k ON k.image_id = f.image_id AND b = id WHERE coder = 'p'"))
def spa27(s, d):
    _, p = sides(s, d)
    known = accepted(s, d).select("image_id", c("b").alias("id")).distinct().withColumn("m", F.lit(True))
    return p.select("id", "image_id").join(known, ["image_id", "id"], "left").select("id", "image_id", F.coalesce("m", F.lit(False)).alias("known"))


CAPPED = """, r AS (SELECT image_id, list([{'c': -confidence, 'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] ORDER BY -confidence, id) AS rows FROM faces GROUP BY 1),
k AS (SELECT image_id, list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: greatest(0, least(q.x2, x[1].x2) - greatest(q.x1, x[1].x1)) * greatest(0, least(q.y2, x[1].y2) - greatest(q.y1, x[1].y1)) / ((q.x2 - q.x1) * (q.y2 - q.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - greatest(0, least(q.x2, x[1].x2) - greatest(q.x1, x[1].x1)) * greatest(0, least(q.y2, x[1].y2) - greatest(q.y1, x[1].y1)))::DOUBLE >= 0.85)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM r)
SELECT image_id, least(6, len(kept)) AS kept FROM k"""


@query("spa34_capped_suppression", "WITH " + FACES + CAPPED)
def spa34(s, d):
    return matching.suppressed(faces(s, d), PAGE, 0.85, 6).groupBy("image_id").agg(F.count("*").alias("kept"))


@query(
    "met14_duplicate_pairs",
    greedy_sql("iou", "iou >= 0.2").replace("SELECT image_id, m.a AS a, m.b AS b, round(m.iou, 6) AS iou FROM k", """, g AS (SELECT image_id, m.a AS a, m.b AS b FROM k),
      d AS (SELECT x.image_id, x.coder, x.id AS a, y.id AS b FROM faces x JOIN faces y ON x.image_id = y.image_id AND x.coder = y.coder AND x.legibility = y.legibility AND x.id < y.id),
      pl AS (SELECT d.image_id, ga.a AS x, gb.a AS y FROM d LEFT JOIN g ga ON ga.image_id = d.image_id AND ga.b = d.a LEFT JOIN g gb ON gb.image_id = d.image_id AND gb.b = d.b WHERE d.coder = 'p'),
      mp AS (SELECT DISTINCT image_id, least(x, y) AS a, greatest(x, y) AS b FROM pl WHERE x IS NOT NULL AND y IS NOT NULL),
      go AS (SELECT image_id, a, b FROM d WHERE coder = 'h'),
      po AS (SELECT * FROM go WHERE EXISTS (SELECT 1 FROM g WHERE g.image_id = go.image_id AND g.a = go.a) AND EXISTS (SELECT 1 FROM g WHERE g.image_id = go.image_id AND g.a = go.b))
      SELECT (SELECT count(*) FROM mp WHERE (image_id, a, b) IN (SELECT image_id, a, b FROM go)) AS tp, (SELECT count(*) FROM mp WHERE (image_id, a, b) NOT IN (SELECT image_id, a, b FROM go)) + (SELECT count(*) FROM pl WHERE x IS NULL OR y IS NULL) AS fp, (SELECT count(*) FROM po WHERE (image_id, a, b) NOT IN (SELECT image_id, a, b FROM mp)) AS fn"""),
)
def met14(s, d):
    f = faces(s, d)
    e = lambda n: f.where(c("coder") == n).select("image_id", "legibility", c("id").alias("a")).join(f.where(c("coder") == n).select("image_id", "legibility", c("id").alias("b")), ["image_id", "legibility"]).where("a < b").select("image_id", "a", "b")
    links = matching.greedy(accepted(s, d), PAGE, c("iou")).select("image_id", c("b").alias("proposed_id"), c("a").alias("gold_id"))
    return graphs.pair_scores(e("p"), e("h"), links, PAGE)


@query("met18_recall_by_label", with_(FACES, LABELLED, "SELECT human AS label, count(*) AS n, round(avg(coalesce(human = other, false)::INTEGER), 6) AS recall FROM lab WHERE human IS NOT NULL GROUP BY 1"))
def met18(s, d):
    return labelled(s, d).where("human is not null").groupBy(c("human").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((c("human") == c("other")).cast("double"), F.lit(0.0))), 6).alias("recall"))


@query("met20_macro_accuracy", with_(FACES, LABELLED, "SELECT round(avg(a), 6) AS macro FROM (SELECT gender, avg((lh = lo)::INTEGER) AS a FROM lab GROUP BY 1)"))
def met20(s, d):
    return labelled(s, d).groupBy("gender").agg(F.avg((c("lh") == c("lo")).cast("double")).alias("a")).agg(F.round(F.avg("a"), 6).alias("macro"))


@query("met23_count_error", with_(FACES, "SELECT ad, round(avg(abs(h - p)), 6) AS mae FROM (SELECT image_id, ad, count(*) FILTER (coder = 'h') AS h, count(*) FILTER (coder = 'p') AS p FROM faces GROUP BY ALL) GROUP BY 1"))
def met23(s, d):
    k = faces(s, d).groupBy("image_id", "ad").agg(F.count_if(c("coder") == "h").alias("h"), F.count_if(c("coder") == "p").alias("p"))
    return k.groupBy("ad").agg(F.round(F.avg(F.abs(c("h") - c("p")).cast("double")), 6).alias("mae"))


@query("met25_mismatch_cascade", with_(FACES, LABELLED, "SELECT CASE WHEN human IS NULL AND other IS NULL THEN 'both missing' WHEN human IS NULL THEN 'human missing' WHEN other IS NULL THEN 'other missing' WHEN human <> other THEN 'different' ELSE 'same' END AS reason, count(*) AS n FROM lab GROUP BY 1"))
def met25(s, d):
    h, o = c("human"), c("other")
    return labelled(s, d).groupBy(V.chosen([(h.isNull() & o.isNull(), "both missing"), (h.isNull(), "human missing"), (o.isNull(), "other missing"), (h != o, "different")], "same").alias("reason")).agg(F.count("*").alias("n"))


@query("met27_confidence_by_match", "SELECT l_returnflag, round(avg(CAST(l_partkey % 101 AS DOUBLE) / 100), 6) AS mean, count(*) FILTER (CAST(l_partkey % 101 AS DOUBLE) / 100 >= 0.8) AS sure FROM lineitem GROUP BY 1")
def met27(s, d):
    p = (c("l_partkey") % 101).cast("double") / 100
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(p), 6).alias("mean"), F.count_if(p >= 0.8).alias("sure"))


@query("met29_rare_class", with_(FACES, LABELLED, "SELECT count(*) FILTER (lo = 0) AS predicted, round(count(*) FILTER (lo = 0) / count(*)::DOUBLE, 6) AS rate, round(count(*) FILTER (lo = 0 AND lh = 0) / count(*) FILTER (lo = 0)::DOUBLE, 6) AS precision, count(*) FILTER (lh = 0) AS human FROM lab"))
def met29(s, d):
    p, h = c("lo") == 0, c("lh") == 0
    return labelled(s, d).agg(F.count_if(p).alias("predicted"), F.round(F.count_if(p) / F.count("*"), 6).alias("rate"), F.round(F.count_if(p & h) / F.count_if(p), 6).alias("precision"), F.count_if(h).alias("human"))


@query("met34_lost_labels", with_(FACES, LABELLED, "SELECT image_id, id FROM lab WHERE human IS NOT NULL AND other IS NULL AND lo < lh"))
def met34(s, d):
    return labelled(s, d).where("human is not null and other is null and lo < lh").select("image_id", "id")


@query("win04_top_n", with_(PAGES, "SELECT year, issue, n FROM (SELECT year, issue, count(*) AS n FROM pages_ GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, issue) <= 3"))
def win04(s, d):
    k = pages(s, d).groupBy("year", "issue").agg(F.count("*").alias("n"))
    return k.withColumn("p", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "issue"))).where("p <= 3").drop("p")


@query("srt04_lowest", with_(FACES, "SELECT image_id, id, confidence FROM faces ORDER BY confidence, image_id, id LIMIT 30"))
def srt04(s, d):
    return faces(s, d).select("image_id", "id", "confidence").orderBy("confidence", "image_id", "id").limit(30)


@query("srt05_top_dropped", with_(PAGES, "SELECT year, count(*) FILTER (medium = '5-LOW') AS dropped, count(*) AS n FROM pages_ GROUP BY 1 ORDER BY dropped DESC, n DESC, year LIMIT 10"))
def srt05(s, d):
    k = pages(s, d).groupBy("year").agg(F.count_if(c("medium") == "5-LOW").alias("dropped"), F.count("*").alias("n"))
    return k.orderBy(F.desc("dropped"), F.desc("n"), "year").limit(10)


@query("srt08_ordinal_slices", with_(PAGES, "SELECT CASE WHEN n < 140 THEN 'first' WHEN n < 280 THEN 'second' ELSE 'rest' END AS scope, count(*) AS n, min(image_id) AS least, max(image_id) AS most FROM (SELECT image_id, row_number() OVER (ORDER BY issue, image_id) - 1 AS n FROM pages_) GROUP BY 1"))
def srt08(s, d):
    place = tables.numbered(pages(s, d).select("issue", "image_id"), ["issue", "image_id"])
    return place.groupBy(V.chosen([(c("position") < 140, "first"), (c("position") < 280, "second")], "rest").alias("scope")).agg(F.count("*").alias("n"), F.min("image_id").alias("least"), F.max("image_id").alias("most"))


@query("srt09_casefold_order", "SELECT p_type, CAST(row_number() OVER (ORDER BY lower(p_type), p_type) AS INTEGER) AS place FROM (SELECT DISTINCT p_type FROM part)")
def srt09(s, d):
    names = tables.numbered(read(s, d, "part").select("p_type").distinct(), [F.lower("p_type"), c("p_type")])
    return names.select("p_type", (c("position") + 1).cast("int").alias("place"))


@query("set05_disjoint", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) = 0 AS disjoint_, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)) = 0 AS subset_")
def set05(s, d):
    o = read(s, d, "orders").groupBy("o_orderkey").agg(F.bool_or(c("o_orderstatus") == "F").alias("f"), F.bool_or(c("o_orderstatus") == "O").alias("o")).agg((F.count_if(c("f") & c("o")) == 0).alias("disjoint_"))
    orphan = read(s, d, "supplier").select(c("s_nationkey").alias("n_nationkey")).join(read(s, d, "nation"), "n_nationkey", "left_anti").agg((F.count("*") == 0).alias("subset_"))
    return o.join(orphan)


@query("fun05_interval_text", "SELECT l_returnflag, printf('%.1f [%.1f, %.1f]', round(avg(l_quantity), 1), min(l_quantity), max(l_quantity)) AS text FROM lineitem GROUP BY 1")
def fun05(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(V.interval_text(F.round(F.avg("l_quantity"), 1), F.min("l_quantity"), F.max("l_quantity")).alias("text"))


@query("fun07_elapsed", "SELECT user_id, date_diff('minute', date_trunc('minute', min(ts)), date_trunc('minute', max(ts))) AS minutes FROM events GROUP BY 1")
def fun07(s, d):
    m = lambda x: F.unix_seconds(F.date_trunc("minute", x).cast("timestamp"))
    return read(s, d, "events").groupBy("user_id").agg(((m(F.max("ts")) - m(F.min("ts"))) / 60).cast("bigint").alias("minutes"))


@query("fun13_dotted_path", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def fun13(s, d):
    return read(s, d, "events").select("event_id", F.struct(F.from_json("props", "k int").alias("b")).alias("a")).select("event_id", c("a.b.k").alias("k"))


@query("fun18_image_types", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'jpg' WHEN n_nationkey % 3 = 1 THEN 'png' ELSE 'gif' END AS kind, count(*) AS n FROM nation GROUP BY 1")
def fun18(s, d):
    heads = F.array(F.lit("FFD8FFE0"), F.lit("89504E470D0A1A0A"), F.lit("474946383961"))
    return read(s, d, "nation").withColumn("b", F.unhex(F.get(heads, (c("n_nationkey") % 3).cast("int")))).groupBy(V.image_type(c("b")).alias("kind")).agg(F.count("*").alias("n"))


@query("fun19_strict_bool", "SELECT c_custkey, c_acctbal > 0 AS ok FROM customer")
def fun19(s, d):
    return read(s, d, "customer").select("c_custkey", V.strict_bool(F.when(c("c_acctbal") > 0, "True").otherwise("FALSE")).alias("ok"))


@query("fun21_clamped_coordinates", "SELECT s_suppkey, round(greatest(0.0, least(1.0, s_acctbal / 9000)), 6)::DOUBLE AS x FROM supplier")
def fun21(s, d):
    return read(s, d, "supplier").select("s_suppkey", F.round(boxes.clamp(c("s_acctbal") / 9000, 0.0, 1.0), 6).alias("x"))


@query("smp11_random_sample", with_(PAGES, "SELECT image_id FROM pages_ ORDER BY sha256('9:' || CAST(image_id AS VARCHAR)), image_id LIMIT 40"))
def smp11(s, d):
    return pages(s, d).select("image_id").orderBy(S.hash_key(9, c("image_id")), "image_id").limit(40)


@query("smp18_paired_probability", with_(PAGES, DRAWS, SUMS, SERIES, "SELECT round(avg((b.value > a.value)::INTEGER), 6) AS chance FROM se a JOIN se b ON a.replicate = b.replicate WHERE a.year = 1996 AND b.year = 1999"))
def smp18(s, d):
    return S.paired_delta(*two_years(s, d), []).agg(F.round(F.avg((c("value") > 0).cast("double")), 6).alias("chance"))


@query("smp25_tiered_audit", with_(PAGES, "a AS (SELECT image_id, 'per cell' AS reason FROM pages_ QUALIFY row_number() OVER (PARTITION BY year ORDER BY sha256('2:' || CAST(image_id AS VARCHAR)), image_id) <= 2)", "b AS (SELECT image_id, 'stress' FROM pages_ WHERE image_id IN (3, 5, 8) AND image_id NOT IN (SELECT image_id FROM a))", "SELECT * FROM a UNION ALL SELECT * FROM b"))
def smp25(s, d):
    p = pages(s, d)
    a = S.first_by_hash(p, ["year"], "image_id", 2, 2).select("image_id", F.lit("per cell").alias("reason"))
    return a.unionByName(p.where(c("image_id").isin(3, 5, 8)).join(a, "image_id", "left_anti").select("image_id", F.lit("stress").alias("reason")))


@query("smp27_pinned_first", with_(PAGES, "SELECT image_id FROM pages_ ORDER BY CASE image_id WHEN 77 THEN 0 WHEN 5 THEN 1 ELSE 2 END, image_id LIMIT 30"))
def smp27(s, d):
    return pages(s, d).select("image_id").orderBy(F.when(c("image_id") == 77, 0).when(c("image_id") == 5, 1).otherwise(2), "image_id").limit(30)


@query("smp28_disjoint_cohorts", with_(PAGES, "SELECT CASE WHEN image_id % 2 = 0 THEN 'a' ELSE 'b' END AS cohort, count(*) AS n, count(DISTINCT image_id) AS distinct_ FROM pages_ GROUP BY 1"))
def smp28(s, d):
    return pages(s, d).groupBy(F.when(c("image_id") % 2 == 0, "a").otherwise("b").alias("cohort")).agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("distinct_"))

