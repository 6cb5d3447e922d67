"""Queries over flat tables: SRC, PRJ, JOI, AGG, WIN, SRT, SET."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.functions import values as V
from annolith.functions.boxes import box, clamp_box, scaled, size_bin, suspicious, valid
from annolith.operators import checks, tables
from annolith.operators.sampling import first_by_hash

from .registry import query
from .standins import FACES, PAGES, faces, pages, read, with_

c = F.col


@query("win01_ranked_dedup", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars DESC NULLS LAST, doc_id) = 1")
def win01(s, d):
    rows = read(s, d, "documents").withColumn("text_md5", F.md5("text"))
    # the key is the text's digest with its length, so that whole texts aren't sorted
    return tables.latest(rows.select("doc_id", "lang", "source", "n_chars", "text_md5", F.length("text").alias("len")), ["text_md5", "len"], F.struct("n_chars", -c("doc_id"))).select("doc_id", "lang", "source", "n_chars", "text_md5")


@query("prj01_filename_parts", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(regexp_extract(f, '^(\\d{4}-\\d{4})-(\\d{4}(?:,\\d{4})*)', 1), '') AS issue, nullif(regexp_extract(f, '^(\\d{4}-\\d{4})-(\\d{4}(?:,\\d{4})*)', 2), '') AS pages FROM (SELECT *, strftime(l_shipdate, '%Y-%m%d') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '_' || CAST(l_suppkey AS VARCHAR) || '.jpg' AS f FROM lineitem)")
def prj01(s, d):
    name = F.concat(F.date_format("l_shipdate", "yyyy-MMdd"), F.lit("-"), F.lpad(c("l_linenumber").cast("string"), 4, "0"), F.lit("_"), c("l_suppkey").cast("string"), F.lit(".jpg"))
    pattern = r"^(\d{4}-\d{4})-(\d{4}(?:,\d{4})*)"
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.extract(name, pattern, 1).alias("issue"), V.extract(name, pattern, 2).alias("pages"))


@query("prj02_scan_id", "SELECT page_id, split_part(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]+$', ''), '_', 1) AS scan_id FROM pages")
def prj02(s, d):
    return read(s, d, "pages").select("page_id", V.scan_id(F.regexp_extract("url", "[^/]*$", 0)).alias("scan_id"))


@query("prj03_decades", with_(PAGES, "SELECT CAST(year - year % 10 AS INTEGER) AS decade, CASE WHEN year < 1997 THEN 'early' WHEN year < 2000 THEN 'middle' ELSE 'late' END AS period, count(*) AS n FROM pages_ GROUP BY ALL"))
def prj03(s, d):
    period = V.chosen([(c("year") < 1997, "early"), (c("year") < 2000, "middle")], "late")
    return pages(s, d).groupBy(V.decade(c("year")).alias("decade"), period.alias("period")).agg(F.count("*").alias("n"))


@query("prj04_count_bins", with_(FACES, "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN n <= 0 THEN NULL WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 11 THEN '6-11' ELSE '12+' END AS bin FROM (SELECT image_id, count(*) AS n FROM faces GROUP BY 1)) GROUP BY 1"))
def prj04(s, d):
    return faces(s, d).groupBy("image_id").agg(F.count("*").alias("k")).groupBy(V.face_count_bin(c("k")).alias("bin")).agg(F.count("*").alias("n"))


@query("prj05_size_bins", with_(FACES, "SELECT CASE WHEN (y2 - y1) / 200.0::DOUBLE < 0.035 THEN 'tiny' WHEN (y2 - y1) / 200.0::DOUBLE < 0.07 THEN 'small' WHEN (y2 - y1) / 200.0::DOUBLE < 0.14 THEN 'medium' ELSE 'large' END AS bin, count(*) AS n FROM faces GROUP BY 1"))
def prj05(s, d):
    return faces(s, d).groupBy(size_bin(c("y2") - c("y1"), F.lit(200.0)).alias("bin")).agg(F.count("*").alias("n"))


@query("prj07_coerce", "SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def prj07(s, d):
    return read(s, d, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).try_cast("bigint").alias("k"), c("event_type").try_cast("double").alias("bad"))


@query("prj08_range_accounting", with_(PAGES, "SELECT count(*) AS total, count(*) FILTER (year BETWEEN 1996 AND 1999) AS kept, count(*) FILTER (year < 1996) AS before, count(*) FILTER (year > 1999) AS after FROM pages_"))
def prj08(s, d):
    y = c("year")
    return pages(s, d).agg(F.count("*").alias("total"), F.count_if(y.between(1996, 1999)).alias("kept"), F.count_if(y < 1996).alias("before"), F.count_if(y > 1999).alias("after"))


@query("prj09_span_filter", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS span, CAST(count(*) AS INTEGER) AS pages, count(*) <= 2 AS kept FROM orders GROUP BY 1")
def prj09(s, d):
    span = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    rows = read(s, d, "orders").groupBy("o_custkey").agg(span.alias("span"))
    n = F.size(F.split("span", ","))
    return rows.select("o_custkey", "span", n.alias("pages"), (n <= 2).alias("kept"))


@query("prj10_scope_gaps", "SELECT * FROM (SELECT i AS c_custkey, 'missing' AS problem FROM (SELECT unnest(range(2000)) AS i) WHERE i NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'repeated' FROM customer GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT c_custkey, 'outside' FROM customer WHERE c_custkey < 0 OR c_custkey >= 2000 OR c_custkey IS NULL GROUP BY 1)")
def prj10(s, d):
    return checks.scope_gaps(read(s, d, "customer"), "c_custkey", 2000)


@query("prj11_enum_repair", "SELECT l_orderkey AS image_id, CASE WHEN len(k) > 1 THEN 'multiple_types_present' WHEN len(k) = 1 THEN k[1] ELSE 'unknown' END AS kind FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag) FILTER (l_returnflag IN ('R', 'A')))) AS k FROM lineitem GROUP BY 1)")
def prj11(s, d):
    rows = read(s, d, "lineitem").groupBy(c("l_orderkey").alias("image_id")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("v"))
    return rows.select("image_id", V.enum_value(c("v"), ["R", "A", "multiple_types_present"], "unknown").alias("kind"))


@query("prj12_category_repair", "WITH alias(said, category) AS (VALUES ('building', 'home'), ('furniture', 'home'), ('household', 'home'), ('automobile', 'transport'), ('machinery', 'industry')) SELECT c_custkey, coalesce(category, 'other') AS category FROM customer LEFT JOIN alias ON lower(trim(c_mktsegment)) = said")
def prj12(s, d):
    alias = s.createDataFrame([("building", "home"), ("furniture", "home"), ("household", "home"), ("automobile", "transport"), ("machinery", "industry")], "said string, category string")
    return read(s, d, "customer").join(F.broadcast(alias), F.lower(F.trim("c_mktsegment")) == c("said"), "left").select("c_custkey", F.coalesce("category", F.lit("other")).alias("category"))


@query("prj13_clamp_box", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, x1, y1, x2, y2 FROM (SELECT *, CAST(greatest(0, least(1000, round_even(l_quantity * 25 - 30.5, 0))) AS INTEGER) AS x1, CAST(greatest(0, least(1000, round_even(l_suppkey * 10.5, 0))) AS INTEGER) AS y1, CAST(greatest(0, least(1000, round_even(l_quantity * 25 + 10.5, 0))) AS INTEGER) AS x2, CAST(greatest(0, least(1000, round_even(l_suppkey * 10.5 + 100, 0))) AS INTEGER) AS y2 FROM lineitem) WHERE x1 < x2 AND y1 < y2")
def prj13(s, d):
    q, k = c("l_quantity") * 25, c("l_suppkey") * 10.5
    made = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", clamp_box(box()._replace(x1=q - 30.5, y1=k, x2=q + 10.5, y2=k + 100)).alias("b"))
    return made.where("b is not null").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b.*")


@query("prj14_clamp_confidence", "SELECT event_id, coalesce(greatest(0.0, least(1.0, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value / 100 AS VARCHAR) END AS DOUBLE))), 0.5)::DOUBLE AS confidence FROM events")
def prj14(s, d):
    said = F.when(c("event_type") == "error", "n/a").otherwise((c("value") / 100).cast("string"))
    return read(s, d, "events").select("event_id", V.confidence(said).alias("confidence"))


@query("prj15_normalise", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN lower(trim(o_orderpriority)) = '1-urgent' THEN '0-urgent' ELSE lower(trim(o_orderpriority)) END AS priority FROM orders")
def prj15(s, d):
    said = F.when(c("o_orderpriority") == "5-LOW", "not_applicable").otherwise(c("o_orderpriority"))
    plain = V.normalised(said, "depiction_type")
    return read(s, d, "orders").select("o_orderkey", F.when(plain == "1-urgent", "0-urgent").otherwise(plain).alias("priority"))


@query("prj16_clean_structure", with_(FACES, "SELECT image_id, CAST(count(*) AS INTEGER) AS faces, CAST(count(*) FILTER (x1 + x2 <= 140 AND y1 + y2 <= 140) AS INTEGER) AS kept, CAST(count(*) FILTER (NOT (x1 + x2 <= 140 AND y1 + y2 <= 140)) AS INTEGER) AS dropped FROM faces GROUP BY 1"))
def prj16(s, d):
    nested = faces(s, d).groupBy("image_id").agg(F.collect_list(F.struct("id", "x1", "y1", "x2", "y2")).alias("people"))
    kept = F.filter("people", lambda p: (p["x1"] + p["x2"] <= 140) & (p["y1"] + p["y2"] <= 140))
    return nested.select("image_id", F.size("people").alias("faces"), F.size(kept).alias("kept"), (F.size("people") - F.size(kept)).alias("dropped"))


@query("prj17_route_caps", with_(FACES, "SELECT image_id, CASE WHEN n >= 6 THEN 'group' ELSE 'individual' END AS route, CAST(least(n, CASE WHEN n >= 6 THEN 3 ELSE 9 END) AS INTEGER) AS people, first_id FROM (SELECT image_id, count(*) AS n, min(id) AS first_id FROM faces GROUP BY 1)"))
def prj17(s, d):
    nested = faces(s, d).groupBy("image_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    group = F.size("ids") >= 6
    cut = F.slice("ids", F.lit(1), F.when(group, 3).otherwise(9))
    return nested.select("image_id", F.when(group, "group").otherwise("individual").alias("route"), F.size(cut).alias("people"), cut[0].alias("first_id"))


@query("prj19_conditional_nulls", with_(FACES, "SELECT image_id, id, 'intensity' AS field, CAST(intensity AS VARCHAR) AS from_value, CAST(NULL AS VARCHAR) AS to_value, 'smile is not yes' AS rule FROM faces WHERE smile <> 'yes' UNION ALL SELECT image_id, id, 'smile', smile, NULL, 'smile is not yes' FROM faces WHERE legibility = 0"))
def prj19(s, d):
    after = {"intensity": F.when(c("smile") == "yes", c("intensity")), "smile": F.when(c("legibility") > 0, c("smile"))}
    return checks.changes(faces(s, d), ["image_id", "id"], after, "smile is not yes")


@query("prj21_drop_by_child", with_(FACES, "SELECT image_id, CAST(count(DISTINCT ad) AS INTEGER) AS ads, CAST(count(DISTINCT ad) FILTER (ad_n < 3) AS INTEGER) AS kept FROM (SELECT *, count(*) OVER (PARTITION BY image_id, ad) AS ad_n FROM faces) GROUP BY 1"))
def prj21(s, d):
    ads = faces(s, d).groupBy("image_id", "ad").agg(F.collect_list("id").alias("people")).groupBy("image_id").agg(F.collect_list(F.struct("ad", "people")).alias("ads"))
    return ads.select("image_id", F.size("ads").alias("ads"), F.size(F.filter("ads", lambda a: F.size(a["people"]) < 3)).alias("kept"))


@query("prj22_exclude_by_element", "SELECT o_custkey, CAST(len(list_intersect(ids, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])) AS INTEGER) AS hits, list_has_any(ids, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]) AS excluded FROM (SELECT o_custkey, list(o_orderkey) AS ids FROM orders GROUP BY 1)")
def prj22(s, d):
    out = F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)])
    rows = read(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return rows.select("o_custkey", F.size(F.array_intersect("ids", out)).alias("hits"), F.arrays_overlap("ids", out).alias("excluded"))


@query("prj23_constraint_audit", with_(FACES, """SELECT * FROM (
 SELECT 'bounds' AS "check", 'error' AS level, n = 0 AS passed, n AS affected_rows, 'box within the page' AS detail FROM (SELECT count(*) AS n FROM faces WHERE x1 < 0 OR y1 < 0 OR x2 > 200 OR y2 > 200)
 UNION ALL SELECT 'intensity', 'warning', n = 0, n, 'only with a smile' FROM (SELECT count(*) AS n FROM faces WHERE smile <> 'yes' AND intensity > 1)
 UNION ALL SELECT 'face key', 'error', n = 0, n, 'repeated image_id, id' FROM (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM faces GROUP BY image_id, id HAVING count(*) > 1))
 UNION ALL SELECT 'page of face', 'error', n = 0, n, 'no parent by image_id' FROM (SELECT count(*) AS n FROM faces WHERE image_id NOT IN (SELECT o_orderkey FROM orders)))"""))
def prj23(s, d):
    f = faces(s, d)
    own = checks.audit(f, [("bounds", "error", (c("x1") < 0) | (c("y1") < 0) | (c("x2") > 200) | (c("y2") > 200), "box within the page"), ("intensity", "warning", (c("smile") != "yes") & (c("intensity") > 1), "only with a smile")])
    return checks.audits(own, checks.unique_key(f, ["image_id", "id"], "face key"), checks.orphans(f, pages(s, d), ["image_id"], "page of face"))


@query("prj25_box_counters", with_(FACES, "SELECT count(*) FILTER (x1 >= x2) AS bad_x, count(*) FILTER (y1 >= y2) AS bad_y, count(*) FILTER (x2 > 100 OR y2 > 100) AS outside, count(*) FILTER (x1 < x2 AND y1 < y2) AS sound FROM faces"))
def prj25(s, d):
    return faces(s, d).agg(F.count_if(c("x1") >= c("x2")).alias("bad_x"), F.count_if(c("y1") >= c("y2")).alias("bad_y"), F.count_if((c("x2") > 100) | (c("y2") > 100)).alias("outside"), F.count_if(valid(box())).alias("sound"))


@query("prj26_suspicious", with_(FACES, "SELECT image_id, id, (CASE WHEN greatest(w / h, h / w) > 1.85 AND h > 95 THEN 'aspect' ELSE '' END || CASE WHEN w * h / 1e6 > 0.045 THEN ' area' ELSE '' END || CASE WHEN h > 260 THEN ' height' ELSE '' END || CASE WHEN w > 260 THEN ' width' ELSE '' END) AS reasons FROM (SELECT image_id, id, CAST(x2 - x1 AS DOUBLE) * 5 AS w, CAST(y2 - y1 AS DOUBLE) * 5 AS h FROM faces) WHERE w * h / 1e6 > 0.045 OR h > 260 OR w > 260 OR (greatest(w / h, h / w) > 1.85 AND h > 95)"))
def prj26(s, d):
    b = box()
    why = suspicious(b._replace(x1=b.x1 * 5, y1=b.y1 * 5, x2=b.x2 * 5, y2=b.y2 * 5))
    text = F.concat(*[F.when(F.array_contains("why", k), (" " if k != "aspect" else "") + k).otherwise("") for k in ("aspect", "area", "height", "width")])
    return faces(s, d).withColumn("why", why).where(F.size("why") > 0).select("image_id", "id", text.alias("reasons"))


@query("prj33_scale_boxes", with_(FACES, "SELECT image_id, id, round_even(least(1, greatest(0, x1 / 1000.0::DOUBLE)), 4) AS sx1, round_even(least(1, greatest(0, y2 / 1000.0::DOUBLE)), 4) AS sy2 FROM faces"))
def prj33(s, d):
    b = scaled(F.array("x1", "y1", "x2", "y2"))
    return faces(s, d).withColumn("b", b).select("image_id", "id", c("b")[0].alias("sx1"), c("b")[3].alias("sy2"))


@query("prj36_latest_ok", "SELECT user_id, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def prj36(s, d):
    return tables.latest(read(s, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "value", "ts"), ["user_id"], c("ts")).select("user_id", "event_id", "value")


@query("prj38_semantic_errors", with_(FACES, "SELECT image_id, id, concat_ws(';', CASE WHEN smile <> 'yes' AND intensity > 2 THEN 'intensity without smile' END, CASE WHEN legibility = 0 AND smile = 'yes' THEN 'smile on illegible face' END) AS errors FROM faces WHERE (smile <> 'yes' AND intensity > 2) OR (legibility = 0 AND smile = 'yes')"))
def prj38(s, d):
    found = F.filter(F.array(F.when((c("smile") != "yes") & (c("intensity") > 2), "intensity without smile"), F.when((c("legibility") == 0) & (c("smile") == "yes"), "smile on illegible face")), lambda x: x.isNotNull())
    return faces(s, d).withColumn("e", found).where(F.size("e") > 0).select("image_id", "id", F.array_join("e", ";").alias("errors"))


@query("joi01_composite_join", "SELECT a.l_orderkey, a.l_partkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity AND a.l_tax = b.l_tax GROUP BY ALL")
def joi01(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", (c("l_tax") + F.lit(0.0)).alias("l_tax"))
    sizes = rows.groupBy(*rows.columns).count()  # equal keys meet as counts, not as pairs
    return sizes.groupBy("l_orderkey", "l_partkey").agg(F.sum(c("count") * c("count")).alias("n"))


@query("joi02_left_default", "SELECT c_custkey, coalesce(n, 0) AS orders, CASE WHEN n IS NULL THEN 'none' ELSE 'some' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def joi02(s, d):
    n = read(s, d, "orders").where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.when(c("n").isNull(), "none").otherwise("some").alias("status"))


@query("joi04_reconcile", "SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n, a.n IS NOT DISTINCT FROM b.n AS agree FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def joi04(s, d):
    a, b = (read(s, d, "orders").where(c("o_orderstatus") == x).groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("n")) for x in "FO")
    return checks.reconcile(a, b, ["k"], ["n"])


@query("joi05_checked_join", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def joi05(s, d):
    right = read(s, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_mktsegment")
    return checks.checked_join(read(s, d, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("joi06_semi_join", "SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS kept, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS dropped FROM orders")
def joi06(s, d):
    o, k = read(s, d, "orders").select("o_custkey"), read(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    return o.join(k, "o_custkey", "left").agg(F.count("hit").alias("kept"), F.count_if(c("hit").isNull()).alias("dropped"))


@query("joi07_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def joi07(s, d):
    big = read(s, d, "orders").where("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return read(s, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("joi08_lookup_children", "SELECT o_orderkey, count(l_orderkey) AS children, coalesce(bool_and(p_size IS NOT NULL) FILTER (l_orderkey IS NOT NULL), true) AS complete, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS size FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1")
def joi08(s, d):
    kids = read(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("p_partkey"), c("l_linenumber").alias("position"))
    found = read(s, d, "part").where("p_size > 5").select("p_partkey", "p_size")
    out = tables.lookup_children(read(s, d, "orders").select("o_orderkey"), kids, found, ["o_orderkey"], ["p_partkey"], ["p_size"])
    return out.select("o_orderkey", F.coalesce(F.size("children"), F.lit(0)).cast("bigint").alias("children"), "complete", F.coalesce(F.aggregate("children", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["p_size"], F.lit(0))), F.lit(0)).alias("size"))


@query("joi09_override", "SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN flag ELSE o_orderstatus END AS status, n IS NOT NULL AS replaced FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CASE WHEN max(l_quantity) > 45 THEN max(l_returnflag) END AS flag FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON o_orderkey = l_orderkey")
def joi09(s, d):
    side = read(s, d, "lineitem").where("l_linenumber = 1").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_quantity") > 45, F.max("l_returnflag")).alias("status"))
    return tables.override(read(s, d, "orders").select("o_orderkey", c("o_orderstatus").alias("status")), side, ["o_orderkey"], ["status"])


@query("joi10_conditional_override", "SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL AND o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status, l_orderkey IS NOT NULL AND o_orderstatus = 'P' AS replaced FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_tax > 0.06) ON o_orderkey = l_orderkey")
def joi10(s, d):
    side = read(s, d, "lineitem").where("l_tax > 0.06").select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("status", F.lit("X"))
    return tables.override(read(s, d, "orders").select("o_orderkey", c("o_orderstatus").alias("status")), side, ["o_orderkey"], ["status"], c("status") == "P")


@query("joi16_page_of_span", "SELECT o_custkey, str_split(span, ',')[CAST(floor(greatest(0.0, least(0.999999, x)) * len(str_split(span, ','))) AS INTEGER) + 1] AS page FROM (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS span, CAST(o_custkey % 100 AS DOUBLE) / 90 AS x FROM orders GROUP BY 1)")
def joi16(s, d):
    span = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    rows = read(s, d, "orders").groupBy("o_custkey").agg(span.alias("span"))
    return rows.select("o_custkey", V.page_of_span(c("span"), (c("o_custkey") % 100).cast("double") / 90).alias("page"))


@query("joi18_stem_alignment", "SELECT page_id, lower(regexp_replace(regexp_extract(url, '[^/\\\\]+$'), '\\.[^.]+$', '')) AS stem FROM pages")
def joi18(s, d):
    return read(s, d, "pages").select("page_id", V.stem(c("url")).alias("stem"))


@query("joi20_pair_key", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, sha1(least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) || '|' || greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS pair FROM lineitem")
def joi20(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", V.pair_key(c("l_partkey").cast("string"), c("l_suppkey").cast("string")).alias("pair"))


@query("agg01_key_sizes", "SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated_groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows, max(n) AS largest FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def agg01(s, d):
    return tables.key_sizes(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg03_named_aggregates", "SELECT l_suppkey, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_partkey) AS parts, CAST(sum(l_quantity) AS DOUBLE) AS total, median(l_quantity) AS middle, min_by(l_partkey, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) AS first_part FROM lineitem GROUP BY 1")
def agg03(s, d):
    return read(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_distinct("l_partkey").alias("parts"), F.sum("l_quantity").alias("total"), F.median("l_quantity").alias("middle"), F.min_by("l_partkey", c("l_orderkey") * 1000000 + c("l_partkey") * 10 + c("l_linenumber")).alias("first_part"))


@query("agg04_conditional_share", with_(FACES, "SELECT gender, count(*) FILTER (confidence < 0.95) AS below, round(avg(CASE WHEN confidence < 0.95 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM faces GROUP BY 1"))
def agg04(s, d):
    return faces(s, d).groupBy("gender").agg(F.count_if(c("confidence") < 0.95).alias("below"), F.round(F.avg((c("confidence") < 0.95).cast("double")), 6).alias("share"))


@query("agg06_distinct_pages", with_(PAGES, "SELECT year, count(DISTINCT issue) AS issues, count(DISTINCT issue * 100 + image_id % 7) AS pages FROM pages_ GROUP BY 1"))
def agg06(s, d):
    return pages(s, d).groupBy("year").agg(F.count_distinct("issue").alias("issues"), F.count_distinct(c("issue") * 100 + c("image_id") % 7).alias("pages"))


@query("agg08_histogram_of_histogram", "SELECT n AS size, count(*) AS groups, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def agg08(s, d):
    sizes = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    return tables.share_within(sizes.withColumn("_", F.lit(1)), ["_"], "groups").select("size", "groups", F.round("share", 6).alias("share"))


@query("agg09_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def agg09(s, d):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", *[F.round(c("p")[i], 6).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query("agg10_nearest_rank", "SELECT l_suppkey, list_sort(list(l_extendedprice))[CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INTEGER) + 1] AS p95 FROM lineitem GROUP BY 1")
def agg10(s, d):
    return tables.at_ranks(read(s, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p95": lambda n: F.bround((n - 1) * F.lit(0.95), 0)})


@query("agg11_truncated_rank", "SELECT l_suppkey, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.975::DOUBLE) AS INTEGER) + 1] AS p975 FROM lineitem GROUP BY 1")
def agg11(s, d):
    return tables.at_ranks(read(s, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p975": lambda n: F.floor((n - 1) * F.lit(0.975))})


@query("agg12_upper_median", "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS middle FROM lineitem GROUP BY 1")
def agg12(s, d):
    return tables.at_ranks(read(s, d, "lineitem"), ["l_suppkey"], "l_quantity", {"middle": lambda n: F.floor(n / 2)})


@query("agg13_crosstab", with_(FACES, "SELECT gender, round(count(*) FILTER (smile = 'yes') / count(*)::DOUBLE, 6) AS yes, round(count(*) FILTER (smile = 'no') / count(*)::DOUBLE, 6) AS no, round(count(*) FILTER (smile = 'not_assessable') / count(*)::DOUBLE, 6) AS not_assessable FROM faces GROUP BY 1"))
def agg13(s, d):
    labels = ["yes", "no", "not_assessable"]
    return tables.crosstab(faces(s, d), "gender", "smile", labels, "row").select("gender", *[F.round(x, 6).alias(x) for x in labels])


@query("agg14_grid", with_(FACES, "SELECT i AS intensity, g AS gender, count(id) AS n FROM (SELECT unnest(range(1, 8))::INTEGER AS i) CROSS JOIN (SELECT unnest(['feminine', 'masculine', 'unknown']) AS g) LEFT JOIN faces ON intensity = i AND gender = g GROUP BY ALL"))
def agg14(s, d):
    counts = faces(s, d).groupBy("intensity", "gender").agg(F.count("*").alias("n"))
    return tables.grid(counts, {"intensity": list(range(1, 8)), "gender": ["feminine", "masculine", "unknown"]})


@query("agg17_unpivot", "SELECT l_returnflag, name, round(value, 4) AS value FROM (SELECT l_returnflag, avg(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem GROUP BY 1) UNPIVOT (value FOR name IN (quantity, tax))")
def agg17(s, d):
    wide = read(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    return wide.unpivot("l_returnflag", ["quantity", "tax"], "name", "value").withColumn("value", F.round("value", 4))


@query("agg18_totals_row", with_(PAGES, "SELECT coalesce(CAST(year AS VARCHAR), 'Total') AS year, count(*) AS pages, count(DISTINCT issue) AS issues FROM pages_ GROUP BY ROLLUP (pages_.year)"))
def agg18(s, d):
    return tables.with_total(pages(s, d), "year", [F.count("*").alias("pages"), F.count_distinct("issue").alias("issues")])


@query("agg29_context_label", with_(FACES, "SELECT image_id, ad, CASE WHEN n = 1 THEN 'solo' WHEN f = n THEN 'feminine only' WHEN f = 0 THEN 'masculine only' ELSE 'mixed' END AS context FROM (SELECT image_id, ad, count(*) AS n, count(*) FILTER (gender = 'feminine') AS f FROM faces GROUP BY ALL)"))
def agg29(s, d):
    n = faces(s, d).groupBy("image_id", "ad").agg(F.count("*").alias("n"), F.count_if(c("gender") == "feminine").alias("f"))
    return n.select("image_id", "ad", V.chosen([(c("n") == 1, "solo"), (c("f") == c("n"), "feminine only"), (c("f") == 0, "masculine only")], "mixed").alias("context"))


@query("agg30_three_valued", with_(FACES, "SELECT image_id, yes, assessed, total, CAST(CASE WHEN yes > 0 THEN 1 WHEN assessed = total THEN 0 END AS INTEGER) AS any_yes, CAST(CASE WHEN yes < assessed THEN 0 WHEN assessed = total AND yes = total THEN 1 END AS INTEGER) AS all_yes FROM (SELECT image_id, count(*) FILTER (smile = 'yes') AS yes, count(*) FILTER (smile IN ('yes', 'no')) AS assessed, count(*) AS total FROM faces GROUP BY 1)"))
def agg30(s, d):
    return tables.three_valued(faces(s, d), ["image_id"], "smile")


@query("agg31_mode", with_(FACES, "SELECT image_id, smile AS mode, n FROM (SELECT image_id, smile, count(*) AS n FROM faces GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, smile) = 1"))
def agg31(s, d):
    return tables.mode(faces(s, d), ["image_id"], "smile")


@query("agg32_reduced_label", with_(FACES, "SELECT image_id, CASE WHEN seen < total * 0.5 THEN 'not_assessable' WHEN top = seen THEN 'all_' || v WHEN top > seen * 0.5 THEN 'mostly_' || v ELSE 'mixed' END AS label, CAST(total AS BIGINT) AS total, CAST(seen AS BIGINT) AS seen FROM (SELECT image_id, sum(n) AS total, coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS seen, max(n) FILTER (v IS NOT NULL) AS top, arg_max(v, n * 10 + CASE WHEN v = 'yes' THEN 1 ELSE 0 END) FILTER (v IS NOT NULL) AS v FROM (SELECT image_id, nullif(smile, 'not_assessable') AS v, count(*) AS n FROM faces GROUP BY ALL) GROUP BY 1)"))
def agg32(s, d):
    return tables.reduced_label(faces(s, d).withColumn("smile", F.nullif("smile", F.lit("not_assessable"))), ["image_id"], "smile")


@query("agg36_prefix_balance", with_(PAGES, "o AS (SELECT *, row_number() OVER (ORDER BY image_id) AS pos FROM pages_)", "t AS (SELECT year, count(*) / (SELECT count(*) FROM o)::DOUBLE AS q FROM o GROUP BY 1)", "x AS (SELECT prefix, year, q FROM (SELECT unnest([30, 60, 90, 120])::INTEGER AS prefix) CROSS JOIN t)", "SELECT prefix, round(sum(abs((SELECT count(*) FROM o WHERE o.year = x.year AND pos <= prefix) / prefix::DOUBLE - q)) / 2, 6) AS distance FROM x GROUP BY 1"))
def agg36(s, d):
    rows = pages(s, d).select("image_id", "year")
    place = tables.numbered(rows, ["image_id"]).withColumn("pos", c("position") + 1)
    n = rows.count()
    goal = rows.groupBy("year").agg((F.count("*") / F.lit(float(n))).alias("q"))
    prefixes = F.array(*map(F.lit, (30, 60, 90, 120)))
    seen = place.where("pos <= 120").select("year", "pos", F.explode(prefixes).alias("prefix")).where("pos <= prefix").groupBy("prefix", "year").agg(F.count("*").alias("k"))
    full = goal.select("year", "q", F.explode(prefixes).alias("prefix")).join(seen, ["prefix", "year"], "left")
    return full.groupBy("prefix").agg(F.round(F.sum(F.abs(F.coalesce("k", F.lit(0)) / c("prefix") - c("q"))) / 2, 6).alias("distance"))


@query("agg37_overlapping_rollups", "WITH k AS (SELECT l_orderkey, l_partkey % 50 AS page, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT label, count(DISTINCT l_orderkey * 100 + page) AS pages FROM (SELECT *, unnest(CASE WHEN n = 1 THEN ['1', '1+2'] WHEN n = 2 THEN ['2', '1+2'] ELSE ['3+'] END) AS label FROM k) GROUP BY 1")
def agg37(s, d):
    rows = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(c("l_partkey") % 50).alias("p"), F.count("*").alias("n"))
    labels = F.when(c("n") == 1, F.array(F.lit("1"), F.lit("1+2"))).when(c("n") == 2, F.array(F.lit("2"), F.lit("1+2"))).otherwise(F.array(F.lit("3+")))
    return rows.select(F.size("p").alias("k"), F.explode(labels).alias("label")).groupBy("label").agg(F.sum("k").alias("pages"))


@query("win02_group_transform", with_(FACES, "SELECT image_id, id, confidence = max(confidence) OVER (PARTITION BY image_id) AS is_top, count(*) OVER (PARTITION BY image_id) AS n FROM faces"))
def win02(s, d):
    w = Window.partitionBy("image_id")
    return faces(s, d).select("image_id", "id", (c("confidence") == F.max("confidence").over(w)).alias("is_top"), F.count("*").over(w).alias("n"))


@query("win03_cumcount", with_(FACES, "SELECT image_id, id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY id) AS INTEGER) AS k FROM faces"))
def win03(s, d):
    return faces(s, d).select("image_id", "id", F.row_number().over(Window.partitionBy("image_id").orderBy("id")).alias("k"))


@query("win05_variable_quota", with_(PAGES, "SELECT year, image_id, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY sha256('7:' || CAST(image_id AS VARCHAR)), image_id) AS k FROM pages_) WHERE k <= year - 1994"))
def win05(s, d):
    return first_by_hash(pages(s, d), ["year"], "image_id", c("year") - 1994, 7).select("year", "image_id", "place")


@query("win06_centred_rolling", with_(PAGES, "SELECT CAST(y AS INTEGER) AS year, n, CASE WHEN count(n) OVER w = 5 THEN CAST(sum(n) OVER w AS BIGINT) END AS rolling FROM (SELECT unnest(range(1990, 2006)) AS y) LEFT JOIN (SELECT year, count(*) AS n FROM pages_ GROUP BY 1) ON year = y WINDOW w AS (ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def win06(s, d):
    return tables.centred_sum(pages(s, d).groupBy("year").agg(F.count("*").alias("n")), "year", "n", 1990, 2005)


@query("win07_duplicate_flag", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents")
def win07(s, d):
    rows = read(s, d, "documents").select("doc_id", F.md5("text").alias("k"))
    return rows.join(rows.groupBy("k").count(), "k").select("doc_id", (c("count") > 1).alias("repeated"))


@query("win08_first_appearance_ids", "SELECT source, lang, CAST(row_number() OVER (ORDER BY m) AS INTEGER) AS group_id FROM (SELECT source, lang, min(doc_id) AS m FROM documents GROUP BY ALL)")
def win08(s, d):
    first = read(s, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("m"))
    return first.select("source", "lang", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("m")).alias("group_id"))


@query("srt01_mixed_sort_rank", with_(PAGES, "SELECT year, image_id, CAST(row_number() OVER (PARTITION BY year ORDER BY medium DESC, issue, image_id) AS INTEGER) AS place FROM pages_"))
def srt01(s, d):
    return pages(s, d).select("year", "image_id", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("medium"), "issue", "image_id")).alias("place"))


@query("srt02_global_top_k", with_(FACES, "SELECT image_id, id, confidence FROM faces ORDER BY confidence DESC, image_id, id LIMIT 100"))
def srt02(s, d):
    return faces(s, d).select("image_id", "id", "confidence").orderBy(F.desc("confidence"), "image_id", "id").limit(100)


@query("srt03_extremes", with_(PAGES, "k AS (SELECT year, issue, count(*) AS n FROM pages_ GROUP BY ALL)", "SELECT year, issue, n, mode, CAST(place AS INTEGER) AS place FROM (SELECT *, 'most' AS mode, row_number() OVER (PARTITION BY year ORDER BY n DESC, sha256('11:' || CAST(issue AS VARCHAR))) AS place FROM k UNION ALL SELECT *, 'least', row_number() OVER (PARTITION BY year ORDER BY n, sha256('11:' || CAST(issue AS VARCHAR))) FROM k) WHERE place <= 3"))
def srt03(s, d):
    return tables.extremes(pages(s, d).groupBy("year", "issue").agg(F.count("*").alias("n")), ["year"], "n", "issue", 3, 11)


@query("srt07_most_common", with_(FACES, "SELECT gender, smile, n FROM (SELECT gender, smile, count(*) AS n FROM faces GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gender ORDER BY n DESC, smile) <= 2"))
def srt07(s, d):
    n = faces(s, d).groupBy("gender", "smile").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("gender").orderBy(F.desc("n"), "smile"))).where("k <= 2").drop("k")


@query("set01_union_all", "SELECT 'c' AS side, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
def set01(s, d):
    a = read(s, d, "customer").select(F.lit("c").alias("side"), c("c_nationkey").alias("nation"))
    return a.unionByName(read(s, d, "supplier").select(F.lit("s").alias("side"), c("s_nationkey").alias("nation")))


@query("set02_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def set02(s, d):
    return read(s, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("set03_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set03(s, d):
    return read(s, d, "customer").select(c("c_nationkey").alias("nation")).intersect(read(s, d, "supplier").select(c("s_nationkey").alias("nation")))


@query("set04_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set04(s, d):
    return read(s, d, "customer").select("c_custkey").exceptAll(read(s, d, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey")).distinct())


@query("set06_accounting", with_(PAGES, "SELECT (SELECT count(*) FROM pages_) AS source, count(*) FILTER (year >= 1997) AS kept, count(*) FILTER (NOT year >= 1997) AS dropped, count(*) FILTER (year >= 1997) + count(*) FILTER (NOT year >= 1997) = count(*) AS balanced FROM pages_"))
def set06(s, d):
    keep = c("year") >= 1997
    return pages(s, d).agg(F.count("*").alias("source"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")).withColumn("balanced", c("kept") + c("dropped") == c("source"))
