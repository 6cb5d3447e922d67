"""Composite report queries: RPT."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.functions import boxes
from annolith.functions.boxes import box
from annolith.operators import ledger as L
from annolith.operators import bootstrap, metrics, reports, sampling, tables
from annolith.operators.store import stored

from .ledgers import DRAWS, LEDGER, REPS, issues, ledger
from .registry import query
from .scores import six
from .spatial import best_ctes, greedy_sql, recursive
from .standins import FACES, PAGES, PAIRS, faces, pages, read, with_

c = F.col
FP = "fp AS (SELECT f.*, p.issue, p.year, p.medium FROM faces f JOIN pages_ p USING (image_id))"


def yes():
    return F.col("smile") == "yes"


def known():
    return F.col("smile").isin("yes", "no")


def faces_in_pages(s, d):
    return faces(s, d).join(pages(s, d), "image_id")


@query("rpt01_coverage", with_(FACES, PAGES, "SELECT coalesce(CAST(p.year AS VARCHAR), 'Total') AS year, count(DISTINCT p.image_id) AS pages, count(DISTINCT issue) AS issues, count(f.id) AS faces FROM pages_ p LEFT JOIN faces f USING (image_id) GROUP BY ROLLUP (p.year)"))
def rpt01(s, d):
    per_page = faces(s, d).groupBy("image_id").agg(F.count("*").alias("k"))
    p = pages(s, d).join(per_page, "image_id", "left")
    return tables.with_total(p, "year", [F.count("image_id").alias("pages"), F.count_distinct("issue").alias("issues"), F.coalesce(F.sum("k"), F.lit(0)).alias("faces")])


@query("rpt02_annual_share", with_(FACES, PAGES, FP, "k AS (SELECT year, count(*) FILTER (smile = 'yes') AS num, count(*) FILTER (smile IN ('yes', 'no')) AS den FROM fp GROUP BY 1)", "SELECT CAST(y AS INTEGER) AS year, round(CASE WHEN count(num) OVER w = 5 THEN sum(num) OVER w / CAST(sum(den) OVER w AS DOUBLE) END, 6) AS pooled FROM (SELECT unnest(range(1993, 2004)) AS y) LEFT JOIN k ON year = y WINDOW w AS (ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def rpt02(s, d):
    return six(reports.pooled_years(faces_in_pages(s, d), "year", yes(), known(), 1993, 2003), "pooled")


@query("rpt02_share_interval", with_(FACES, PAGES, FP, DRAWS, "sm AS (SELECT year, issue, CAST(count(*) FILTER (smile = 'yes') AS DOUBLE) AS num, CAST(count(*) FILTER (smile IN ('yes', 'no')) AS DOUBLE) AS den FROM fp GROUP BY ALL)", "se AS (SELECT sm.year, replicate, sum(weight * num) / nullif(sum(weight * den), 0) AS value FROM sm JOIN wt ON wt.year = sm.year AND wt.issue = sm.issue GROUP BY ALL)", "pt AS (SELECT year, sum(num) / sum(den) AS share, count(*) FILTER (den > 0) AS clusters FROM sm GROUP BY 1)", "SELECT year, round(any_value(share), 6) AS share, any_value(clusters) AS clusters, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM se JOIN pt USING (year) GROUP BY year"))
def rpt02b(s, d):
    rows = faces_in_pages(s, d)
    sums = rows.groupBy("year", "issue").agg(F.count_if(yes()).cast("double").alias("num"), F.count_if(known()).cast("double").alias("den"))
    point = sums.groupBy("year").agg((F.sum("num") / F.sum("den")).alias("share"), F.count_if(c("den") > 0).alias("clusters"))
    spread = sampling.interval(bootstrap.ratio_series(issues(s, d), sums, "issue", "year", ["year"], REPS), ["year"])
    return six(point.join(spread, "year").select("year", "share", "clusters", "low", "high"), "share", "low", "high")


@query("rpt03_medium_share", with_(FACES, PAGES, FP, "SELECT medium, count(*) FILTER (smile IN ('yes', 'no')) AS n, count(*) FILTER (smile = 'yes') AS yes, round(count(*) FILTER (smile = 'yes') / count(*) FILTER (smile IN ('yes', 'no'))::DOUBLE, 6) AS share FROM fp GROUP BY 1"))
def rpt03(s, d):
    return six(reports.shares(faces_in_pages(s, d), ["medium"], yes(), known()), "share")


GAP = "SELECT {BY}, nf AS n_feminine, yf AS y_feminine, nm AS n_masculine, ym AS y_masculine, round(CASE WHEN nf >= 30 AND nm >= 30 THEN yf / nf::DOUBLE - ym / nm::DOUBLE END, 6) AS gap FROM (SELECT {BY}, count(*) FILTER (smile <> 'not_assessable' AND gender = 'feminine') AS nf, count(*) FILTER (smile = 'yes' AND gender = 'feminine') AS yf, count(*) FILTER (smile <> 'not_assessable' AND gender = 'masculine') AS nm, count(*) FILTER (smile = 'yes' AND gender = 'masculine') AS ym FROM fp GROUP BY ALL)"


@query("rpt04_gap_by_period", with_(FACES, PAGES, FP, GAP.replace("{BY}", "year")))
def rpt04(s, d):
    return six(reports.gap(faces_in_pages(s, d), ["year"], "gender", "feminine", "masculine", yes(), known()), "gap")


@query("rpt05_gap_by_level", with_(FACES, PAGES, FP, GAP.replace("{BY}", "year, legibility, medium")))
def rpt05(s, d):
    return six(reports.gap(faces_in_pages(s, d), ["year", "legibility", "medium"], "gender", "feminine", "masculine", yes(), known()), "gap")


@query("rpt06_intensity_distribution", with_(FACES, "SELECT gender, intensity, n, round(n / CAST(sum(n) OVER (PARTITION BY gender) AS DOUBLE), 6) AS share FROM (SELECT gender, intensity, count(*) AS n FROM faces WHERE smile = 'yes' GROUP BY ALL)"))
def rpt06(s, d):
    k = faces(s, d).where(yes()).groupBy("gender", "intensity").agg(F.count("*").alias("n"))
    return six(tables.share_within(k, ["gender"], "n"), "share")


@query("rpt07_industry_table", "SELECT p_brand, count(*) AS ads, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS place FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def rpt07(s, d):
    k = read(s, d, "lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("k")).join(read(s, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sum("k").alias("ads"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ads"), "p_brand"))).where("place <= 6")


@query("rpt08_dyads", with_(FACES, "k AS (SELECT image_id, ad, max(smile) FILTER (gender = 'feminine') AS va, max(smile) FILTER (gender = 'masculine') AS vb FROM faces GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (gender = 'feminine') = 1)", "SELECT va, vb, count(*) AS n FROM k GROUP BY ALL"))
def rpt08(s, d):
    return reports.dyads(faces(s, d), ["image_id", "ad"], "gender", "feminine", "masculine", "smile").groupBy("va", "vb").agg(F.count("*").alias("n"))


@query("rpt09_concentration", with_(FACES, "k AS (SELECT count(*) FILTER (smile <> 'not_assessable') AS n, count(*) FILTER (smile = 'yes') AS y FROM faces GROUP BY image_id, ad HAVING count(*) FILTER (smile <> 'not_assessable') >= 2)", "p AS (SELECT sum(y) / CAST(sum(n) AS DOUBLE) AS p FROM k)", "SELECT count(*) AS ads, count(*) FILTER (y = n) AS all_seen, round(sum(pow(p, n)), 4) AS all_expected, count(*) FILTER (y > 0) AS any_seen, round(sum(1 - pow(1 - p, n)), 4) AS any_expected FROM k CROSS JOIN p"))
def rpt09(s, d):
    return reports.concentration(faces(s, d), ["image_id", "ad"], yes(), known()).withColumns({k: F.round(k, 4) for k in ("all_expected", "any_expected")})


@query("rpt10_prominence", with_(FACES, "a AS (SELECT *, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS area, count(*) OVER (PARTITION BY image_id, ad) AS n FROM faces)", "t AS (SELECT *, area = max(area) OVER (PARTITION BY image_id, ad) AS top FROM a)", "u AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY image_id, ad) AS tops FROM t)", "SELECT round(sum(CASE WHEN top AND gender = 'feminine' THEN 1.0::DOUBLE / tops ELSE 0 END), 4) AS credit, round(sum(CASE WHEN gender = 'feminine' THEN 1.0::DOUBLE / n ELSE 0 END), 4) AS expected FROM u"))
def rpt10(s, d):
    return reports.prominence(faces(s, d).withColumn("area", boxes.area(box())), ["image_id", "ad"], "area", "gender", "feminine").select(F.round("credit", 4).alias("credit"), F.round("expected", 4).alias("expected"))


@query("rpt11_contrasts", with_(FACES, PAGES, FP, "k AS (SELECT year, count(*) FILTER (smile = 'yes') / count(*) FILTER (smile <> 'not_assessable')::DOUBLE AS s FROM fp GROUP BY 1)", "SELECT round((SELECT s FROM k WHERE year = 2000) / (SELECT s FROM k WHERE year = 1995), 6) AS ratio, round((SELECT s FROM k WHERE year = 2000) - (SELECT s FROM k WHERE year = 1995), 6) AS change"))
def rpt11(s, d):
    k = reports.shares(faces_in_pages(s, d), [], yes() & (c("year") == 2000), known() & (c("year") == 2000)).select(c("share").alias("b"))
    a = reports.shares(faces_in_pages(s, d), [], yes() & (c("year") == 1995), known() & (c("year") == 1995)).select(c("share").alias("a"))
    return k.join(a).select(F.round(c("b") / c("a"), 6).alias("ratio"), F.round(c("b") - c("a"), 6).alias("change"))


@query("rpt12_focal_faces", with_(FACES, "f AS (SELECT * FROM (SELECT *, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS area FROM faces) QUALIFY area = max(area) OVER (PARTITION BY image_id, ad) AND count(*) OVER (PARTITION BY image_id, ad, area) = 1)", "SELECT gender, count(*) AS n, round(avg(legibility), 6) AS mean_level FROM f GROUP BY 1"))
def rpt12(s, d):
    f = faces(s, d).withColumn("area", boxes.area(box()))
    top = f.groupBy("image_id", "ad").agg(F.max(F.struct("area", "gender", "legibility")).alias("m"), F.max("area").alias("area"))
    once = f.groupBy("image_id", "ad", "area").count().where("count = 1")
    return top.join(once, ["image_id", "ad", "area"]).groupBy("m.gender").agg(F.count("*").alias("n"), F.round(F.avg("m.legibility"), 6).alias("mean_level"))


@query("rpt13_subsets", with_(FACES, "l AS (SELECT unnest(CASE WHEN intensity >= 3 THEN ['all', 'broad'] ELSE ['all'] END) AS subset, smile FROM faces)", "SELECT subset, count(*) FILTER (smile <> 'not_assessable') AS n, count(*) FILTER (smile = 'yes') AS yes, round(count(*) FILTER (smile = 'yes') / count(*) FILTER (smile <> 'not_assessable')::DOUBLE, 6) AS share FROM l GROUP BY 1"))
def rpt13(s, d):
    labels = F.when(c("intensity") >= 3, F.array(F.lit("all"), F.lit("broad"))).otherwise(F.array(F.lit("all")))
    return six(reports.shares(faces(s, d).withColumn("subset", F.explode(labels)), ["subset"], yes(), known()), "share")


@query("rpt14_dedup_quality", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) = 1 AS kept FROM documents) SELECT source, count(*) AS n, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, round(count(*) FILTER (NOT kept) / count(*)::DOUBLE, 6) AS drop_rate FROM k GROUP BY 1")
def rpt14(s, d):
    docs = read(s, d, "documents").select("doc_id", "source", F.md5("text").alias("k"), F.length("text").alias("len"))
    first = docs.groupBy("k", "len").agg(F.min("doc_id").alias("first"))
    j = docs.join(first, ["k", "len"]).withColumn("kept", c("doc_id") == c("first"))
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(~c("kept")).alias("dropped"), F.round(F.count_if(~c("kept")) / F.count("*"), 6).alias("drop_rate"))


@query("rpt15_incidence", with_(FACES, PAGES, FP, "i AS (SELECT year, issue, count(DISTINCT fp.image_id) FILTER (smile = 'yes') AS hits FROM pages_ LEFT JOIN fp USING (year, issue) GROUP BY ALL)", "SELECT year, count(*) AS issues, count(*) FILTER (hits > 0) AS with_smile, round(count(*) FILTER (hits > 0) / count(*)::DOUBLE, 6) AS share FROM i GROUP BY 1"))
def rpt15(s, d):
    smiling = faces(s, d).where(yes()).select("image_id").distinct().withColumn("hit", F.lit(1))
    i = pages(s, d).join(smiling, "image_id", "left").groupBy("year", "issue").agg(F.count("hit").alias("hits"))
    return i.groupBy("year").agg(F.count("*").alias("issues"), F.count_if(c("hits") > 0).alias("with_smile"), F.round(F.count_if(c("hits") > 0) / F.count("*"), 6).alias("share"))


@query("rpt16_attribute_profile", with_(FACES, "SELECT smile, round(count(*) FILTER (coder = 'h') / CAST(sum(count(*) FILTER (coder = 'h')) OVER () AS DOUBLE), 6) AS h, round(count(*) FILTER (coder = 'p') / CAST(sum(count(*) FILTER (coder = 'p')) OVER () AS DOUBLE), 6) AS p FROM faces GROUP BY 1"))
def rpt16(s, d):
    return six(tables.crosstab(faces(s, d), "smile", "coder", ["h", "p"], "column"), "h", "p")


@query("rpt17_period_summary", with_(FACES, PAGES, FP, "SELECT CAST(year - year % 2 AS INTEGER) AS period, count(DISTINCT issue) AS issues, count(DISTINCT image_id) AS pages, count(*) AS faces FROM fp GROUP BY 1"))
def rpt17(s, d):
    return faces_in_pages(s, d).groupBy((c("year") - c("year") % 2).cast("int").alias("period")).agg(F.count_distinct("issue").alias("issues"), F.count_distinct("image_id").alias("pages"), F.count("*").alias("faces"))


@query(
    "rpt18_frozen_evaluation",
    recursive(
        FACES, PAIRS, best_ctes("o", 0.2), best_ctes("t", 0.5),
        greedy_sql("iou", "iou >= 0.2").split(PAIRS, 1)[1].lstrip(", ").rsplit("\nSELECT", 1)[0],
        """al AS (SELECT 'greedy_strict' AS mode, image_id, count(*) AS k, sum(m.iou) AS total FROM k GROUP BY ALL UNION ALL SELECT 'optimal_strict', image_id, k, total FROM o_best UNION ALL SELECT 'optimal_iou_0.5', image_id, k, total FROM t_best),
        su AS (SELECT mode, CASE WHEN image_id % 2 = 0 THEN 'development' ELSE 'reserve' END AS cohort, CAST(sum(k) AS BIGINT) AS matched, sum(total) / sum(k) AS mean_iou FROM al GROUP BY ALL),
        sz AS (SELECT CASE WHEN image_id % 2 = 0 THEN 'development' ELSE 'reserve' END AS cohort, count(*) FILTER (coder = 'h') AS human, count(*) FILTER (coder = 'p') AS predicted FROM faces GROUP BY 1)""",
        "SELECT cohort, mode, matched, round(mean_iou, 6) AS mean_iou, human, predicted, round(matched / predicted::DOUBLE, 6) AS precision, round(matched / human::DOUBLE, 6) AS recall, round(2 * matched / (human + predicted)::DOUBLE, 6) AS f1 FROM su JOIN sz USING (cohort)",
    ),
)
def rpt18(s, d):
    from .spatial import PAGE, accepted
    from annolith.operators import matching

    split = F.when(c("image_id") % 2 == 0, "development").otherwise("reserve").alias("cohort")
    totals = faces(s, d).groupBy(split).agg(F.count_if(c("coder") == "h").alias("human"), F.count_if(c("coder") == "p").alias("predicted"))
    found = stored(accepted(s, d), "candidates")  # those of every mode
    modes = {"greedy_strict": matching.greedy(found, PAGE, c("iou")), "optimal_strict": matching.optimal(found, PAGE), "optimal_iou_0.5": matching.optimal(found.where("iou >= 0.5"), PAGE)}
    out = None
    for mode, pairs in modes.items():
        own = pairs.groupBy(split).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou")).withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    return six(metrics.detection(out.join(totals, "cohort"), False), "mean_iou", "precision", "recall", "f1")


@query("rpt19_run_monitor", with_(LEDGER, "SELECT stage, count(*) AS attempts, count(DISTINCT task) FILTER (ok) AS done, round(count(*) / (epoch(max(ts) - min(ts)) / 60), 4) AS per_minute, max(ts) AS last FROM led GROUP BY 1"))
def rpt19(s, d):
    minutes = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 6e7
    return ledger(s, d).groupBy("stage").agg(F.count("*").alias("attempts"), F.count_distinct(F.when(c("ok"), c("task"))).alias("done"), F.round(F.count("*") / minutes, 4).alias("per_minute"), F.max("ts").alias("last"))


@query("rpt20_complete_cases", "WITH bad AS (SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = k WHERE k IS NULL) SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM bad)) AS pages, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM bad)) AS faces, (SELECT count(*) FROM bad) AS removed")
def rpt20(s, d):
    o, l = read(s, d, "orders").select(c("o_orderkey").alias("page")), read(s, d, "lineitem").select(c("l_orderkey").alias("page"), "l_returnflag")
    k = L.completeness(o.withColumn("task", c("page")), l.where("l_returnflag = 'R'").select(c("page").alias("task")), "page", "task")
    bad = k.where("not complete").select("page")
    a, b = reports.complete_cases([o, l.select("page")], "page", bad)
    return a.agg(F.count("*").alias("pages")).join(b.agg(F.count("*").alias("faces"))).join(bad.agg(F.count("*").alias("removed")))
