"""Queries over labels of matched pairs: MET."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.functions import values as V
from annolith.operators import matching, metrics

from .registry import query
from .spatial import PAGE, accepted, sides
from .standins import FACES, PAIRS, faces, read, with_

c = F.col
#: labelled pairs: two lines of an order, each against the next by id
LABELLED = "o AS (SELECT *, lead(smile) OVER w AS s2, lead(legibility) OVER w AS l2, lead(gender) OVER w AS g2 FROM faces WINDOW w AS (PARTITION BY image_id ORDER BY id)), lab AS (SELECT image_id, id, gender, nullif(smile, 'not_assessable') AS human, nullif(s2, 'not_assessable') AS other, legibility AS lh, l2 AS lo FROM o WHERE g2 IS NOT NULL)"
NAMES = V.ORDERS["legibility"]


def labelled(s, d):
    w = Window.partitionBy("image_id").orderBy("id")
    f = faces(s, d).withColumn("s2", F.lead("smile").over(w)).withColumn("l2", F.lead("legibility").over(w)).where("s2 is not null")
    none = F.lit("not_assessable")
    return f.select("image_id", "id", "gender", F.nullif("smile", none).alias("human"), F.nullif("s2", none).alias("other"), c("legibility").alias("lh"), c("l2").alias("lo"))


def six(df, *names):
    return df.select(*[F.round(x, 6).alias(x) if x in names else c(x) for x in df.columns])


COUNTS = "k AS (SELECT f.ad, count(*) FILTER (coder = 'h') AS human, count(*) FILTER (coder = 'p') AS predicted, least(count(*) FILTER (coder = 'h'), count(*) FILTER (coder = 'p')) AS matched FROM faces f GROUP BY ALL)"


@query("met01_detection", with_(FACES, COUNTS, "p AS (SELECT *, matched / nullif(predicted, 0)::DOUBLE AS p, matched / nullif(human, 0)::DOUBLE AS r FROM k)", "SELECT ad, human, predicted, matched, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0.0::DOUBLE END, 6) AS f1 FROM p"))
def met01(s, d):
    h, p = F.count_if(c("coder") == "h"), F.count_if(c("coder") == "p")
    k = faces(s, d).groupBy("ad").agg(h.alias("human"), p.alias("predicted"), F.least(h, p).alias("matched"))
    return six(metrics.detection(k), "precision", "recall", "f1")


@query("met02_f1_counts", with_(FACES, COUNTS, "SELECT ad, round(2 * matched / (human + predicted)::DOUBLE, 6) AS f1 FROM k"))
def met02(s, d):
    h, p = F.count_if(c("coder") == "h"), F.count_if(c("coder") == "p")
    return faces(s, d).groupBy("ad").agg(F.round(2 * F.least(h, p) / (h + p), 6).alias("f1"))


@query("met03_lenient_labels", with_(FACES, LABELLED, "SELECT count(*) AS n, count(*) FILTER (lh = lo) AS exact, count(*) FILTER (abs(lh - lo) <= 1) AS lenient FROM lab"))
def met03(s, d):
    a, b = (F.get(F.array(*map(F.lit, NAMES)), c(k)) for k in ("lh", "lo"))
    return labelled(s, d).agg(F.count("*").alias("n"), F.count_if(V.lenient(a, b)).alias("exact"), F.count_if(V.lenient(a, b, NAMES)).alias("lenient"))


LONG = "lg AS (SELECT 'smile' AS field, human, other FROM lab UNION ALL SELECT 'legibility', (['0_not_legible', '1_low_legibility', '2_moderate_legibility', '3_high_legibility'])[lh + 1], (['0_not_legible', '1_low_legibility', '2_moderate_legibility', '3_high_legibility'])[lo + 1] FROM lab)"


def long(s, d):
    names = F.array(*map(F.lit, NAMES))
    rows = F.array(F.struct(F.lit("smile").alias("field"), c("human").alias("human"), c("other").alias("other")), F.struct(F.lit("legibility").alias("field"), F.get(names, c("lh")).alias("human"), F.get(names, c("lo")).alias("other")))
    return labelled(s, d).select(F.inline(rows))


@query("met04_field_summary", with_(FACES, LABELLED, LONG, "SELECT field, assessed, exact, lenient, one_missing, round(exact / assessed::DOUBLE, 6) AS exact_accuracy, round(lenient / assessed::DOUBLE, 6) AS lenient_accuracy FROM (SELECT field, count(*) AS assessed, count(*) FILTER (human IS NOT DISTINCT FROM other) AS exact, count(*) FILTER (human IS NOT DISTINCT FROM other OR (field = 'legibility' AND abs(TRY_CAST(left(human, 1) AS INTEGER) - TRY_CAST(left(other, 1) AS INTEGER)) <= 1)) AS lenient, count(*) FILTER ((human IS NULL) <> (other IS NULL)) AS one_missing FROM lg WHERE human IS NOT NULL OR other IS NOT NULL GROUP BY 1)"))
def met04(s, d):
    return six(metrics.field_summary(long(s, d)), "exact_accuracy", "lenient_accuracy")


@query("met05_class_metrics", with_(FACES, LABELLED, LONG, "g AS (SELECT * FROM lg WHERE human IS NOT NULL)", "t AS (SELECT field, human AS label, count(*) AS support, count(*) FILTER (human = other) AS tp FROM g GROUP BY ALL)", "p AS (SELECT field, other AS label, count(*) FILTER (human <> other) AS fp FROM g WHERE other IS NOT NULL GROUP BY ALL)", "j AS (SELECT field, label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM t FULL JOIN p USING (field, label))", "r AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(support, 0)::DOUBLE AS r FROM j)", "SELECT field, label, support, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0.0::DOUBLE END, 6) AS f1 FROM r"))
def met05(s, d):
    return six(metrics.class_metrics(long(s, d), ["field"]), "precision", "recall", "f1")


@query("met05_field_gain", with_(FACES, LABELLED, LONG, "g AS (SELECT * FROM lg WHERE human IS NOT NULL)", "m AS (SELECT field, max(n) AS top FROM (SELECT field, human, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1)", "SELECT field, count(*) AS gold, count(other) AS said, count(*) FILTER (human = other) AS exact, round(count(other) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (human = other) / count(*)::DOUBLE, 6) AS accuracy, round(any_value(top) / count(*)::DOUBLE, 6) AS majority, round(count(*) FILTER (human = other) / count(*)::DOUBLE - any_value(top) / count(*)::DOUBLE, 6) AS gain FROM g JOIN m USING (field) GROUP BY field"))
def met05b(s, d):
    return six(metrics.field_gain(long(s, d), ["field"]), "coverage", "accuracy", "majority", "gain")


@query("met06_kappa", with_(FACES, LABELLED, "b AS (SELECT gender, human, other FROM lab WHERE human IS NOT NULL AND other IS NOT NULL)", "n AS (SELECT gender, count(*) AS n, avg(CASE WHEN human = other THEN 1.0::DOUBLE ELSE 0 END) AS po FROM b GROUP BY 1)", "e AS (SELECT gender, sum(nh * np)::DOUBLE AS e FROM (SELECT gender, human AS v, count(*) AS nh FROM b GROUP BY ALL) JOIN (SELECT gender, other AS v, count(*) AS np FROM b GROUP BY ALL) USING (gender, v) GROUP BY 1)", "SELECT gender, n, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n JOIN e USING (gender)"))
def met06(s, d):
    return six(metrics.kappa(labelled(s, d), ["gender"]), "kappa")


@query("met07_weighted_kappa", with_(FACES, LABELLED, "m AS (SELECT gender, lh, lo, count(*) AS k FROM lab GROUP BY ALL)", "n AS (SELECT gender, sum(k)::DOUBLE AS n, sum(k * (lh - lo) * (lh - lo))::DOUBLE AS o FROM m GROUP BY 1)", "e AS (SELECT a.gender, sum(a.k * b.k * (a.lh - b.lo) * (a.lh - b.lo))::DOUBLE AS e FROM (SELECT gender, lh, sum(k)::BIGINT AS k FROM m GROUP BY ALL) a JOIN (SELECT gender, lo, sum(k)::BIGINT AS k FROM m GROUP BY ALL) b USING (gender) GROUP BY 1)", "SELECT gender, n::BIGINT AS n, round(1 - (o / n) / (e / n / n), 6) AS qwk FROM n JOIN e USING (gender)"))
def met07(s, d):
    names = F.array(*map(F.lit, NAMES))
    rows = labelled(s, d).select("gender", F.get(names, c("lh")).alias("human"), F.get(names, c("lo")).alias("other"))
    return six(metrics.weighted_kappa(rows, ["gender"], NAMES), "qwk")


@query("met08_ordinal_errors", with_(FACES, LABELLED, "SELECT gender, count(*) AS n, round(avg((lo = lh)::INTEGER), 6) AS exact, round(avg((abs(lo - lh) <= 1)::INTEGER), 6) AS within_one, round(avg(abs(lo - lh)), 6) AS mae, round(avg(lo - lh), 6) AS bias, round(avg((lo < lh)::INTEGER), 6) AS under_rate, round(avg((lo > lh)::INTEGER), 6) AS over_rate FROM lab GROUP BY 1"))
def met08(s, d):
    return six(metrics.ordinal_errors(labelled(s, d), ["gender"], "lh", "lo"), "exact", "within_one", "mae", "bias", "under_rate", "over_rate")


@query("met08_balanced_accuracy", with_(FACES, LABELLED, "SELECT gender, round(avg(r), 6) AS balanced_accuracy, count(*) AS levels FROM (SELECT gender, lh, avg((lh = lo)::INTEGER) AS r FROM lab GROUP BY ALL) GROUP BY 1"))
def met08b(s, d):
    return six(metrics.balanced_accuracy(labelled(s, d), ["gender"], "lh", "lo"), "balanced_accuracy")


@query("met09_strategy_ranking", with_(FACES, LABELLED, "SELECT ad AS strategy, CAST(row_number() OVER (ORDER BY ba DESC, mae, ad) AS INTEGER) AS place FROM (SELECT ad, round(avg(r), 9) AS ba FROM (SELECT lab.image_id % 5 AS ad, lh, avg((lh = lo)::INTEGER) AS r FROM lab GROUP BY ALL) GROUP BY 1) JOIN (SELECT image_id % 5 AS ad, round(avg(abs(lo - lh)), 9) AS mae FROM lab GROUP BY 1) USING (ad)"))
def met09(s, d):
    rows = labelled(s, d).withColumn("strategy", c("image_id") % 5)
    both = metrics.balanced_accuracy(rows, ["strategy"], "lh", "lo").join(metrics.ordinal_errors(rows, ["strategy"], "lh", "lo"), "strategy")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("balanced_accuracy", 9)), F.round("mae", 9), "strategy")  # a row for each strategy
    return both.select("strategy", F.row_number().over(w).alias("place"))


@query("met10_calibration", with_(FACES, "r AS (SELECT gender, confidence AS p, CASE WHEN smile = 'yes' THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM faces)", "e AS (SELECT unnest([0, 1, 2, 3, 4]) AS i)", "b AS (SELECT gender, i, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM r JOIN e ON p >= i * 0.2::DOUBLE AND (p < i * 0.2::DOUBLE + 0.2::DOUBLE OR (i = 4 AND p <= 1)) GROUP BY ALL)", "t AS (SELECT gender, count(*) AS total, avg((p - y) * (p - y)) AS brier, avg(p) FILTER (y = 1) AS mean_right, avg(p) FILTER (y = 0) AS mean_wrong, stddev_pop(p) AS spread, count(*) FILTER (p >= 0.9 AND y = 0) AS sure_errors FROM r GROUP BY 1)", "SELECT gender, any_value(total) AS total, round(any_value(brier), 6) AS brier, round(any_value(mean_right), 6) AS mean_right, round(any_value(mean_wrong), 6) AS mean_wrong, round(any_value(spread), 6) AS spread, any_value(sure_errors) AS sure_errors, round(sum(n * gap) / any_value(total), 6) AS ece FROM b JOIN t USING (gender) GROUP BY gender"))
def met10(s, d):
    rows = faces(s, d).select("gender", c("confidence").alias("p"), F.when(c("smile") == "yes", 1.0).otherwise(0.0).alias("y"))
    return six(metrics.calibration(rows, ["gender"]), "brier", "mean_right", "mean_wrong", "spread", "ece")


@query("met11_name_match")
def met11(s, d):
    a = read(s, d, "part").select("p_partkey", "p_name", "p_brand")
    return a.select("p_partkey", metrics.name_match(c("p_name"), F.concat(c("p_name"), F.lit(" co"))).alias("contained"), metrics.name_match(c("p_name"), c("p_brand")).alias("other"))


@query("met12_group_free", with_(FACES, "k AS (SELECT image_id, count(*) FILTER (coder = 'h' AND legibility = 0) AS h, count(*) FILTER (coder = 'p' AND legibility = 0) AS p FROM faces GROUP BY 1)", "SELECT count(*) FILTER (h = 0) AS pages, count(*) FILTER (h = 0 AND p = 0) AS free, CAST(sum(p) FILTER (h = 0) AS BIGINT) AS false_groups, round(count(*) FILTER (h = 0 AND p = 0) / count(*) FILTER (h = 0)::DOUBLE, 6) AS specificity, round(count(*) FILTER (h > 0 AND p > 0) / count(*) FILTER (h > 0)::DOUBLE, 6) AS presence_recall FROM k"))
def met12(s, d):
    k = faces(s, d).groupBy("image_id").agg(F.count_if((c("coder") == "h") & (c("legibility") == 0)).alias("h"), F.count_if((c("coder") == "p") & (c("legibility") == 0)).alias("p"))
    none, free, some = c("h") == 0, (c("h") == 0) & (c("p") == 0), c("h") > 0
    return k.agg(F.count_if(none).alias("pages"), F.count_if(free).alias("free"), F.sum(F.when(none, c("p"))).alias("false_groups"), F.round(F.count_if(free) / F.count_if(none), 6).alias("specificity"), F.round(F.count_if(some & (c("p") > 0)) / F.count_if(some), 6).alias("presence_recall"))


@query("met13_mean_iou", with_(FACES, PAIRS, "SELECT round(avg(iou), 6) AS mean_iou, count(*) AS pairs FROM pairs_ WHERE iou >= 0.2"))
def met13(s, d):
    return accepted(s, d).agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.count("*").alias("pairs"))


@query("met15_collapsed_state", with_(FACES, "SELECT state, count(*) AS ads FROM (SELECT image_id, ad, CASE WHEN bool_or(smile = 'yes') THEN 'smile' WHEN bool_or(smile = 'no') THEN 'no_smile' ELSE 'not_assessable' END AS state FROM faces GROUP BY ALL) GROUP BY 1"))
def met15(s, d):
    a = faces(s, d).groupBy("image_id", "ad").agg(F.bool_or(c("smile") == "yes").alias("y"), F.bool_or(c("smile") == "no").alias("n"))
    return a.groupBy(V.chosen([(c("y"), "smile"), (c("n"), "no_smile")], "not_assessable").alias("state")).agg(F.count("*").alias("ads"))


@query("met16_threshold_curve")
def met16(s, d):
    matched = matching.pairs_by_threshold(accepted(s, d, 0.05), PAGE).where("step < 20").groupBy("step").agg(F.sum("matched").alias("matched"))
    totals = faces(s, d).agg(F.count("*").alias("boxes"))
    return matched.join(totals).select((c("step") / 20).alias("threshold"), "matched", F.round(2 * c("matched") / c("boxes"), 6).alias("f1"))  # one row of totals


@query("met17_ignored_truth", with_(FACES, "SELECT count(*) FILTER (coder = 'h' AND smile <> 'not_assessable') AS truth, count(*) FILTER (coder = 'h' AND smile = 'not_assessable') AS ignored, round(count(*) FILTER (coder = 'h' AND smile = 'yes') / count(*) FILTER (coder = 'h' AND smile <> 'not_assessable')::DOUBLE, 6) AS share FROM faces"))
def met17(s, d):
    h, ok = c("coder") == "h", c("smile") != "not_assessable"
    return faces(s, d).agg(F.count_if(h & ok).alias("truth"), F.count_if(h & ~ok).alias("ignored"), F.round(F.count_if(h & (c("smile") == "yes")) / F.count_if(h & ok), 6).alias("share"))


@query("met19_agreement_state", with_(FACES, "SELECT state, count(*) AS pages FROM (SELECT CASE WHEN count(v) < 2 THEN 'insufficient' WHEN count(DISTINCT v) = 1 THEN 'agree' ELSE 'disagree' END AS state FROM (SELECT image_id, nullif(smile, 'not_assessable') AS v FROM faces) GROUP BY image_id) GROUP BY 1"))
def met19(s, d):
    v = faces(s, d).groupBy("image_id").agg(F.collect_list(F.nullif("smile", F.lit("not_assessable"))).alias("v"))
    return v.groupBy(metrics.agreement_state(c("v")).alias("state")).agg(F.count("*").alias("pages"))


@query("met22_relations", with_(FACES, LABELLED, "SELECT CASE WHEN lo < lh THEN 'under' WHEN lo = lh THEN 'equal' ELSE 'over' END AS relation, count(*) AS n FROM lab GROUP BY 1"))
def met22(s, d):
    return labelled(s, d).groupBy(V.relation(c("lh"), c("lo")).alias("relation")).agg(F.count("*").alias("n"))


@query("met24_consensus", with_(FACES, "m AS (SELECT image_id, ad, CAST(legibility AS INTEGER) AS coder, nullif(smile, 'not_assessable') AS v FROM faces)", "k AS (SELECT image_id, ad, count(DISTINCT coder) AS coders FROM m GROUP BY ALL HAVING count(DISTINCT coder) >= 2)", "t AS (SELECT * FROM (SELECT image_id, ad, v AS majority, count(DISTINCT coder) AS votes FROM m WHERE v IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id, ad ORDER BY votes DESC, majority) = 1)", "SELECT k.image_id, k.ad, coders, majority, votes FROM k LEFT JOIN (SELECT * FROM t WHERE votes >= 2) t ON t.image_id = k.image_id AND t.ad = k.ad"))
def met24(s, d):
    m = faces(s, d).select("image_id", "ad", c("legibility").alias("coder"), F.nullif("smile", F.lit("not_assessable")).alias("v"))
    return metrics.consensus(m, ["image_id", "ad"], "coder", "v").select("image_id", "ad", "coders", "majority", "votes")


@query("met26_spearman", with_(FACES, LABELLED, "r AS (SELECT gender, rank() OVER (PARTITION BY gender ORDER BY lh) + (count(*) OVER (PARTITION BY gender, lh) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY gender ORDER BY lo) + (count(*) OVER (PARTITION BY gender, lo) - 1) / 2.0::DOUBLE AS b FROM lab)", "SELECT gender, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1"))
def met26(s, d):
    return six(metrics.spearman(labelled(s, d), ["gender"], "lh", "lo"), "rho")


@query("met28_confusion_examples", with_(FACES, LABELLED, "n AS (SELECT human, other, count(*) AS n, list_slice(list(DISTINCT image_id ORDER BY image_id), 1, 8) AS ids FROM lab WHERE human IS DISTINCT FROM other GROUP BY ALL)", "SELECT human, other, n, CAST(list_aggregate(ids, 'sum') AS BIGINT) AS id_sum FROM n ORDER BY n DESC, human, other LIMIT 8"))
def met28(s, d):
    rows = labelled(s, d).where("not (human <=> other)")
    cells = rows.groupBy("human", "other").agg(F.count("*").alias("n"))
    firsts = rows.select("human", "other", "image_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("human", "other").orderBy("image_id"))).where("k <= 8").groupBy("human", "other").agg(F.sum("image_id").alias("id_sum"))
    both = cells.alias("x").join(firsts.alias("y"), c("x.human").eqNullSafe(c("y.human")) & c("x.other").eqNullSafe(c("y.other"))).select("x.human", "x.other", "n", "id_sum")
    return both.orderBy(F.desc("n"), "human", "other").limit(8)


@query("met30_disagreements", with_(FACES, LABELLED, "SELECT human, other, gender, count(DISTINCT image_id) AS pages FROM lab WHERE human <> other GROUP BY ALL"))
def met30(s, d):
    return labelled(s, d).where("human <> other").dropDuplicates(["image_id", "human", "other", "gender"]).groupBy("human", "other", "gender").agg(F.count("*").alias("pages"))


@query("met31_promotion_gate", with_(FACES, COUNTS, "a AS (SELECT sum(matched) / sum(predicted)::DOUBLE AS p, sum(matched) / sum(human)::DOUBLE AS r FROM k)", "SELECT p >= 0.15 AS precise, r >= 0.5 AS complete, p >= 0.15 AND r >= 0.5 AS promoted FROM a"))
def met31(s, d):
    h, p = F.count_if(c("coder") == "h"), F.count_if(c("coder") == "p")
    k = faces(s, d).groupBy("ad").agg(h.alias("h"), p.alias("p"), F.least(h, p).alias("m")).agg((F.sum("m") / F.sum("p")).alias("p"), (F.sum("m") / F.sum("h")).alias("r"))
    return k.select((c("p") >= 0.15).alias("precise"), (c("r") >= 0.5).alias("complete"), ((c("p") >= 0.15) & (c("r") >= 0.5)).alias("promoted"))
