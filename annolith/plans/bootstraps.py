"""Queries over bootstraps of evaluations: SMP16, SMP17, SMP19, SMP20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.operators import bootstrap as B
from annolith.operators import matching
from annolith.operators.store import stored

from .ledgers import REPS
from .registry import query
from .scores import LABELLED, labelled, six
from .spatial import GREEDY, PAGE, accepted
from .standins import FACES, PAIRS, faces, with_

c = F.col


def weights_sql(name: str, population: str, stream: str = "") -> str:
    """CTEs <name>_cl and <name>_wt (replicate, cl, weight); population: a query of the clusters cl, one stratum."""
    return f"""{name}_cl AS (SELECT cl, row_number() OVER (ORDER BY cl) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT cl FROM ({population}))),
{name}_wt AS (SELECT replicate, k.cl, count(*) AS weight FROM (SELECT b AS replicate, ('0x' || substr(md5('{stream}' || b || '|all|' || slot), 1, 8))::BIGINT % n AS slot FROM {name}_cl CROSS JOIN (SELECT unnest(range({REPS})) AS b)) dr JOIN {name}_cl k ON k.slot = dr.slot GROUP BY ALL)"""


def rank_sql(rule: str) -> str:
    """low and high of the sorted list v of n values."""
    return ", ".join(f"v[CAST({rule.format(f'(n - 1) * {q}::DOUBLE')} AS BIGINT) + 1] AS {name}" for name, q in (("low", 0.025), ("high", 0.975)))


HALF_EVEN, TRUNCATE = "round_even({}, 0)", "floor({})"
PAGE_SUMS = """ps AS (SELECT 'f1' AS metric, image_id AS cl, sum(2 * least(h, p)) AS num, sum(h + p) AS den FROM (SELECT image_id, ad, count(*) FILTER (coder = 'h') AS h, count(*) FILTER (coder = 'p') AS p FROM faces GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT 'exact', image_id, count(*) FILTER (lh = lo), count(*) FROM lab GROUP BY ALL
  UNION ALL SELECT 'lenient', image_id, count(*) FILTER (abs(lh - lo) <= 1), count(*) FROM lab GROUP BY ALL)"""


RATIOS = {"f1": ("both", "boxes"), "exact": ("same", "labels"), "lenient": ("close", "labels")}


def page_sums(s, d):
    """all, image_id and the sums of RATIOS, a row for each page: what it adds to F1 and to the label accuracies.

    The faces are read and dealt to pages once. A face is labelled if another one follows it on its page."""
    after = Window.partitionBy("image_id").orderBy("id")
    rows = faces(s, d).select("image_id", "ad", "coder", "legibility", F.lead("smile").over(after).alias("s2"), F.lead("legibility").over(after).alias("l2"))
    lh, lo = c("legibility"), c("l2")
    ads = rows.groupBy("image_id", "ad").agg(
        F.count_if(c("coder") == "h").alias("h"), F.count_if(c("coder") == "p").alias("p"),
        F.count_if(lh == lo).alias("same"), F.count_if(F.abs(lh - lo) <= 1).alias("close"), F.count("s2").alias("labels"),
    )
    sums = [F.sum(2 * F.least("h", "p")).alias("both"), F.sum(c("h") + c("p")).alias("boxes"), *[F.sum(m).alias(m) for m in ("same", "close", "labels")]]
    return stored(ads.groupBy(F.lit("all").alias("all"), "image_id").agg(*sums), "page-sums")


SERIES = "se AS (SELECT metric, replicate, sum(weight * num) / nullif(sum(weight * den), 0)::DOUBLE AS value FROM ps JOIN w_wt USING (cl) GROUP BY ALL)"
LISTED = "li AS (SELECT metric, list_sort(list(value)) AS v, count(*) AS n FROM se WHERE value IS NOT NULL GROUP BY 1)"
POINT = "pt AS (SELECT metric, sum(num) / nullif(sum(den), 0)::DOUBLE AS estimate FROM ps GROUP BY 1)"
SPREAD = "SELECT metric, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, n AS replicates FROM pt JOIN (SELECT metric, n, {} FROM li) USING (metric)"


@query("smp16_page_bootstrap", with_(FACES, LABELLED, PAGE_SUMS, weights_sql("w", "SELECT image_id AS cl FROM faces"), SERIES, LISTED, POINT, SPREAD.format(rank_sql(HALF_EVEN))))
def smp16(s, d):
    point, series = B.page_ratios(page_sums(s, d), "image_id", "all", RATIOS, REPS)
    return six(point.join(B.ranked_interval(series, ["metric"]), "metric"), "estimate", "low", "high")


def _matched_sql(name: str, score: str, where: str) -> str:
    r, k = GREEDY.replace("{SCORE}", score).replace("{WHERE}", where).replace("{A}", "").lstrip(", ").rsplit("\nSELECT", 1)[0].split(",\nk AS ", 1)
    return f"{name}_{r},\n{name}_k AS {k.replace('FROM r)', f'FROM {name}_r)')},\n{name}_m AS (SELECT image_id, count(*) AS m FROM {name}_k GROUP BY 1)"


MATCHED_SUMS = """t AS (SELECT image_id, count(*) AS boxes FROM faces GROUP BY 1),
ps AS (SELECT 'strict' AS metric, image_id AS cl, 2 * coalesce(m, 0) AS num, boxes AS den FROM t LEFT JOIN st_m USING (image_id) UNION ALL SELECT 'lenient', image_id, 2 * coalesce(m, 0), boxes FROM t LEFT JOIN le_m USING (image_id))"""


@query(
    "smp17_matching_bootstrap",
    with_(FACES, PAIRS, _matched_sql("st", "iou", "iou >= 0.2"), _matched_sql("le", "greatest(iou, containment * 0.19::DOUBLE)", "iou >= 0.1 OR (containment >= 0.95 AND iou >= 0.02)"), MATCHED_SUMS, weights_sql("w", "SELECT image_id AS cl FROM faces"), SERIES, LISTED, POINT, SPREAD.format(rank_sql(TRUNCATE))),
)
def smp17(s, d):
    # a page's matching is the same in every replicate, so both are made once, from one set of candidates, and only counts are drawn
    iou, lenient = c("iou"), F.greatest(c("iou"), c("containment") * 0.19)
    matched = matching.greedy_counts(accepted(s, d, 0.1, 0.95), PAGE, {"strict": F.when(iou >= 0.2, iou), "lenient": lenient})
    pages = faces(s, d).groupBy("image_id").agg(F.count("*").alias("boxes")).join(matched, "image_id", "left")
    twice = [(2 * F.coalesce(m, F.lit(0))).alias(m) for m in ("strict", "lenient")]
    sums = stored(pages.select(F.lit("all").alias("all"), "image_id", "boxes", *twice), "page-sums")
    point, series = B.page_ratios(sums, "image_id", "all", {m: (m, "boxes") for m in ("strict", "lenient")}, REPS)
    return six(point.join(B.ranked_interval(series, ["metric"], rule="truncate"), "metric"), "estimate", "low", "high")


def _arm(name: str, rest: int) -> list[str]:
    own = f"ps_{name} AS (SELECT * FROM ps WHERE cl % 2 = {rest})"
    series = f"se_{name} AS (SELECT metric, replicate, sum(weight * num) / nullif(sum(weight * den), 0)::DOUBLE AS value FROM ps_{name} JOIN {name}_wt USING (cl) GROUP BY ALL)"
    point = f"pt_{name} AS (SELECT metric, sum(num) / nullif(sum(den), 0)::DOUBLE AS estimate FROM ps_{name} GROUP BY 1)"
    return [own, weights_sql(name, f"SELECT image_id AS cl FROM faces WHERE image_id % 2 = {rest}", f"{name}|"), series, point]


@query(
    "smp19_two_samples",
    with_(
        FACES, LABELLED, PAGE_SUMS, *_arm("dev", 0), *_arm("res", 1),
        "se AS (SELECT metric, replicate, a.value - b.value AS value FROM se_dev a JOIN se_res b USING (metric, replicate))",
        "li AS (SELECT metric, list_sort(list(value)) AS v, count(*) AS n, avg(CAST(value > 0 AS INTEGER)) AS chance FROM se WHERE value IS NOT NULL GROUP BY 1)",
        f"SELECT metric, round(a.estimate, 6) AS first, round(b.estimate, 6) AS second, round(a.estimate - b.estimate, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, n AS replicates, round(chance, 6) AS chance FROM pt_dev a JOIN pt_res b USING (metric) JOIN (SELECT metric, n, chance, {rank_sql(HALF_EVEN)} FROM li) USING (metric)",
    ),
)
def smp19(s, d):
    sums = page_sums(s, d)
    points, series = zip(*[B.page_ratios(sums.where(c("image_id") % 2 == k), "image_id", "all", RATIOS, REPS, stream) for k, stream in enumerate(("dev|", "res|"))], strict=True)
    return six(B.compared(points, series, ["metric"]), "first", "second", "difference", "low", "high", "chance")


@query(
    "smp20_paired_accuracy",
    with_(
        FACES, LABELLED, "ca AS (SELECT image_id || '-' || id AS cl, CAST(lo = lh AS INTEGER) AS x, CAST(least(lo + 1, 3) = lh AS INTEGER) AS y FROM lab)",
        weights_sql("w", "SELECT cl FROM ca"),
        "se AS (SELECT replicate, (sum(weight * y) - sum(weight * x)) / sum(weight)::DOUBLE AS value FROM ca JOIN w_wt USING (cl) GROUP BY 1)",
        "li AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS difference, avg(CAST(value > 0 AS INTEGER)) AS chance FROM se)",
        f"SELECT (SELECT count(*) FROM ca) AS n, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, replicates, round(chance, 6) AS chance FROM (SELECT difference, chance, n AS replicates, {rank_sql(TRUNCATE)} FROM li)",
    ),
)
def smp20(s, d):
    rows = labelled(s, d).select(F.concat_ws("-", "image_id", "id").alias("case"), (c("lo") == c("lh")).alias("plain"), (F.least(c("lo") + 1, F.lit(3)) == c("lh")).alias("raised"))
    return six(B.paired_accuracy(rows, "case", "plain", "raised", REPS), "difference", "low", "high", "chance")
