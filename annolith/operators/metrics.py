"""Agreement, classification and calibration metrics over long tables (MET01-34)."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from annolith.functions.values import ORDERS, rank_of, safe_divide


def f1(precision: Column, recall: Column, total: Column | None = None) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).when(precision.isNotNull() & recall.isNotNull(), 0.0)


def detection(counts: DataFrame, null_on_zero: bool = True) -> DataFrame:
    """MET01: human, predicted, matched with precision, recall and f1.

    A zero denominator gives null, or (``null_on_zero`` False) 0 unless both totals are 0.
    """
    p, r = safe_divide(F.col("matched"), F.col("predicted")), safe_divide(F.col("matched"), F.col("human"))
    if not null_on_zero:
        some = (F.col("human") > 0) | (F.col("predicted") > 0)
        p, r = F.when(some, F.coalesce(p, F.lit(0.0))), F.when(some, F.coalesce(r, F.lit(0.0)))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def kappa(pairs: DataFrame, by: list[str], human: str = "human", other: str = "other") -> DataFrame:
    """MET06: Cohen's kappa over rows with both labels; null where chance agreement is complete."""
    both = pairs.where(F.col(human).isNotNull() & F.col(other).isNotNull()).groupBy(*by, human, other).count()
    rows = both.groupBy(*by, F.col(human).alias("label")).agg(F.sum("count").alias("nh"))
    cols = both.groupBy(*by, F.col(other).alias("label")).agg(F.sum("count").alias("np"))
    chance = rows.join(cols, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("nh") * F.col("np")).alias("chance"))
    seen = both.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col(human) == F.col(other), F.col("count")).otherwise(0)).alias("same"))
    out = seen.join(chance, by, "left") if by else seen.crossJoin(chance)  # without groups both sides are one row
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(pairs: DataFrame, by: list[str], order: list[str], human: str = "human", other: str = "other", empty: float | None = None) -> DataFrame:
    """MET07: quadratic weights over an order; ``empty`` where nothing is expected to differ.

    The expected square difference of independent marginals follows from their means and mean squares, so no cross join
    of the marginals is needed.
    """
    i, j = rank_of(F.col(human), order).cast("double"), rank_of(F.col(other), order).cast("double")
    ranks = pairs.select(*by, i.alias("i"), j.alias("j")).where("i is not null and j is not null")
    sums = ranks.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))).alias("observed"), (F.avg(F.col("i") * F.col("i")) + F.avg(F.col("j") * F.col("j")) - 2 * F.avg("i") * F.avg("j")).alias("expected"))
    return sums.select(*by, "n", F.when(F.abs("expected") > 1e-12, 1 - F.col("observed") / F.col("expected")).otherwise(F.lit(empty)).alias("qwk"))


def ordinal_errors(pairs: DataFrame, by: list[str], human: str = "human", other: str = "other") -> DataFrame:
    """MET08: over rank columns."""
    d = F.col(other) - F.col(human)
    return pairs.where(F.col(human).isNotNull() & F.col(other).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((d == 0).cast("double")).alias("exact"),
        F.avg((F.abs(d) <= 1).cast("double")).alias("within_one"),
        F.avg(F.abs(d).cast("double")).alias("mae"),
        F.avg(d.cast("double")).alias("bias"),
        F.avg((d < 0).cast("double")).alias("under_rate"),
        F.avg((d > 0).cast("double")).alias("over_rate"),
    )


def balanced_accuracy(pairs: DataFrame, by: list[str], human: str = "human", other: str = "other") -> DataFrame:
    """MET08, MET18: recall of each level, and their mean."""
    recall = pairs.where(F.col(human).isNotNull()).groupBy(*by, human).agg(F.avg(F.coalesce((F.col(human) == F.col(other)).cast("double"), F.lit(0.0))).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("levels"))


def field_summary(pairs: DataFrame) -> DataFrame:
    """MET04: pairs: field, human, other. Counts over rows where either side is there."""
    rows = pairs.where("human is not null or other is not null")
    exact = F.col("human").eqNullSafe(F.col("other"))
    near = exact
    for field, order in ORDERS.items():
        near = near | ((F.col("field") == field) & F.coalesce(F.abs(rank_of(F.col("human"), order) - rank_of(F.col("other"), order)) <= 1, F.lit(False)))
    return rows.groupBy("field").agg(
        F.count("*").alias("assessed"),
        F.count_if(exact).alias("exact"),
        F.count_if(near).alias("lenient"),
        F.count_if(F.col("human").isNull() != F.col("other").isNull()).alias("one_missing"),
    ).withColumn("exact_accuracy", safe_divide(F.col("exact"), F.col("assessed"))).withColumn("lenient_accuracy", safe_divide(F.col("lenient"), F.col("assessed")))


def class_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """MET05: by, label, support, tp, fp, precision, recall, f1 over rows with a human label."""
    gold = pairs.where("human is not null")
    support = gold.groupBy(*by, F.col("human").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("human") == F.col("other")).alias("tp"))
    said = gold.where("other is not null").groupBy(*by, F.col("other").alias("label")).agg(F.count_if(F.col("human") != F.col("other")).alias("fp"))
    out = support.join(said, [*by, "label"], "full_outer").na.fill(0, ["support", "tp", "fp"])
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("support"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def field_gain(pairs: DataFrame, by: list[str]) -> DataFrame:
    """MET05: coverage, accuracy and the gain over always saying the most frequent label."""
    gold = pairs.where("human is not null")
    most = gold.groupBy(*by, "human").count().groupBy(*by).agg(F.max("count").alias("top"))
    seen = gold.groupBy(*by).agg(F.count("*").alias("gold"), F.count("other").alias("said"), F.count_if(F.col("human") == F.col("other")).alias("exact"))
    out = seen.join(most, by)
    return out.select(*by, "gold", "said", "exact", safe_divide(F.col("said"), F.col("gold")).alias("coverage"), safe_divide(F.col("exact"), F.col("gold")).alias("accuracy"), safe_divide(F.col("top"), F.col("gold")).alias("majority"), (F.col("exact") / F.col("gold") - F.col("top") / F.col("gold")).alias("gain"))


def confusions(pairs: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """MET04, SRT07: the most frequent unequal pairs, ties by label."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "human", "other")
    rows = pairs.where("not (human <=> other)").groupBy(*by, "human", "other").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def calibration(rows: DataFrame, by: list[str], chance: str = "p", right: str = "y", bins: int = 5) -> DataFrame:
    """MET10: Brier score and expected calibration error; the last bin is closed and edges are i * (1 / bins)."""
    width = 1.0 / bins
    edges = F.array(*[F.struct(F.lit(i * width).alias("low"), F.lit(i * width + width).alias("high"), F.lit(i == bins - 1).alias("last")) for i in range(bins)])
    p, y = F.col(chance), F.col(right).cast("double")
    placed = rows.select(*by, p.alias("p"), y.alias("y"), F.explode(edges).alias("e")).where((F.col("p") >= F.col("e.low")) & ((F.col("p") < F.col("e.high")) | (F.col("e.last") & (F.col("p") <= 1.0))))
    binned = placed.groupBy(*by, "e.low").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("total"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(F.when(y == 1, p)).alias("mean_right"), F.avg(F.when(y == 0, p)).alias("mean_wrong"), F.stddev_pop(p).alias("spread"), F.count_if((p >= 0.9) & (y == 0)).alias("sure_errors"))
    error = binned.groupBy(*by).agg(F.sum(F.col("n") * F.col("gap")).alias("weighted"))
    out = whole.join(error, by) if by else whole.crossJoin(error)  # one row on either side
    return out.withColumn("ece", F.col("weighted") / F.col("total")).drop("weighted")


def agreement_state(values: Column) -> Column:
    """MET19: agree, disagree, or insufficient below two values."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) < 2, "insufficient").when(F.size(F.array_distinct(known)) == 1, "agree").otherwise("disagree")


def average_ranks(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Ranks from 1 with ties at their mean, as Spearman's rho needs them."""
    counts = rows.groupBy(*by, column).count()
    w = Window.partitionBy(*by).orderBy(column)
    below = F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.withColumn(name, below + (F.col("count") + 1) / 2).drop("count"), [*by, column])


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """MET26: windows run over distinct values only."""
    ranked = average_ranks(average_ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "_ra"), by, b, "_rb")
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def consensus(members: DataFrame, cluster: list[str], coder: str, field: str, least: int = 2) -> DataFrame:
    """MET24: clusters that enough coders share; the field's majority where at least ``least`` coders agree."""
    seen = members.groupBy(*cluster).agg(F.count_distinct(coder).alias("coders"))
    votes = members.where(F.col(field).isNotNull()).groupBy(*cluster, field).agg(F.count_distinct(coder).alias("votes"))
    w = Window.partitionBy(*cluster).orderBy(F.desc("votes"), field)
    top = votes.withColumn("place", F.row_number().over(w)).where((F.col("place") == 1) & (F.col("votes") >= least)).select(*cluster, F.col(field).alias("majority"), "votes")
    return seen.where(F.col("coders") >= least).join(top, cluster, "left")


@F.pandas_udf(DoubleType())
def _ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """MET11: difflib's ratio, which no built-in gives."""
    return _ratio(a, b)


def name_match(a: Column, b: Column, least: float = 0.76) -> Column:
    """MET11: equal, one within the other (four letters or more), or a ratio of ``least``; names in plain lower case."""
    x, y = (F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")) for c in (a, b))
    short = F.least(F.length(x), F.length(y))
    return (x == y) | ((short >= 4) & (x.contains(y) | y.contains(x))) | (sequence_ratio(x, y) >= least)
