"""Composite reports over faces and pages (RPT01-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bootstrap, sampling, tables


def shares(rows: DataFrame, by: list[str], yes: Column, known: Column, least: int = 0) -> DataFrame:
    """Counts and the share of yes among known; cells under ``least`` are suppressed. by, n, yes, share."""
    out = rows.groupBy(*by).agg(F.count_if(known).alias("n"), F.count_if(known & yes).alias("yes"))
    return out.withColumn("share", F.when(F.col("n") >= max(least, 1), F.col("yes") / F.col("n")))


def share_intervals(rows: DataFrame, by: list[str], stratum: str, cluster: str, yes: Column, known: Column, population: DataFrame, replicates: int, least_clusters: int = 10) -> DataFrame:
    """RPT02-06: the share with a cluster-bootstrap interval, which needs ten clusters at least. population: the clusters."""
    sums = rows.groupBy(*by, stratum, cluster).agg(F.count_if(known & yes).cast("double").alias("num"), F.count_if(known).cast("double").alias("den"))
    point = sums.groupBy(*by).agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("share"), F.count_if(F.col("den") > 0).alias("clusters"))
    spread = sampling.interval(bootstrap.ratio_series(population, sums, cluster, stratum, by, replicates), by)
    enough = F.col("clusters") >= least_clusters
    return point.join(spread, by, "left").select(*by, "share", "clusters", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def gap(rows: DataFrame, by: list[str], group: str, a: str, b: str, yes: Column, known: Column, least: int = 30) -> DataFrame:
    """RPT04, RPT05: the difference of two groups' shares, suppressed where either has under ``least`` rows."""
    k = rows.groupBy(*by).agg(*[f.alias(f"{n}_{g}") for g in (a, b) for f, n in ((F.count_if(known & (F.col(group) == g)), "n"), (F.count_if(known & yes & (F.col(group) == g)), "y"))])
    enough = (F.col(f"n_{a}") >= least) & (F.col(f"n_{b}") >= least)
    return k.withColumn("gap", F.when(enough, F.col(f"y_{a}") / F.col(f"n_{a}") - F.col(f"y_{b}") / F.col(f"n_{b}")))


def pooled_years(rows: DataFrame, year: str, yes: Column, known: Column, first: int, last: int) -> DataFrame:
    """RPT02: five-year pooled share as a ratio of centred sums on a complete spine of years."""
    k = rows.groupBy(year).agg(F.count_if(known & yes).alias("num"), F.count_if(known).alias("den"))
    num = tables.centred_sum(k, year, "num", first, last).select(year, F.col("rolling").alias("rn"))
    den = tables.centred_sum(k, year, "den", first, last).select(year, F.col("rolling").alias("rd"))
    return num.join(den, year).select(year, F.try_divide(F.col("rn").cast("double"), F.col("rd")).alias("pooled"))


def dyads(rows: DataFrame, ad: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """RPT08: advertisements of just one face of either group, with both values."""
    k = rows.groupBy(*ad).agg(F.count("*").alias("n"), F.count_if(F.col(group) == a).alias("na"), F.max(F.when(F.col(group) == a, F.col(value))).alias("va"), F.max(F.when(F.col(group) == b, F.col(value))).alias("vb"))
    return k.where("n = 2 and na = 1").select(*ad, "va", "vb")


def concentration(rows: DataFrame, ad: list[str], yes: Column, known: Column) -> DataFrame:
    """RPT09: how often all, or any, faces of an advertisement smile, against independent faces at the overall rate."""
    k = rows.groupBy(*ad).agg(F.count_if(known).alias("n"), F.count_if(known & yes).alias("y")).where("n >= 2")
    p = k.agg((F.sum("y") / F.sum("n")).alias("p"))
    return k.join(F.broadcast(p)).agg(  # one row
        F.count("*").alias("ads"), F.count_if(F.col("y") == F.col("n")).alias("all_seen"), F.sum(F.pow("p", "n")).alias("all_expected"),
        F.count_if(F.col("y") > 0).alias("any_seen"), F.sum(1 - F.pow(1 - F.col("p"), "n")).alias("any_expected"))


def prominence(rows: DataFrame, ad: list[str], area: str, group: str, label: str) -> DataFrame:
    """RPT10: the label's credit for largest faces (ties share) against its share of faces."""
    w = Window.partitionBy(*ad)
    top = F.col(area) == F.max(area).over(w)
    f = rows.withColumn("_top", top).withColumn("_n", F.count("*").over(w)).withColumn("_tops", F.count_if("_top").over(w))
    mine = F.col(group) == label
    return f.agg(F.sum(F.when(F.col("_top") & mine, 1 / F.col("_tops")).otherwise(0.0)).alias("credit"), F.sum(F.when(mine, 1 / F.col("_n")).otherwise(0.0)).alias("expected"))


def complete_cases(parts: list[DataFrame], page: str, incomplete: DataFrame) -> list[DataFrame]:
    """RPT20: each dataset without the incomplete pages."""
    return [p.join(incomplete.select(page).distinct(), page, "left_anti") for p in parts]
