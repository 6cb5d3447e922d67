"""Bootstraps by replicate accumulators (SMP12-20; each function names its items).

Rows are first summed to clusters. A task takes a stretch of the clusters and the draws that fall on it (``draws``), and adds
weights times sums into one short row for each replicate and group: no row for each cluster and replicate is ever made. Draws
depend on the replicate, the stratum and the draw's number alone, so series made from one population share them, and a second
stream of draws is a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import draws

def replicate_sums(clusters: DataFrame, sums: DataFrame | None, cluster: str, stratum: str, by: list[str], measures: list[str], replicates: int, stream: str = "", chunk: int = draws.WIDTH) -> DataFrame:
    """by, replicate, measures: the weighted sums of each replicate (SMP12's weights: as many draws in each stratum as it has
    clusters).

    clusters: stratum, cluster, a row for each cluster of the population. sums: stratum, cluster, by, measures (numbers), any
    number of rows a cluster, or None where the clusters' own rows hold them: these are then numbered with their sums, without a
    join. Clusters without sums draw too. Rows without a stratum or cluster take no part.
    """
    keys, values = [f"_by{i}" for i in range(len(by))], [f"_m{i}" for i in range(len(measures))]
    places = draws.placed(clusters.where(F.col(cluster).isNotNull()), stratum, cluster, [*by, *measures] if sums is None else [])
    held, fields = (places, clusters.schema) if sums is None else (sums.join(places, [stratum, cluster]), sums.schema)
    rows = held.select("_place", *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[F.col(m).cast("double").alias(v) for m, v in zip(measures, values, strict=True)])
    kind = StructType([*(fields[b] for b in by), StructField("replicate", IntegerType()), *(StructField(v, DoubleType()) for v in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for groups, replicate, weights in draws.drawn(batches, keys, chunk):
            if groups is not last:
                last = groups
                own = [(table["_at"].to_numpy(), np.stack([np.nan_to_num(table[v].to_numpy()) for v in values], 1)) for _, table in groups]
            made = np.stack([weights[at].astype(np.float64) @ numbers for at, numbers in own])
            columns = [pa.array([key[i] for key, _ in groups], groups[0][1].schema.field(k).type) for i, k in enumerate(keys)]
            replicates_ = pa.array(np.full(len(groups), replicate, np.int32))
            yield pa.RecordBatch.from_arrays([*columns, replicates_, *(pa.array(made[:, i]) for i in range(len(values)))], kind.names)

    dealt = draws.dealt(rows, places, stratum, keys, replicates, stream, chunk)
    made = dealt.mapInArrow(lambda batches: draws.gathered(run(batches)), kind)
    return made.groupBy(*by, "replicate").agg(*[F.sum(v).alias(m) for m, v in zip(measures, values, strict=True)])


def ratio_series(clusters: DataFrame, sums: DataFrame, cluster: str, stratum: str, by: list[str], replicates: int, num: str = "num", den: str = "den", stream: str = "") -> DataFrame:
    """SMP13, SMP16, SMP17: by, replicate, value: num over den in each replicate, null where den is 0."""
    made = replicate_sums(clusters, sums.select(stratum, cluster, *by, num, den), cluster, stratum, by, [num, den], replicates, stream)
    return made.select(*by, "replicate", (F.col(num) / F.nullif(F.col(den), F.lit(0.0))).alias("value"))


def page_ratios(pages: DataFrame, page: str, stratum: str, ratios: dict[str, tuple[str, str]], replicates: int, stream: str = "") -> tuple[DataFrame, DataFrame]:
    """SMP16, SMP17, SMP19: (metric, estimate) and (metric, replicate, value) of several ratios of sums over the same draws.

    pages: stratum, page and the sums that ratios name as (num, den), a row for each page; they are read more than once, so what
    is dear should be stored. A metric whose den is 0 on every page is left out of the estimates."""
    measures = list(dict.fromkeys(m for pair in ratios.values() for m in pair))
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(num).alias("num"), F.col(den).alias("den")) for name, (num, den) in ratios.items()]))
    point = observed(pages.agg(*[F.sum(m).alias(m) for m in measures]).select(rows).where("den <> 0"), ["metric"])
    made = replicate_sums(pages, None, page, stratum, [], measures, replicates, stream).select("replicate", rows)
    return point, made.select("metric", "replicate", (F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).alias("value"))


def observed(sums: DataFrame, by: list[str], num: str = "num", den: str = "den") -> DataFrame:
    """by, estimate: the ratio over all rows."""
    return sums.groupBy(*by).agg((F.sum(num) / F.nullif(F.sum(F.col(den).cast("double")), F.lit(0.0))).alias("estimate"))


def ranked_interval(series: DataFrame, by: list[str], value: str = "value", rule: str = "half_even", chance: bool = False) -> DataFrame:
    """AGG10, AGG11: the 2.5 and 97.5 percentiles at a rank of the sorted values, rounded half to even or cut off; null values
    are left out. A group has a value for each replicate, so its array is as long as they are. chance: the share above 0."""
    if rule not in ("half_even", "truncate"):
        raise ValueError(rule)
    own = series.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_v"), *([F.avg((F.col(value) > 0).cast("double")).alias("chance")] if chance else []))
    n = F.size("_v")

    def at(q: float) -> Column:
        place = (n - 1) * F.lit(q)
        return F.get(F.col("_v"), (F.bround(place, 0) if rule == "half_even" else F.floor(place)).cast("int"))

    return own.select(*by, at(0.025).alias("low"), at(0.975).alias("high"), n.cast("bigint").alias("replicates"), *(["chance"] if chance else []))


def two_samples(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], cluster: str, stratum: str, by: list[str], replicates: int, streams: tuple[str, str] = ("a|", "b|")) -> DataFrame:
    """SMP19: by, first, second, difference, low, high, chance: two populations (clusters, sums) with draws of their own.

    The difference of each replicate is first minus second; the interval takes the rank rounded half to even."""
    if streams[0] == streams[1]:
        raise ValueError("two samples need two streams of draws")
    series = [ratio_series(c, s, cluster, stratum, by, replicates, stream=x) for (c, s), x in zip((a, b), streams, strict=True)]
    return compared([observed(s, by) for _, s in (a, b)], series, by)


def compared(points: list[DataFrame], series: list[DataFrame], by: list[str]) -> DataFrame:
    """SMP19's result from the estimates and the series of both samples, whose streams of draws must differ."""
    keys = [*by, "replicate"]
    delta = series[0].select(*keys, F.col("value").alias("_a")).join(series[1].select(*keys, F.col("value").alias("_b")), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("value")).where("value is not null")
    spread = ranked_interval(delta, by, chance=True)
    point = [p.withColumnRenamed("estimate", name) for p, name in zip(points, ("first", "second"), strict=True)]
    if by:
        return point[0].join(point[1], by).join(spread, by, "left").withColumn("difference", F.col("first") - F.col("second"))
    return point[0].join(point[1]).join(spread).withColumn("difference", F.col("first") - F.col("second"))  # one row each


def paired_accuracy(cases: DataFrame, case: str, first: str, second: str, replicates: int) -> DataFrame:
    """SMP20: one row: n, difference (mean over the replicates), low, high, chance: second minus first, on common draws of cases.

    cases: a row for each case with both results as booleans; rows of one case are drawn together. The interval takes the rank
    cut off."""
    rows = cases.select(F.lit("all").alias("_all"), case, F.col(first).cast("int").alias("num_a"), F.col(second).cast("int").alias("num_b"), F.lit(1).alias("den"))
    made = replicate_sums(rows.select("_all", case).distinct(), rows, case, "_all", [], ["num_a", "num_b", "den"], replicates)
    delta = made.select("replicate", ((F.col("num_b") - F.col("num_a")) / F.col("den")).alias("value"))
    spread = ranked_interval(delta, [], rule="truncate", chance=True)
    return rows.agg(F.count("*").alias("n")).join(delta.agg(F.avg("value").alias("difference"))).join(spread)  # one row each
