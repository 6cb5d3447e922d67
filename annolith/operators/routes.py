"""Several routes against one truth: case kinds, funnels by route, metrics of many runs (MET21, MET32, MET33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_all(truth: DataFrame, routes: dict[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """MET33: key, truth_<field>, <route>_<field> of the keys that the truth and every route have. Each
    frame has a row a key; of repeated keys the greatest row counts.

    All frames meet in one shuffle: rows are tagged, grouped by key, and keys with fewer tags than frames go.
    """
    frames = {"truth": truth, **routes}
    parts = [f.select(key, F.lit(name).alias("_of"), F.struct(*fields).alias("_row")) for name, f in frames.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    wide = rows.groupBy(key).agg(*[F.max(F.when(F.col("_of") == name, F.col("_row"))).alias(f"_{name}") for name in frames], F.count_distinct("_of").alias("_n"))
    return wide.where(F.col("_n") == len(frames)).select(key, *[F.col(f"_{name}")[f].alias(f"{name}_{f}") for name in frames for f in fields])


def case_kinds(truth: Column, counts: dict[str, Column], corrects: list[tuple[str, str]], recovers: list[tuple[str, str]], what: str = "group") -> Column:
    """MET33: the tags of a case, in the order of the rules: where the truth has none, each route that has some
    (``<r>_false_<what>``) and each pair (wrong, right) of which the second has none (``<right>_corrects_<wrong>_false_<what>``);
    else each route that has none (``<r>_missed_<what>``) and each pair (lost, found) of which only the second has some
    (``<found>_recovers_<lost>_<what>``)."""
    none = truth == 0
    rules = [(none & (n > 0), f"{r}_false_{what}") for r, n in counts.items()]
    rules += [(none & (counts[a] > 0) & (counts[b] == 0), f"{b}_corrects_{a}_false_{what}") for a, b in corrects]
    rules += [(~none & (n == 0), f"{r}_missed_{what}") for r, n in counts.items()]
    rules += [(~none & (counts[b] > 0) & (counts[a] == 0), f"{b}_recovers_{a}_{what}") for a, b in recovers]
    return F.filter(F.array(*[F.when(ok, name) for ok, name in rules]), lambda x: x.isNotNull())


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def retention(rows: DataFrame, by: str, bands: list[str] | None = None) -> DataFrame:
    """MET21: of pages whose truth has no group: how often the route has none, before and after asking whether it kept the
    page's advertisement at all, which it has to before a missing group is to its credit.

    rows: by, page facts truth_ads, kept_ads, truth_people, kept_people, truth_groups, found_groups, band. bands: only pages of
    these bands. A step's base is what the step before left.
    """
    base = F.col("truth_groups") == 0
    if bands:
        base = base & F.col("band").isin(*bands)
    free, with_ad, kept = base & (F.col("found_groups") == 0), base & (F.col("truth_ads") > 0), base & (F.col("kept_ads") > 0)
    n = F.count_if
    return rows.groupBy(by).agg(
        n(base).alias("pages"), share(n(free), n(base)).alias("group_free"), n(base & (F.col("found_groups") > 0)).alias("false_pages"),
        share(n(with_ad & (F.col("kept_ads") > 0)), n(with_ad)).alias("ad_kept"), share(n(free & kept), n(kept)).alias("group_free_if_kept"),
        share(F.sum(F.when(base, F.col("kept_people")).otherwise(0)), F.sum(F.when(base, F.col("truth_people")).otherwise(0))).alias("person_recall"),
    )


def cascade(pairs: DataFrame, by: list[str], fields: list[tuple[str, str, str]], missing: str = "not_assessable") -> DataFrame:
    """MET21: for each field (name, truth column, output column), among pairs whose truth has a substantive value: how many,
    the shares of outputs that are null, that say ``missing``, and that are exact. by, field, n, null, not_assessable, exact.

    All fields are counted in one pass; each has its own base.
    """
    long = F.array(*[F.struct(F.lit(name).alias("field"), F.col(truth).cast("string").alias("t"), F.col(out).cast("string").alias("o")) for name, truth, out in fields])
    rows = pairs.select(*by, F.inline(long)).where(F.col("t").isNotNull() & (F.col("t") != missing))
    n = F.count("*")
    return rows.groupBy(*by, "field").agg(n.alias("n"), share(F.count_if(F.col("o").isNull()), n).alias("null_share"), share(F.count_if(F.col("o") == missing), n).alias("missing_share"), share(F.count_if(F.col("o") == F.col("t")), n).alias("exact"))


def consolidated(runs: dict[str, DataFrame], key: str, metrics: list[str], base: str, skip: str | None = None) -> DataFrame:
    """MET32: run, key, metric, value of all runs as one long table; rows of ``skip`` (a key) come from the base run only."""
    out = None
    for name, frame in runs.items():
        own = frame.where(F.col(key) != skip) if skip is not None and name != base else frame
        long = own.select(F.lit(name).alias("run"), key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["run", key], metrics, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def within_ceiling(costs: DataFrame, reference: DataFrame, key: str, cost: str, times: float = 3.0) -> DataFrame:
    """MET32: costs with ceiling (so many times the reference's cost for that key) and within (null if either is missing)."""
    limit = reference.select(key, (F.col(cost) * times).alias("ceiling"))
    return costs.join(limit, key, "left").withColumn("within", F.col(cost) <= F.col("ceiling"))
