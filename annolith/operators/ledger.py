"""Accounting over an append-only ledger of attempts (AGG20-28, 40; WIN09-12; STR04). A row: task, ts, ok, stage, tokens, cost, error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolith.functions.values import error_kind, nearest_rank, safe_divide

from .tables import numbered


def summary(ledger: DataFrame, by: list[str]) -> DataFrame:
    """AGG20-22: attempts, successes, distinct tasks, tokens (missing is 0) and rates."""
    out = ledger.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("ok"), F.count_distinct("task").alias("tasks"), F.sum(F.coalesce("tokens", F.lit(0.0))).alias("tokens"))
    return out.withColumn("success_rate", safe_divide(F.col("ok"), F.col("attempts"))).withColumn("per_task", safe_divide(F.col("tokens"), F.col("tasks")))


def recovery(ledger: DataFrame, by: list[str]) -> DataFrame:
    """AGG23, WIN11: tasks that failed and then worked, and those that never worked."""
    tasks = ledger.groupBy(*by, "task").agg(F.bool_or("ok").alias("any_ok"), F.bool_or(~F.col("ok")).alias("any_failed"))
    return tasks.groupBy(*by).agg(F.count("*").alias("tasks"), F.count_if(F.col("any_ok") & F.col("any_failed")).alias("recovered"), F.count_if(~F.col("any_ok")).alias("unrecovered"))


def latency(ledger: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG24, AGG25: nearest-rank percentiles per endpoint. Uses the sorted distinct values with their counts, so a large
    group meets as counts."""
    counts = ledger.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("upto", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy(*by)))
    at = {f"p{round(q * 100):02d}": F.bround((F.col("n") - 1) * F.lit(q), 0) for q in (0.5, 0.9, 0.95)}
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > k, F.col(value))).alias(name) for name, k in at.items()], F.max(value).alias("most"), F.max("n").alias("n"))


def completeness(expected: DataFrame, done: DataFrame, page: str, task: str) -> DataFrame:
    """AGG27: per page, the expected tasks and those done, and whether all are."""
    hit = done.select(task).distinct().withColumn("_hit", F.lit(True))
    return expected.join(hit, task, "left").groupBy(page).agg(F.count("*").alias("expected"), F.count("_hit").alias("done")).withColumn("complete", F.col("expected") == F.col("done"))


def trailing(ledger: DataFrame, by: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """WIN09: the sum of a value over the last seconds, up to and with each row."""
    at = F.unix_micros(F.col(ts)) if dict(ledger.dtypes)[ts] == "timestamp" else F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return ledger.withColumn("trailing", F.sum(value).over(w))


def episodes(ledger: DataFrame, by: list[str], ts: str, key: str, quiet: int) -> DataFrame:
    """WIN12: a gap of ``quiet`` seconds or more begins a new episode; numbered from 1."""
    w = Window.partitionBy(*by).orderBy(ts, key)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(w) >= quiet * 1_000_000).cast("int"), F.lit(1))
    return ledger.withColumn("_new", fresh).withColumn("episode", F.sum("_new").over(w).cast("int")).drop("_new")


def ewma(ledger: DataFrame, by: list[str], order: list[str], value: str, keep: float = 0.95) -> DataFrame:
    """WIN10: old * keep + new * (1 - keep), from the first value; by, ewma, n. Groups without a value have no row.

    A value counts keep to the power of the number of values after it, and the first one in full, so the estimate is a sum
    over numbered rows: no group is folded in one task.
    """
    rows = ledger.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v"))
    placed = numbered(rows, [*by, *order], "_at")
    ends = placed.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))
    share = F.when(F.col("_at") == F.col("_first"), F.lit(1.0)).otherwise(F.lit(1 - keep)) * F.pow(F.lit(keep), F.col("_last") - F.col("_at"))
    joined = placed.join(ends, same) if by else placed.join(ends)  # without keys: one row
    return joined.groupBy(*by).agg(F.sum(F.col("_v") * share).alias("ewma"), F.count("*").cast("int").alias("n"))


def error_histogram(ledger: DataFrame, error: Column) -> DataFrame:
    return ledger.groupBy(error_kind(error).alias("kind")).agg(F.count("*").alias("n"))


__all__ = ["completeness", "episodes", "error_histogram", "ewma", "latency", "nearest_rank", "recovery", "summary", "trailing"]
