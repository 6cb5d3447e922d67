"""Constraint audits, cardinality checks and accounting (PRJ08-10, 23-25, 35; JOI04-07; SET05-06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT = ["check", "level", "passed", "affected_rows", "detail"]


def audit(frame: DataFrame, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """PRJ23: rules: (name, error or warning, the condition that a bad row meets, detail). One pass for all rules."""
    counts = frame.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{i}") for i, (_, _, bad, _) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(level).alias("level"), (F.col(f"c{i}") == 0).alias("passed"), F.col(f"c{i}").alias("affected_rows"), F.lit(d).alias("detail")) for i, (n, level, _, d) in enumerate(rules)])
    return counts.select(F.inline(rows))


def unique_key(frame: DataFrame, key: list[str], name: str) -> DataFrame:
    extra = frame.groupBy(*key).count().where("count > 1")
    return extra.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), F.lit("error").alias("level"), (F.col("n") == 0).alias("passed"), F.col("n").alias("affected_rows"), F.lit("repeated " + ", ".join(key)).alias("detail"))


def orphans(child: DataFrame, parent: DataFrame, key: list[str], name: str) -> DataFrame:
    """JOI07"""
    return child.join(parent.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.lit("error").alias("level"), (F.col("n") == 0).alias("passed"), F.col("n").alias("affected_rows"), F.lit("no parent by " + ", ".join(key)).alias("detail"))


def audits(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(audited: DataFrame) -> DataFrame:
    """Fails at run time if a rule of level error is broken."""
    bad = (F.col("level") == "error") & ~F.col("passed")
    return audited.withColumn("passed", F.when(bad, F.raise_error(F.concat(F.lit("broken: "), F.col("check"))).cast("boolean")).otherwise(F.col("passed")))


def checked_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "left", one_left: bool = False) -> DataFrame:
    """JOI05: a join that fails if the right side (and, if asked, the left) repeats a key."""

    def once(frame: DataFrame) -> DataFrame:
        # a grouped count that raises; it rides on the join's own partitioning by the key
        return frame.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in frame.columns if c not in key])).alias("_row")).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key")).cast("boolean")).otherwise(F.lit(True))).where("_ok").select(*key, "_row.*")

    return (once(left) if one_left else left).join(once(right), key, how)


def scope_gaps(rows: DataFrame, position: str, n: int) -> DataFrame:
    """PRJ10: missing, repeated and out-of-range positions of a scope 0..n-1."""
    want = rows.sparkSession.range(n).select(F.col("id").alias(position))
    have = rows.groupBy(position).count()
    missing = want.join(have, position, "left_anti").select(position, F.lit("missing").alias("problem"))
    repeated = have.where("count > 1").select(position, F.lit("repeated").alias("problem"))
    outside = have.where((F.col(position) < 0) | (F.col(position) >= n) | F.col(position).isNull()).select(position, F.lit("outside").alias("problem"))
    return missing.unionByName(repeated).unionByName(outside)


def reconcile(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """JOI04: a full outer join with, for each column, whether both sides agree (nulls agree)."""
    a = left.select(*key, *[F.col(c).alias(f"left_{c}") for c in columns])
    b = right.select(*key, *[F.col(c).alias(f"right_{c}") for c in columns])
    return a.join(b, key, "full_outer").withColumn("agree", reduce(lambda x, y: x & y, [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in columns]))


def changes(rows: DataFrame, key: list[str], after: dict[str, Column], rule: str) -> DataFrame:
    """PRJ19: a log row for each field whose value a rule changes; rows meet their own new values, without a join."""
    log = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("from_value"), new.cast("string").alias("to_value")) for f, new in after.items()])
    return rows.select(*key, F.inline(F.filter(log, lambda x: ~x["from_value"].eqNullSafe(x["to_value"])))).withColumn("rule", F.lit(rule))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """SRC09, SET05: equal as bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
