"""Aggregates, windows and joins over flat tables (AGG, WIN, JOI, SRT, SET; each function names its items)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def ranked_dedup(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """WIN01: the first row of each key; nulls last is the caller's choice of order columns."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """PRJ36, SRC15, JOI21: the last row of each key; partial aggregation cuts the rows before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def key_sizes(rows: DataFrame, key: list[str]) -> DataFrame:
    """AGG01: groups, repeated groups, extra rows and the largest group, null keys included."""
    return rows.groupBy(*key).count().agg(F.count("*").alias("groups"), F.count_if(F.col("count") > 1).alias("repeated_groups"), F.sum(F.col("count") - 1).alias("extra_rows"), F.max("count").alias("largest"))


def share_within(rows: DataFrame, by: list[str], value: str, name: str = "share") -> DataFrame:
    """AGG15"""
    return rows.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def grid(counts: DataFrame, dims: dict[str, list], value: str = "n") -> DataFrame:
    """AGG14: every combination of stated labels, 0 where there was none. The grid is literal, so its size is stated."""
    spark = counts.sparkSession
    frame = None
    for name, labels in dims.items():
        own = spark.createDataFrame([(x,) for x in labels], f"`{name}` {counts.schema[name].dataType.simpleString()}")
        frame = own if frame is None else frame.crossJoin(own)
    return frame.join(counts, list(dims), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def crosstab(rows: DataFrame, row: str, column: str, labels: list[str], normalise: str | None = None) -> DataFrame:
    """AGG13, AGG16: counts, or shares of the row or of the column."""
    wide = rows.groupBy(row).pivot(column, labels).agg(F.count(F.lit(1))).na.fill(0, labels)
    if normalise == "row":
        total = sum((F.col(f"`{c}`") for c in labels), F.lit(0))
        return wide.select(row, *[F.try_divide(F.col(f"`{c}`").cast("double"), total).alias(c) for c in labels])
    if normalise == "column":
        whole = Window.partitionBy(F.lit(1))  # one row for each label of the row dimension
        return wide.select(row, *[F.try_divide(F.col(f"`{c}`").cast("double"), F.sum(f"`{c}`").over(whole)).alias(c) for c in labels])
    return wide


def with_total(rows: DataFrame, by: str, aggregates: list[Column], total: str = "Total") -> DataFrame:
    """AGG18: groups and a total row."""
    return rows.rollup(by).agg(F.grouping(by).alias("_g"), *aggregates).withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by).cast("string"))).drop("_g")


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG31: the most frequent value, ties to the smaller."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("n"), F.col(value))).alias("m")).select(*by, F.col(f"m.{value}").alias("mode"), (-F.col("m.col1")).alias("n"))


def three_valued(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG30: any_yes: 1 if any, 0 only if all are assessed; all_yes: 0 if any no, 1 only if all are assessed and yes."""
    counts = rows.groupBy(*by).agg(F.count_if(F.col(value) == "yes").alias("yes"), F.count_if(F.col(value).isin("yes", "no")).alias("assessed"), F.count("*").alias("total"))
    any_yes = F.when(F.col("yes") > 0, 1).when(F.col("assessed") == F.col("total"), 0)
    all_yes = F.when(F.col("yes") < F.col("assessed"), 0).when((F.col("assessed") == F.col("total")) & (F.col("yes") == F.col("total")), 1)
    return counts.withColumn("any_yes", any_yes).withColumn("all_yes", all_yes)


def reduced_label(rows: DataFrame, by: list[str], value: str, half: float = 0.5) -> DataFrame:
    """AGG32: all, mostly (over half) or mixed over assessable values, not_assessable below half coverage."""
    known = F.col(value).isNotNull()
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("seen"), F.max(F.when(known, F.struct("n", F.col(value)))).alias("top"))
    label = F.when(F.col("seen") < F.col("total") * half, "not_assessable").when(F.col("top.n") == F.col("seen"), F.concat(F.lit("all_"), F.col(f"top.{value}"))).when(F.col("top.n") > F.col("seen") * half, F.concat(F.lit("mostly_"), F.col(f"top.{value}"))).otherwise("mixed")
    return whole.select(*by, label.alias("label"), "total", "seen")


def composition(rows: DataFrame, by: list[str], value: str, order: str, sure: Column, override: str, half: float = 0.5) -> DataFrame:
    """AGG39: by, label: <value>_only, mostly_<value> (over half) or mixed over the known values, of equally frequent ones that
    which comes first in the order; ``override`` if any row is sure; null with fewer than two rows, or known ones under half."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.bool_or(F.coalesce(sure, F.lit(False))).alias("sure"))
    known = F.col(value).isNotNull()
    top = F.min(F.when(known, F.struct((-F.col("n")).alias("less"), "first", F.col(value).alias("v"))))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("seen"), F.bool_or("sure").alias("sure"), top.alias("top"))
    n, v, seen = -F.col("top.less"), F.col("top.v"), F.col("seen")
    label = F.when((F.col("total") >= 2) & (seen >= F.col("total") * half), F.when(F.col("sure"), override).when(n == seen, F.concat(v, F.lit("_only"))).when(n > seen * 0.5, F.concat(F.lit("mostly_"), v)).otherwise("mixed"))
    return whole.select(*by, label.alias("label"))


def centred_sum(rows: DataFrame, year: str, value: str, first: int, last: int, width: int = 5) -> DataFrame:
    """WIN06: over a complete spine of years; null unless all years of the frame have a value. One row a year."""
    half = width // 2
    spine = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(year))
    w = Window.partitionBy(F.lit(1)).orderBy(year).rowsBetween(-half, half)
    whole = spine.join(rows.select(year, value), year, "left")
    return whole.withColumn("rolling", F.when(F.count(value).over(w) == width, F.sum(value).over(w)))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """PRJ31, SRT08, SMP24: rows numbered from 0 in a global order, without one task for all of them.

    Rows are dealt by ranges of the order and numbered within their range; the number of rows in the ranges before is
    added, which is a table with a row for each partition. Equal rows of the order get numbers in any order.
    """
    keys = [F.expr(o) if isinstance(o, str) else o for o in order]
    sort = [f"_k{i}" for i in range(len(keys))]
    dealt = rows.select("*", *[k.alias(name_) for k, name_ in zip(keys, sort, strict=True)]).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # the id is the partition's number and, below it, the row's place there; stored, so that all reads see one dealing
    placed = stored(dealt.select(*rows.columns, F.monotonically_increasing_id().alias("_id")), "numbered")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(inside) + 1).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each partition
    return own.select(*rows.columns, (F.col("_before") + inside).alias(name))


def extremes(rows: DataFrame, by: list[str], value: str, key: str, n: int, seed: object) -> DataFrame:
    """SRT03: the n most and least of each group, ties by hash; columns mode and place."""
    from .sampling import hash_key

    tie = hash_key(seed, F.col(key))
    out = None
    for kind, order in (("most", F.col(value).desc()), ("least", F.col(value).asc())):
        own = rows.withColumn("mode", F.lit(kind)).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).where(F.col("place") <= n)
        out = own if out is None else out.unionByName(own)
    return out


def override(base: DataFrame, side: DataFrame, key: list[str], fields: list[str], only_if: Column | None = None) -> DataFrame:
    """JOI09, JOI10, JOI24: a side row replaces the fields, with nulls too; optionally only where a condition holds."""
    s = side.select(*key, F.lit(True).alias("_has"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(s, key, "left")
    use = F.coalesce(F.col("_has"), F.lit(False)) & (F.lit(True) if only_if is None else F.coalesce(only_if, F.lit(False)))
    made = joined.withColumn("replaced", use)
    for f in fields:
        made = made.withColumn(f, F.when(use, F.col(f"_new_{f}")).otherwise(F.col(f)))
    return made.drop("_has", *[f"_new_{f}" for f in fields])


def lookup_children(parents: DataFrame, children: DataFrame, found: DataFrame, parent: list[str], child: list[str], fields: list[str]) -> DataFrame:
    """JOI08: children with looked-up fields, kept on a miss; parents with a miss are incomplete."""
    looked = children.join(found.select(*child, F.lit(True).alias("_hit"), *fields), child, "left")
    row = F.struct(F.col("position"), *[F.col(c) for c in child if c not in parent], *fields, F.coalesce("_hit", F.lit(False)).alias("found"))
    regrouped = looked.groupBy(*parent).agg(F.sort_array(F.collect_list(row)).alias("children"), F.bool_and(F.coalesce("_hit", F.lit(False))).alias("complete"))
    return parents.join(regrouped, parent, "left").withColumn("complete", F.coalesce("complete", F.lit(True)))


def at_ranks(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """AGG10-12: by and, for each name, the value at a place (from 0, of the number of values) of the group's sorted values.

    Equal values meet as counts before they are sorted, so a group's window holds its distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > place(F.col("_n")), F.col("_v"))).alias(name) for name, place in places.items()])
