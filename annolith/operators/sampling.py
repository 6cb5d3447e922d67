"""Samples, allocations, orders and bootstraps (SMP; each function names its items).

Random choices are hashes of a seed and the row's id, so a sample doesn't depend on partitions and can be replayed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import draws


def hash_key(seed: object, *ids: Column) -> Column:
    """SMP01, SMP02: the sort key of a stable sample."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]), 256)


def first_by_hash(rows: DataFrame, by: list[str], key: str, n: int | Column, seed: object) -> DataFrame:
    """SMP01, SMP06, SMP11, WIN04, WIN05: n rows of each group by hash (n may be a column); adds ``place``."""
    w = Window.partitionBy(*by).orderBy(hash_key(seed, F.col(key)), key)
    out = rows.withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= n)


def hamilton(strata: DataFrame, by: list[str], size: str, total: Column | str, order: str) -> DataFrame:
    """SMP03: whole shares of a total by largest remainder; ties go to the earlier stratum. strata: one row each.

    by: columns within which a total is shared out (none: all strata); the strata table is small by nature.
    """
    inside = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    goal = F.expr(total) if isinstance(total, str) else total
    share = goal * F.col(size) / F.sum(size).over(inside)
    rows = strata.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    rows = rows.withColumn("_left", goal - F.sum("_floor").over(inside))
    place = F.row_number().over(inside.orderBy(F.desc(F.col("_share") - F.col("_floor")), order))
    return rows.withColumn("quota", (F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)).cast("bigint")).drop("_share", "_floor", "_left")


def hamilton_with_minimum(strata: DataFrame, by: list[str], size: str, total: int, least: int, order: str) -> DataFrame:
    """SMP04, SMP05: as hamilton, but no stratum gets fewer than ``least`` (or than it holds); shares never exceed size.

    Strata below their minimum get it and leave the sharing, again and again: sequential over a small table of strata.
    """
    schema = StructType([*strata.schema.fields, StructField("quota", LongType())])

    def allot(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        sizes = rows[size].to_numpy()
        floor = [min(least, int(s)) for s in sizes]
        fixed: set[int] = set()
        while True:
            free = [i for i in range(len(sizes)) if i not in fixed]
            left = total - sum(floor[i] for i in fixed)
            whole = sum(sizes[i] for i in free)
            share = {i: left * sizes[i] / whole if whole else 0.0 for i in free}
            low = [i for i in free if share[i] < floor[i]]
            if not low:
                break
            fixed.update(low)
        quota = {**{i: floor[i] for i in fixed}, **{i: int(share[i]) for i in free}}
        spare = total - sum(quota.values())
        for i in sorted(free, key=lambda k: (-(share[k] - int(share[k])), k))[: max(0, spare)]:
            quota[i] += 1
        return rows.assign(quota=[min(quota[i], int(sizes[i])) for i in range(len(sizes))])

    return strata.groupBy(*by).applyInPandas(allot, schema)


def round_robin(rows: DataFrame, by: list[str], key: str, seed: object) -> DataFrame:
    """SMP10: places that go round the cells, each cell by hash, cells by the hash of their name."""
    w = Window.partitionBy(*by).orderBy(hash_key(seed, F.col(key)), key)
    return rows.withColumn("turn", F.row_number().over(w)).withColumn("cell", hash_key(seed, *map(F.col, by)))


def deficit_order(rows: DataFrame, stratum: str, key: str, seed: object) -> DataFrame:
    """SMP07: key, stratum, place: a schedule in which each next place goes to the stratum furthest behind its share (ties to
    the smaller stratum), a stratum's rows by hash.

    The order of strata depends on their sizes alone. It is made from the counts, as a stream of (stratum, turn, place), and
    rows join it by their turn in their stratum; no row passes through a common group.
    """
    w = Window.partitionBy(stratum).orderBy(hash_key(seed, F.col(key)), key)
    turns = rows.where(F.col(stratum).isNotNull()).select(key, stratum, F.row_number().over(w).cast("bigint").alias("_turn"))
    sizes = rows.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("_n"))
    kind = StructType([sizes.schema[stratum], StructField("_turn", LongType()), StructField("place", LongType())])

    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sorted(x for batch in batches for x in zip(batch[stratum].to_pylist(), batch["_n"].to_pylist(), strict=True))
        total, taken, out = sum(n for _, n in counts), dict.fromkeys((s for s, _ in counts), 0), []
        share = {s: n / total for s, n in counts}
        for position in range(1, total + 1):
            s = min((s for s, n in counts if taken[s] < n), key=lambda s: (-(position * share[s] - taken[s]), s))
            taken[s] += 1
            out.append((s, taken[s], position))
            if len(out) == 50_000:
                yield _columns(out, kind)
                out = []
        yield _columns(out, kind)

    order = sizes.coalesce(1).mapInArrow(schedule, kind)  # a row for each stratum
    return turns.join(order, [stratum, "_turn"]).select(key, stratum, "place")


def _columns(rows: list[tuple], kind: StructType) -> pa.RecordBatch:
    target = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)


def choose_balanced(rows: DataFrame, n: int, key: str, page: str, fields: list[str], selected: DataFrame | None = None) -> DataFrame:
    """SMP21: n rows, one after the other: each time that with the least (chosen rows of its page, of its first field's value,
    of the next one's, ...), ties by hash of page and key. Counts begin with the rows already selected. rows with ``place``
    (from 1); fewer than n rows are an error.

    Only rows that can be chosen are compared: of those whose fields and count of selected rows of their page are equal, the
    first n by (turn among such rows of their page, tie). Any later one has n rows before it, of which one is always better:
    a page that has fallen behind it has taken as many of the n places as it holds rows before it. So n times the number of
    such cells are compared, wherever the rows lie.
    """
    tie = F.sha2(F.concat_ws("::", F.col(page).cast("string"), F.col(key).cast("string")), 256)
    before = None if selected is None else selected.groupBy(page).agg(F.count("*").alias("_had"))
    own = rows.withColumn("_tie", tie)
    own = own.withColumn("_had", F.lit(0).cast("bigint")) if before is None else own.join(before, page, "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy(page, *fields).orderBy("_tie", key))
    cell = F.row_number().over(Window.partitionBy("_had", *fields).orderBy("_turn", "_tie", key))
    short = own.select(key, page, *fields, "_had", "_tie", turn.alias("_turn")).where(F.col("_turn") <= n).withColumn("_cell", cell).where(F.col("_cell") <= n)
    counts = {f: {} if selected is None else {r[f]: r["n"] for r in selected.groupBy(f).agg(F.count("*").alias("n")).collect()} for f in fields}  # a row for each label
    kind = StructType([rows.schema[key], rows.schema[page], StructField("place", LongType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [key, page, *fields, "_had", "_tie"]
        given = [r for batch in batches for r in zip(*(batch[c].to_pylist() for c in columns), strict=True)]
        pages, labels = {r[1]: r[-2] for r in given}, [dict(counts[f]) for f in fields]
        now = lambda r: (pages[r[1]], *(have.get(v, 0) for have, v in zip(labels, r[2:-2], strict=True)), r[-1], r[0])
        heap = [(now(r), i) for i, r in enumerate(given)]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < n:
            rank, i = heapq.heappop(heap)
            r = given[i]
            if (fresh := now(r)) != rank:  # counts only grow, so a row only falls back
                heapq.heappush(heap, (fresh, i))
                continue
            out.append((r[0], r[1], len(out) + 1))
            pages[r[1]] += 1
            for have, v in zip(labels, r[2:-2], strict=True):
                have[v] = have.get(v, 0) + 1
        if len(out) < n:
            raise ValueError(f"only {len(out)} of {n} rows could be chosen")
        yield _columns(out, kind)

    chosen = short.coalesce(1).mapInArrow(choose, kind)
    return rows.join(chosen, [key, page])


def balanced_order(rows: DataFrame, group: str, key: str, done: DataFrame, seed: object) -> DataFrame:
    """SMP08: rows after a done prefix, so that the groups' counts stay level: the k-th of a group that had c before comes
    at (c + k, group)."""
    w = Window.partitionBy(group).orderBy(hash_key(seed, F.col(key)), key)
    before = done.groupBy(group).agg(F.count("*").alias("had"))
    return rows.join(done.select(key), key, "left_anti").withColumn("k", F.row_number().over(w)).join(before, group, "left").withColumn("level", F.coalesce("had", F.lit(0)) + F.col("k")).drop("k", "had")


def promoted(rows: DataFrame, key: str, order: str, prefix: int, chosen: DataFrame) -> DataFrame:
    """SMP09: a fixed prefix, then the chosen rows in their own order, then the rest; adds ``tier``."""
    marked = rows.join(chosen.select(F.col(key), F.col("rank").alias("_rank")), key, "left")
    tier = F.when(F.col(order) < prefix, 0).when(F.col("_rank").isNotNull(), 1).otherwise(2)
    return marked.withColumn("tier", tier).withColumn("within", F.when(tier == 1, F.col("_rank")).otherwise(F.col(order))).drop("_rank")


def bootstrap_weights(clusters: DataFrame, cluster: str, stratum: str, replicates: int, width: int = draws.WIDTH) -> DataFrame:
    """SMP12: replicate, stratum, cluster, weight: as many draws with replacement in each stratum as it has clusters.

    clusters: one row each. Rows made are clusters times replicates, not data rows times replicates; they leave the tasks that
    add up the draws, and only the draws are shuffled.
    """
    places = draws.placed(clusters, stratum, cluster)
    rows = places.select("_place", F.col(stratum).alias("_of"), F.col(cluster).alias("_cluster"))
    fields = [("replicate", IntegerType()), (stratum, clusters.schema[stratum].dataType), (cluster, clusters.schema[cluster].dataType), ("weight", LongType())]
    kind = StructType([StructField(name, t) for name, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for groups, replicate, weights in draws.drawn(batches, [], width):
            if groups is not last:
                last, own = groups, groups[0][1].combine_chunks()
                at = own["_at"].to_numpy()
            weight = weights[at]
            hit = np.flatnonzero(weight)
            columns = [pa.array(np.full(len(hit), replicate, np.int32)), *(own[k].chunk(0).take(pa.array(hit)) for k in ("_of", "_cluster")), pa.array(weight[hit])]
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    dealt = draws.dealt(rows, places, stratum, [], replicates, "", width)
    return dealt.mapInArrow(lambda batches: draws.gathered(run(batches)), kind)


def weighted_ratios(sums: DataFrame, weights: DataFrame, cluster: list[str], by: list[str], num: str = "num", den: str = "den") -> DataFrame:
    """SMP13, SMP16: sums: by, cluster, num, den. by, replicate, value. Data is summed to clusters before it meets weights."""
    return sums.join(weights, cluster).groupBy(*by, "replicate").agg((F.sum(F.col("weight") * F.col(num)) / F.nullif(F.sum(F.col("weight") * F.col(den)), F.lit(0))).alias("value"))


def interval(series: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Linear percentiles, as SMP13 has them."""
    return series.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), F.count(value).alias("replicates"))


def paired_delta(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """SMP14, SMP18, SMP20: b minus a on common draws."""
    keys = [*by, "replicate"]
    return a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), keys).select(*keys, (F.col("vb") - F.col("va")).alias("value"))
