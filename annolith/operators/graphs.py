"""Small-world graphs inside pages: components, pair sets, merges by hand, overlap typing (SPA21-23; JOI19, MET14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import per_group


def components(edges: DataFrame, group: list[str]) -> DataFrame:
    """edges: group, a, b. group, node, component (its least node): sets are united along a page's edges, in one shuffle."""

    def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while above[root] != root:
                root = above[root]
            while above[x] != root:
                above[x], x = root, above[x]
            return root

        for a, b in rows:
            for x in (a, b):
                above.setdefault(x, x)
            low, high = sorted((top(a), top(b)))
            above[high] = low
        return [(x, top(x)) for x in sorted(above)]

    kind = edges.schema["a"].dataType.simpleString()
    schema = ", ".join(f"`{g}` {edges.schema[g].dataType.simpleString()}" for g in group) + f", node {kind}, component {kind}"
    return per_group(edges, group, ["a", "b"], ["a", "b"], solve, schema)


def merge_clusters(members: DataFrame, links: DataFrame, group: list[str]) -> DataFrame:
    """JOI19: clusters of a group united along links that people made, in the links' order.

    members: group, id, source, cluster. links: group, position, a, b (ids). A link is left out if an id is unknown, and it is
    refused if both clusters then hold one source. Gives group, id, source, before, cluster (from 1, a united cluster stands
    where its earlier one stood), manual (the links inside the cluster, refused ones not among them).
    """
    kind = {n: members.schema[n].dataType.simpleString() for n in (*group, "id", "source", "cluster")}
    none = F.lit(None)
    own = members.select(*group, F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_at"), F.col("id").alias("_a"), none.cast(kind["id"]).alias("_b"), "source", "cluster")
    asked = links.select(*group, F.lit(1).alias("_kind"), F.col("position").cast("bigint").alias("_at"), F.col("a").cast(kind["id"]).alias("_a"), F.col("b").cast(kind["id"]).alias("_b"), none.cast(kind["source"]).alias("source"), none.cast(kind["cluster"]).alias("cluster"))

    def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
        items = [r for r in rows if r[0] == 0]
        wanted = [(r[2], r[3]) for r in rows if r[0] == 1]
        names = sorted({r[5] for r in items})
        place = {name: i for i, name in enumerate(names)}
        home = {r[2]: place[r[5]] for r in items}
        above, sources = list(range(len(names))), [set() for _ in names]
        for r in items:
            sources[place[r[5]]].add(r[4])

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for a, b in wanted:
            if a not in home or b not in home:
                continue
            low, high = sorted((top(home[a]), top(home[b])))
            if low != high and sources[low].isdisjoint(sources[high]):
                above[high] = low
                sources[low] |= sources[high]
        number = {x: i + 1 for i, x in enumerate(sorted({top(i) for i in range(len(names))}))}
        inside = [0] * len(names)
        for a, b in wanted:
            if a in home and b in home and top(home[a]) == top(home[b]):
                inside[top(home[a])] += 1
        return [(r[2], r[4], r[5], number[top(place[r[5]])], inside[top(place[r[5]])]) for r in items]

    schema = ", ".join(f"`{g}` {kind[g]}" for g in group) + f", id {kind['id']}, source {kind['source']}, before {kind['cluster']}, cluster int, manual int"
    return per_group(own.unionByName(asked), group, ["_kind", "_at", "_a", "_b", "source", "cluster"], ["_kind", "_at", "_a", "_b"], solve, schema)


def pair_set(members: DataFrame, group: list[str]) -> DataFrame:
    """SPA21: group, a, b of all pairs inside components. Members of a page's component are few."""
    m = members.select(*group, "component", F.col("node").alias("a"))
    return m.join(m.withColumnRenamed("a", "b"), [*group, "component"]).where("a < b").select(*group, "a", "b")


def component_kind(humans: str = "humans", others: str = "others"):
    """SPA23: from the counts of both sides."""
    return F.expr(f"case when {humans} = 1 and {others} = 1 then 'one_to_one' when {humans} = 1 and {others} > 1 then 'split' when {humans} > 1 and {others} = 1 then 'merge' when {humans} > 1 and {others} > 1 then 'complex' when {humans} >= 1 then 'uncovered_human' else 'unmatched_predicted' end")


def pair_scores(proposed: DataFrame, gold: DataFrame, mapping: DataFrame, group: list[str]) -> DataFrame:
    """MET14: proposed, gold: group, a, b; mapping: group, proposed_id, gold_id. tp, fp, fn of pairs.

    A proposed pair without a counterpart counts against precision; only gold pairs that could be found count for recall.
    """
    m = mapping.select(*group, F.col("proposed_id").alias("a"), F.col("gold_id").alias("ga"))
    n = mapping.select(*group, F.col("proposed_id").alias("b"), F.col("gold_id").alias("gb"))
    placed = proposed.join(m, [*group, "a"], "left").join(n, [*group, "b"], "left")
    mapped = placed.where("ga is not null and gb is not null").select(*group, F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
    unmapped = placed.where("ga is null or gb is null").agg(F.count("*").alias("unmapped"))
    ids = mapping.select(*group, F.col("gold_id").alias("g"))
    possible = gold.join(ids.withColumnRenamed("g", "a"), [*group, "a"], "left_semi").join(ids.withColumnRenamed("g", "b"), [*group, "b"], "left_semi")
    keys = [*group, "a", "b"]
    tp = mapped.join(gold, keys, "left_semi").agg(F.count("*").alias("tp"))
    wrong = mapped.join(gold, keys, "left_anti").agg(F.count("*").alias("wrong"))
    fn = possible.join(mapped, keys, "left_anti").agg(F.count("*").alias("fn"))
    one = F.lit(1).alias("_k")
    out = tp.select("*", one).join(wrong.select("*", one), "_k").join(fn.select("*", one), "_k").join(unmapped.select("*", one), "_k")
    return out.select("tp", (F.col("wrong") + F.col("unmapped")).alias("fp"), "fn")
