"""Matching against brute force on small pages, and the reviewed cases."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from annolith.operators import graphs, matching


def iou(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0.0


def frame(spark, boxes):
    return spark.createDataFrame([(p, i, *b, 0.5) for p, i, b in boxes], "page bigint, id bigint, x1 int, y1 int, x2 int, y2 int, confidence double")


def test_optimal_beats_greedy(spark):
    h = frame(spark, [(1, 1, (0, 0, 10, 10)), (1, 2, (4, 0, 14, 10))])
    p = frame(spark, [(1, 11, (2, 0, 12, 10)), (1, 12, (0, 0, 6, 10))])
    pairs = matching.candidates(h, p, ["page"], 0.2)
    assert matching.greedy(pairs, ["page"], F.col("iou")).count() == 1
    assert {(r.a, r.b) for r in matching.optimal(pairs, ["page"]).collect()} == {(1, 12), (2, 11)}
    assert matching.most_pairs(pairs, ["page"]).count() == 2


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = {s: [(page, 10 * page + k, (x := r.randrange(8), y := r.randrange(8), x + r.randrange(2, 9), y + r.randrange(2, 9))) for page in range(40) for k in range(r.randrange(0, 5))] for s in "hp"}
    pairs = matching.candidates(frame(spark, rows["h"]), frame(spark, rows["p"]), ["page"], 0.2)
    greedy = {(x.page, x.a, x.b) for x in matching.greedy(pairs, ["page"], F.col("iou")).collect()}
    optimal = {(x.page, x.a, x.b): x.iou for x in matching.optimal(pairs, ["page"]).collect()}
    most = matching.most_pairs(pairs, ["page"]).groupBy("page").count().collect()
    most = {x.page: x["count"] for x in most}
    for page in range(40):
        h, p = ([(i, b) for q, i, b in rows[s] if q == page] for s in "hp")
        edges = {(i, j): iou(a, b) for i, a in h for j, b in p if iou(a, b) >= 0.2}
        used, want = set(), set()
        for (i, j), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
            if ("h", i) not in used and ("p", j) not in used:
                used |= {("h", i), ("p", j)}
                want.add((page, i, j))
        assert {g for g in greedy if g[0] == page} == want
        ids, others = [i for i, _ in h], [j for j, _ in p]
        best = (0, 0.0)
        for order in permutations(others + [None] * len(ids), len(ids)):
            chosen = [(i, j) for i, j in zip(ids, order) if (i, j) in edges]
            best = max(best, (len(chosen), sum(edges[c] for c in chosen)))
        own = [v for (q, _, _), v in optimal.items() if q == page]
        assert len(own) == best[0] and sum(own) == pytest.approx(best[1], abs=1e-6)
        assert most.get(page, 0) == best[0]


def test_suppression_and_empty_tables(spark):
    items = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 0, 11, 10, 0.8), (1, 3, 20, 20, 30, 30, 0.7)], "page bigint, id bigint, x1 int, y1 int, x2 int, y2 int, confidence double")
    assert [r.id for r in matching.suppressed(items, ["page"], 0.35).orderBy("place").collect()] == [1, 3]
    assert matching.fused(items, ["page"]).count() == 2
    none = items.where("false")
    pairs = matching.candidates(none, none, ["page"], 0.2)
    assert matching.optimal(pairs, ["page"]).count() == matching.greedy(pairs, ["page"], F.col("iou")).count() == matching.fused(none, ["page"]).count() == 0


def test_components_chain(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(30)] + [(2, 5, 6)], "page bigint, a bigint, b bigint")
    found = {(r.page, r.node): r.component for r in graphs.components(edges, ["page"]).collect()}
    assert set(found.values()) == {0, 5} and len(found) == 33
    assert graphs.pair_set(graphs.components(edges, ["page"]), ["page"]).where("page = 2").count() == 1


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(100)] + [(2, 7, 9)], "page int, a int, b int")
    found = {(r.page, r.node): r.component for r in graphs.components(edges, ["page"]).collect()}
    assert found == {**{(1, i): 0 for i in range(101)}, (2, 7): 7, (2, 9): 7}


def test_long_alternating_paths(spark):
    """Each box overlaps its own partner and the next one's; the last partner is free, so every box has to move over."""
    n = 1500
    edges = [(1, i, i + 1, 0.5, 0.5) for i in range(n)] + [(1, i, i, 0.9, 0.9) for i in range(n)] + [(1, n, 0, 0.9, 0.9)]
    pairs = spark.createDataFrame(edges, "page int, a bigint, b bigint, iou double, containment double")
    found = matching.most_pairs(pairs, ["page"]).collect()
    assert len(found) == n + 1 and len({r.a for r in found}) == len({r.b for r in found}) == n + 1


def test_counts_of_several_matchings(spark):
    """Both matchings of a page from one reading of its pairs count what each by itself keeps; ties and pages without pairs too."""
    r = random.Random(9)
    rows = {s: [(page, 10 * page + k, (x := r.randrange(4), y := r.randrange(4), x + r.randrange(2, 6), y + r.randrange(2, 6))) for page in range(60) for k in range(r.randrange(0, 6))] for s in "hp"}
    h, p = frame(spark, rows["h"]), frame(spark, rows["p"])
    lenient = F.greatest(F.col("iou"), F.col("containment") * 0.19)
    counts = matching.greedy_counts(matching.candidates(h, p, ["page"], 0.1, 0.95), ["page"], {"strict": F.when(F.col("iou") >= 0.2, F.col("iou")), "lenient": lenient}).collect()
    for name, pairs, score in (("strict", matching.candidates(h, p, ["page"], 0.2), F.col("iou")), ("lenient", matching.candidates(h, p, ["page"], 0.1, 0.95), lenient)):
        want = {x.page: x["count"] for x in matching.greedy(pairs, ["page"], score).groupBy("page").count().collect()}
        assert {x.page: x[name] for x in counts if x[name]} == want
    assert any(x.strict < x.lenient for x in counts)


def test_crossed_boxes_meet_as_before(spark):
    """Boxes without an area or with a missing side meet none; all other overlaps are those of the general intersection."""
    r = random.Random(11)
    side = lambda low: r.choice([None, *range(low, low + 4), *range(low, low + 4)])
    rows = {s: [(page, 10 * page + k, tuple(side(low) for low in (0, 0, 2, 2))) for page in range(50) for k in range(r.randrange(0, 6))] for s in "hp"}
    made = {(x.a, x.b): (x.iou, x.containment) for x in matching.candidates(frame(spark, rows["h"]), frame(spark, rows["p"]), ["page"], 0.1, 0.95).collect()}
    good = {s: [x for x in rows[s] if None not in x[2] and x[2][0] < x[2][2] and x[2][1] < x[2][3]] for s in "hp"}
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    want = {}
    for page, a, x in good["h"]:
        for other, b, y in good["p"]:
            inter = max(0, min(x[2], y[2]) - max(x[0], y[0])) * max(0, min(x[3], y[3]) - max(x[1], y[1]))
            part = inter / min(size(x), size(y))
            if page == other and (iou(x, y) >= 0.1 or part >= 0.95 and iou(x, y) >= 0.02):
                want[a, b] = iou(x, y), part
    assert made == want and len(want) > 10
