"""Plans and helpers that keep memory and time level on large tables."""

import pyarrow as pa
import pytest

import annolith.plans  # noqa: F401
from annolith.operators import streams
from annolith.plans import registry
from annolith.plans.inventory import manual_links
from annolith.plans.spatial import accepted


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_case_kinds_read_faces_once(spark, sf):
    """One hash aggregation of whole numbers: no rows are sorted in a task to find the greatest."""
    made = plan(registry.queries()["met33_case_kinds"](spark, sf))
    assert made.count("FileScan") == 1 and "SortAggregate" not in made and "ObjectHashAggregate" not in made


@pytest.mark.parametrize("name", ["smp16_page_bootstrap", "smp17_matching_bootstrap", "smp19_two_samples"])
def test_page_sums_are_made_once(spark, sf, name):
    """Estimates and draws read the stored sums of pages: nothing of the plan reads, pairs or matches faces again."""
    made = plan(registry.queries()[name](spark, sf))
    assert "lineitem" not in made and "SortMergeJoin [image_id" not in made and "page-sums" in made


def test_pair_joins_are_compiled(spark, sf):
    """The JVM interprets methods of over 8,000 bytes of bytecode, for good: a join of boxes must stay below."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        for least, contained in ((0.1, 0.95), (0.2, None), (0.0, None)):
            made = accepted(spark, sf, least, contained)._jdf.queryExecution().executedPlan()
            found = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(made)
            sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
            assert len(sizes) >= 5 and max(sizes) < 8000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_manual_links_are_numbered_in_place(spark, sf):
    assert "collect_list" not in plan(manual_links(spark, sf))


def test_values_of_columns():
    for values, kind in (([3, None, -(2**62)], pa.int64()), ([1.5, None, float("inf")], pa.float64()), (["a", None, "é"], pa.string()), ([True, None], pa.bool_()), ([1, 2], pa.int32())):
        assert streams._values(pa.array(values, kind)) == values
