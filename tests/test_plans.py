"""Plan-shape guards: the scale properties the README claims, checked on the
executed (adaptive, final) plans of frames that were really collected."""

import pytest

from reachkit import gen_people_table, generate_reach_table
from reachkit.plans.catalog import QUERIES
from reachkit.sources import census_from_customers, line_impressions
from tests.conftest import SF_SMALL


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan.split("\n+- == Initial Plan")[0]  # subqueries keep theirs


def test_building_any_query_starts_no_job(spark):
    group = "build-only"
    spark.sparkContext.setJobGroup(group, "queries are lazy")
    try:
        for make in QUERIES.values():
            make(spark, SF_SMALL)
        # reading a Parquet footer for its schema is the only thing Spark itself runs
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        names = [spark.sparkContext._jsc.sc().statusStore().job(j).name() for j in jobs]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert all(name.startswith("parquet at") for name in names), names


@pytest.mark.parametrize("name", ["assign_uid_time", "assign_weighted", "assign_uid_time_segment", "assign_uid_segment_cells",
                                  "pool_info", "pool_info_segment"])
def test_no_nested_loop_or_cartesian_joins(spark, name):
    plan = final_plan(QUERIES[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("demos, mode", [(None, "count"), (["age_range"], "count"), (["age_range"], "weighted")])
def test_reach_builds_the_slot_table_once(spark, demos, mode):
    """One scan feeds the first exposures and the slots; the prefix sum's second use is reused."""
    plan = final_plan(generate_reach_table(line_impressions(spark, SF_SMALL), demo_cols=demos, mode=mode))
    assert plan.count("FileScan parquet [l_orderkey") == 1
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["vid_reach_count", "vid_reach_segment", "pool_info", "pool_info_segment"])
def test_the_assignment_runs_once(spark, name):
    plan = final_plan(QUERIES[name](spark, SF_SMALL))
    lines = [line for line in plan.splitlines() if "FileScan parquet" in line and "ts#" in line]
    assert len(lines) == 1, plan


def test_segmented_flow_fits_once(spark):
    plan = final_plan(QUERIES["flow_segment"](spark, SF_SMALL))
    # the reach over VIDs reads the assignment once, through one model table
    nodes = [line for line in plan.splitlines() if "MapInPandas" in line]
    assert len(nodes) == 1
    table = final_plan(QUERIES["fit_recovery_segment"](spark, SF_SMALL))
    assert sum("MapInPandas" in line for line in table.splitlines()) == 1


def test_fit_never_groups_points(spark):
    plan = final_plan(QUERIES["fit_total"](spark, SF_SMALL))
    assert "FlatMapGroups" not in plan and "partial_sum" in plan


def test_person_offsets_never_order_all_segments_in_one_task(spark):
    for demos in (["age_range"], ["gender", "age_range"]):
        plan = final_plan(gen_people_table(census_from_customers(spark, SF_SMALL, demos), demos))
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("__range" in line for line in windows)
