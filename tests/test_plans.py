"""What the plans must and must not have."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest

import tollway.plans.queries as q
from tollway.operators.ordered import running, time_piece
from tollway.operators.vehicles import vehicle_state


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q.batch_queries()))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = _plan(q.batch_queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "Window [] []"):
        assert bad not in plan
    for line in plan.splitlines():
        assert not re.search(r"Exchange SinglePartition", line)


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    plan = _plan(q.batch_queries()["minute_speed"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(typ), EqualTo(typ,0)" in plan
    assert re.search(r"ReadSchema: struct<typ:int,time:bigint,vid:int,speed:int>", plan)


def test_vehicle_state_is_shuffled_once(spark, sf_dir):
    """Statistics, accidents and crossings read one shuffle of the reports."""
    path = q.live_path(spark, sf_dir)
    plan = _final_plan(path.tolls).split("== Initial Plan ==")[0]
    by_vehicle = r"Exchange hashpartitioning\(xway#\d+, dir#\d+, vid#\d+, \d+\)"
    lines = [line for line in plan.splitlines() if re.search(by_vehicle, line)]
    assert len(lines) == 3
    assert sum("ReusedExchange" in line for line in lines) == 2


def test_cut_groups_are_shuffled_once(spark, sf_dir):
    """The rows and what is carried between their pieces come from one shuffle."""
    path = q.live_path(spark, sf_dir)
    long = replace(path.params, horizon=None, piece_seconds=100)
    piece = r"Exchange hashpartitioning\([^)]*_piece#\d+"
    tolls = path.tolls.select("vid", "xway", "time", "toll")
    for df in (
        vehicle_state(path.reports, long),
        running(tolls, ["vid", "xway"], time_piece(long), ["time", "toll"], {"told": "toll"}),
    ):
        lines = [
            line
            for line in _final_plan(df).split("== Initial Plan ==")[0].splitlines()
            if re.search(piece, line)
        ]
        wide = [line for line in lines if "ReusedExchange" not in line]
        assert len(lines) >= 2 and len(lines) - len(wide) >= 1


def test_statistics_are_summed_before_the_shuffle(spark, sf_dir):
    plan = _plan(q.batch_queries()["segment_minute_stats"](spark, sf_dir))
    assert plan.index("functions=[sum(") < plan.index("hashpartitioning") < plan.index("partial_sum(")


def test_history_is_not_moved(spark, sf_dir):
    """Requests go to the buckets of the history; only they are shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _final_plan(q.live_path(spark, sf_dir).expenditures)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in final
    # nothing but the join and its sort between the scan of the history and the result
    history = final[final.index("SortMergeJoin") :].split("ReadSchema")[-2:]
    assert "toll" in final and "Exchange" not in history[-1]


def test_history_opens_in_its_buckets_again(spark, tmp_path):
    from tollway.schema import TOLL_HISTORY
    from tollway.sources.history import open_toll_history, store_toll_history

    rows = [(v, d, x, v + d) for v in range(30) for d in (1, 2) for x in (0, 1)]
    folder = str(tmp_path / "it's a history")
    history = spark.createDataFrame(rows, TOLL_HISTORY)
    assert sorted(map(tuple, store_toll_history(history, folder, 6).collect())) == sorted(rows)
    spark.sql("DROP TABLE " + next(t.name for t in spark.catalog.listTables() if t.name.startswith("toll_history")))
    again = open_toll_history(spark, folder, 6)
    assert sorted(map(tuple, again.collect())) == sorted(rows)
