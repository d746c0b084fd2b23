"""Hand-written cases of the tolling rules."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from traffic import as_frame, random_traffic, report, request
from walk import walk

from tollway.functions import affected_segments, toll_amount
from tollway.operators import accidents as acc
from tollway.operators import reports as rep
from tollway.operators import segments as seg
from tollway.operators import tolls as tol
from tollway.operators import vehicles as veh
from tollway.plans.live import LivePath, measured
from tollway.schema import SEGMENT, TOLL_HISTORY, Params
from tollway.sources import history as his
from tollway.sources import lines as lin

STOP = (0, 2, 1, 49, 258_725)  # xway, lane, dir, segment, position


def _state(spark, events, params=Params()):
    return veh.vehicle_state(rep.position_reports(as_frame(spark, events)), params)


def _stand(vid, first, reports=4):
    return [report(first + 30 * i, vid, 0, *STOP) for i in range(reports)]


def _path(spark, events, params=Params()):
    return LivePath(as_frame(spark, events), spark.createDataFrame([], TOLL_HISTORY), params)


def test_fourth_equal_report_is_stopped(spark):
    rows = _state(spark, _stand(260, 61)).orderBy("time").collect()
    assert [r.is_stopped for r in rows] == [False, False, False, True]
    assert [r.is_crossing for r in rows] == [True, False, False, False]
    assert [r.stop_began for r in rows] == [False, False, False, True]
    assert (rows[3].last_lane, rows[3].last_position) == (2, 258_725)


def test_stop_ends_at_the_next_differing_report(spark):
    events = [*_stand(1, 0, 6), report(180, 1, 30, 0, 2, 1, 49, 258_800)]
    state = _state(spark, events)
    stops = veh.stop_intervals(veh.stop_changes(state)).collect()
    assert [(s.begin_time, s.end_time) for s in stops] == [(90, 180)]
    open_stops = veh.stop_intervals(veh.stop_changes(_state(spark, events[:-1]))).collect()
    assert [(s.begin_time, s.end_time) for s in open_stops] == [(90, None)]


def test_a_change_of_lane_or_road_is_no_stop(spark):
    moved = [*_stand(1, 0, 3), report(90, 1, 0, 0, 3, 1, 49, 258_725)]
    assert not _state(spark, moved).where("is_stopped").count()
    other_road = [*_stand(1, 0, 3), report(90, 1, 0, 1, 2, 1, 49, 258_725)]
    reports = rep.position_reports(as_frame(spark, other_road))
    assert not veh.vehicle_state(reports).where("is_stopped").count()
    assert not veh.stop_detection(reports).where("is_stopped").count()
    # back on the first road: the stop there goes on, but not for all roads together
    back = [*other_road, report(120, 1, 0, *STOP)]
    reports = rep.position_reports(as_frame(spark, back))
    assert [r.time for r in veh.vehicle_state(reports).where("is_stopped").collect()] == [120]
    assert not veh.stop_detection(reports).where("is_stopped").count()


def test_first_report_after_the_exit_lane_crosses(spark):
    events = [
        report(0, 1, 40, 0, 1, 0, 10, 52_800),
        report(30, 1, 40, 0, 4, 0, 10, 53_000),
        report(60, 1, 40, 0, 0, 0, 10, 53_100),
        report(90, 1, 40, 0, 1, 0, 10, 53_200),
    ]
    rows = _state(spark, events).orderBy("time").collect()
    assert [r.is_crossing for r in rows] == [True, False, True, False]
    assert veh.segment_crossings(_state(spark, events)).count() == 2


def test_accident_counts_from_the_next_minute_through_the_one_it_clears_in(spark):
    events = [*_stand(260, 0, 10), *_stand(261, 5, 6), report(185, 261, 20, 0, 2, 1, 49, 258_800)]
    # westbound traffic comes from higher segments
    for i, t in enumerate([96, 125, 200, 239, 240]):
        events.append(report(t, 300 + i, 34, 0, 2, 1, 52, 274_560))
    events.append(report(125, 400, 34, 0, 2, 1, 54, 285_120))  # five segments off
    path = _path(spark, events)
    found = path.accidents.collect()
    assert [(a.segment, a.created_minute, a.cleared_minute) for a in found] == [(49, 2, 4)]
    seen = {r.vid: r.accident_segment for r in acc.accident_lookup(path.state, path.accidents).collect() if r.vid >= 300}
    assert seen == {300: -1, 301: 49, 302: 49, 303: 49, 304: -1, 400: -1}


def test_accident_that_never_clears_and_a_second_one(spark):
    events = [*_stand(1, 0, 5), *_stand(2, 0, 5)]
    events += [report(150, v, 20, 0, 2, 1, 49, 258_800) for v in (1, 2)]
    events += [*_stand(3, 600, 5), *_stand(4, 600, 5)]
    found = _path(spark, events).accidents.orderBy("created_minute").collect()
    assert [(a.created_minute, a.cleared_minute) for a in found] == [(2, 3), (12, None)]


def test_one_vehicle_standing_long_is_no_accident(spark):
    assert not _path(spark, _stand(1, 0, 40)).accidents.count()


def test_nearest_and_lowest_accident_differ(spark):
    events = []
    for base, segment in ((10, 47), (20, 49)):
        for vid in (base, base + 1):
            events += [report(30 * i, vid, 0, 0, 2, 1, segment, segment * 5280) for i in range(9)]
    events.append(report(200, 99, 30, 0, 2, 1, 50, 264_000))
    path = _path(spark, events)
    nearest = acc.accident_lookup(path.state, path.accidents).where("vid = 99").first()
    lowest = acc.accident_lookup_lowest(path.state, path.accidents).where("vid = 99").first()
    assert (nearest.accident_segment, lowest.accident_segment) == (49, 47)


def test_vehicles_standing_at_a_place(spark):
    events = [*_stand(1, 0, 8), *_stand(2, 10, 8), report(240, 1, 9, 0, 2, 1, 49, 258_900)]
    events.append(report(215, 3, 9, 0, 2, 1, 49, 258_725))
    path = _path(spark, events)
    rows = acc.stopped_at_place(path.state, path.stop_changes).collect()
    at = {(r.vid, r.time): r.standing for r in rows}
    assert len(rows) == len(events)
    assert (at[1, 60], at[1, 90], at[2, 100], at[3, 215], at[1, 240]) == (0, 1, 2, 2, 0)


def test_report_count_of_a_minute(spark):
    rows = [(30, 77, 10_558), (38, 78, 10_454), (14, 79, 10_435), (1, 80, 10_258)]
    events = [report(t, v, 25, 0, 2, 1, 1, p) for t, v, p in rows]
    got = seg.segment_minute_report_count(rep.position_reports(as_frame(spark, events))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1, 4)]


def test_lav_rounds_half_up_and_skips_its_own_minute(spark):
    events = [report(t, v, s, 0, 1, 0, 5, 26_400) for t, v, s in [(0, 1, 20), (10, 2, 21), (70, 3, 90)]]
    got = {r.minute: (r.lav, r.nov) for r in _path(spark, events).conditions.collect()}
    assert got == {1: (0, 0), 2: (21, 2)}


@pytest.mark.parametrize(
    "lav,nov,accident,toll",
    [(39, 51, False, 2), (40, 51, False, 0), (39, 50, False, 0), (10, 60, True, 0), (0, 150, False, 20_000)],
)
def test_toll_amount(spark, lav, nov, accident, toll):
    row = spark.range(1).select(toll_amount(F.lit(lav), F.lit(nov), F.lit(accident)).alias("t"))
    assert row.first().t == toll


def test_affected_segments_stay_on_the_road(spark):
    rows = spark.createDataFrame([(2, 0), (50, 0), (97, 1), (50, 1)], "s int, d int")
    got = [r[0] for r in rows.select(affected_segments("s", "d")).collect()]
    assert got == [[2, 1, 0], [50, 49, 48, 47, 46], [97, 98, 99], [50, 51, 52, 53, 54]]


def test_balance_leaves_out_the_last_toll(spark):
    tolls = spark.createDataFrame(
        [(1, 0, 10, 5), (1, 0, 20, 7), (1, 1, 15, 100), (1, 0, 30, 0)],
        "vid int, xway int, time bigint, toll bigint",
    )
    asked = [(1, 0, t, f"q{t}") for t in (9, 10, 20, 25, 30)] + [(2, 0, 50, "other")]
    requests = spark.createDataFrame(asked, "vid int, xway int, time bigint, qid string")
    got = {r.qid: r.balance for r in tol.account_balance(tolls, requests).collect()}
    assert got == {"q9": 0, "q10": 0, "q20": 5, "q25": 5, "q30": 12, "other": 0}


def test_daily_expenditure_without_history_is_null(spark):
    history = spark.createDataFrame([(1, 3, 0, 9)], TOLL_HISTORY)
    events = [request(3, 5, 1, 0, "a", 3), request(3, 6, 1, 0, "b", 4), request(3, 7, 1, 1, "c", 3)]
    asked = rep.expenditure_requests(as_frame(spark, events))
    got = {r.qid: r.toll for r in tol.daily_expenditure(asked, history).collect()}
    assert got == {"a": 9, "b": None, "c": None}
    assert [r.qid for r in tol.historical_balances(asked, history).orderBy("qid").collect()] == ["a", "c"]


def test_trips_split_at_a_gap_of_the_whole_minute(spark):
    times = [0, 30, 89, 149, 500]
    events = [report(t, 1, 30, 0, 1, 0, 0, t) for t in times]
    trips = veh.vehicle_trips(rep.position_reports(as_frame(spark, events))).orderBy("begin_time")
    assert [(t.begin_time, t.end_time, t.reports) for t in trips.collect()] == [
        (0, 89, 3),
        (149, 149, 1),
        (500, 500, 1),
    ]


def test_parsing(spark):
    good = "0,61,260,60,0,2,1,49,258725,-1,-1,-1,-1,-1,-1"
    lines = [good, f"  {good} ", "", "   ", "0,1,2", good.replace("260", "x"), "2,5,1,-1,0,-1,-1,-1,-1,7,,,,,0"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    parsed = lin.parse_events(df).collect()
    assert Counter(r.typ for r in parsed) == {0: 2, 2: 1}
    bad = {r.value: r.bad_field for r in lin.parse_rejects(df).collect()}
    assert bad == {"0,1,2": "speed", good.replace("260", "x"): "vid"}


def test_lines_off_the_road_are_rejected(spark):
    good = "0,61,260,60,0,2,1,49,258725,-1,-1,-1,-1,-1,-1"
    bad = {
        good.replace(",1,49,", ",1,100,"): "segment",
        good.replace(",1,49,", ",0,-1,"): "segment",
        good.replace(",1,49,", ",2,49,"): "dir",
        good.replace(",0,2,1,", ",0,5,1,"): "lane",
        good.replace("0,61,", "0,-1,"): "time",
    }
    df = spark.createDataFrame([(v,) for v in [good, *bad]], "value string")
    assert lin.parse_events(df).count() == 1
    assert {r.value: r.bad_field for r in lin.parse_rejects(df).collect()} == bad


@pytest.mark.parametrize("direction", [0, 1])
def test_warned_segments_are_told_for_any_segment(spark, direction):
    df = spark.createDataFrame([(s,) for s in (-1, 0, 2, 49, 98, 99, 100, 120)], "s int")
    step = 1 if direction else -1
    for r in df.select("s", affected_segments("s", F.lit(direction)).alias("a")).collect():
        there = [r.s + step * k for k in range(5)] if 0 <= r.s <= 99 else []
        assert r.a == [s for s in there if 0 <= s <= 99]


def test_a_vehicle_standing_off_the_road_warns_nobody(spark):
    off = (0, 2, 1, 120, 640_000)
    rows = [report(61 + 30 * i, v, 0, *off) for v in (1, 2) for i in range(6)]
    assert _path(spark, rows).alerts.count() == 0


def test_history_is_unique_and_bad_lines_are_told(spark, tmp_path):
    (tmp_path / "h.csv").write_text("1,2,0,7\n1,2,0,9\n 1,2,0,9\n\n1,x,0,7\n1,2\n1,3,0,4\n1,2,3,4,5\n")
    got = his.read_toll_history(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0, 9), (1, 3, 0, 4)]
    bad = his.toll_history_rejects(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in bad) == ["1,2", "1,2,3,4,5", "1,x,0,7"]


def test_line_round_trip(spark):
    events = as_frame(spark, random_traffic(5, vehicles=5))
    back = lin.parse_events(lin.format_lines(events)).drop("ingest_ms")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, events.collect()))


def test_copies_are_dropped_and_conflicts_settled_alike(spark):
    one = report(0, 1, 30, 0, 1, 0, 0, 10)
    other = {**one, "speed": 29}
    ask = [request(2, 0, 1, 0, q) for q in ("a", "b")]
    for order in ([one, other, *ask, one], [other, one, one, *ask]):
        got = lin.distinct_events(as_frame(spark, order)).collect()
        assert sorted((r.typ, r.qid, r.speed) for r in got) == [(0, "-1", 29), (2, "a", -1), (2, "b", -1)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cut", [False, True])
def test_live_path_agrees_with_a_walk_over_the_events(spark, seed, cut):
    events = random_traffic(seed)
    params = replace(measured(as_frame(spark, events)), free_vehicles=8)
    if cut:
        params = replace(params, piece_seconds=100, piece_minutes=6)
    path = _path(spark, events, params)
    want = walk(events, params.free_vehicles)
    assert sum(t[8] > 0 for t in want["tolls"]) > 20 and any(t[7] >= 0 for t in want["tolls"])
    assert any(b[4] > 0 for b in want["balances"])
    columns = ["vid", "time", *SEGMENT, "lav", "nov", "accident_segment", "toll"]
    assert sorted(map(tuple, path.tolls.select(*columns).collect())) == want["tolls"]
    got = path.balances.select("vid", "time", "xway", "qid", "balance").collect()
    assert sorted(map(tuple, got)) == want["balances"]


def test_one_vehicle_with_a_third_of_all_reports(spark):
    """A long-lived vehicle is cut into pieces and still counted as one."""
    events = [report(30 * i, 7, i % 50, 0, 1, 0, (i // 9) % 100, (i // 9) % 100 * 5280) for i in range(600)]
    for vid in range(100, 220):
        events += [report(30 * i, vid, 20, 0, 2, 0, i, i * 5280) for i in range(10)]
    whole, cut = (
        _path(spark, events, p)
        for p in (
            measured(as_frame(spark, events)),
            replace(Params(), piece_seconds=300, piece_minutes=10),
        )
    )
    for name in ("state", "accidents", "conditions", "tolls"):
        a, b = getattr(whole, name), getattr(cut, name)
        assert a.columns == b.columns
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_copies_do_not_count(spark):
    """A report sent many times over is one report, not a standing vehicle."""
    events = random_traffic(7, vehicles=30, steps=8)
    copied = [*events, *[events[5]] * 300, *events[:40]]
    once, many = _path(spark, events), _path(spark, copied)
    for name in ("state", "tolls", "balances"):
        a, b = getattr(once, name), getattr(many, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_invariants(spark):
    path = _path(spark, random_traffic(3))
    assert path.tolls.count() == path.crossings.count()
    vehicles = path.reports.select("vid").distinct().count()
    assert path.conditions.agg(F.max("nov")).first()[0] <= vehicles
    falls = (
        path.balances.alias("a")
        .join(path.balances.alias("b"), ["vid", "xway"])
        .where("a.time < b.time AND a.balance > b.balance")
    )
    assert falls.isEmpty()
