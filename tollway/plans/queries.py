"""The registered batch queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.operators import accidents as acc
from tollway.operators import reports as rep
from tollway.operators import segments as seg
from tollway.operators import tolls as tol
from tollway.operators import vehicles as veh
from tollway.operators import words as wrd
from tollway.plans.live import LivePath, measured
from tollway.schema import Params
from tollway.sources import lines as lin
from tollway.sources import roads
from tollway.sources.history import tolls_by_vehicle

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}


_params: dict[tuple[str, str], Params] = {}


def live_path(spark: SparkSession, sf_dir: str) -> LivePath:
    events = roads.road_events(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _params:
        _params[key] = measured(events)
    history = roads.road_history_table(spark, sf_dir)
    # the projection numbers a user's events, so no two reports of theirs have one time
    return LivePath(events, history, _params[key], has_copies=False)


def _on_lines(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _queries[name] = lambda spark, sf_dir: build(roads.road_lines(spark, sf_dir))


def _on_history(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _queries[name] = lambda spark, sf_dir: build(roads.road_history(spark, sf_dir))


def _on_path(name: str, build: Callable[[LivePath], DataFrame]) -> None:
    _queries[name] = lambda spark, sf_dir: build(live_path(spark, sf_dir))


def batch_queries() -> dict[str, Query]:
    return dict(_queries)


# Sources and parsing
_on_lines("parse_events", lambda lines: lin.parse_events(lines).drop("ingest_ms"))
_on_lines("parse_rejects", lin.parse_rejects)
_on_lines(
    "distinct_events", lambda lines: lin.distinct_events(lin.parse_events(lines).drop("ingest_ms"))
)
_on_history("toll_history_scan", lambda history: history)
_on_history("toll_history_by_vehicle", tolls_by_vehicle)

# Selections
_on_path("position_reports", lambda p: p.reports)
_on_path("toll_path_events", lambda p: rep.toll_path_events(p.events))
_on_path("travel_lane_reports", lambda p: rep.travel_lane_reports(p.reports))
_on_path(
    "event_time",
    lambda p: rep.with_event_time(p.events).select(
        "typ", "vid", "time", "xway", F.unix_seconds("event_ts").alias("event_second")
    ),
)

# Vehicles
_on_path("vehicle_state", lambda p: p.state)
_on_path("segment_crossings", lambda p: p.crossings)
_on_path("stopped_vehicles", lambda p: veh.stopped_vehicles(p.state))
_on_path("stop_intervals", lambda p: veh.stop_intervals(p.stop_changes, p.params))
_on_path("stop_detection", lambda p: veh.stop_detection(p.reports, p.params))
_on_path("vehicle_trips", lambda p: veh.vehicle_trips(p.reports, p.params))
_on_path("trip_reports", lambda p: veh.trip_reports(p.reports, p.params))

# Accidents
_on_path("stopped_at_place", lambda p: acc.stopped_at_place(p.state, p.stop_changes, p.params))
_on_path("accidents_by_segment", lambda p: p.accidents)
_on_path("accidents_by_position", lambda p: acc.accidents_by_position(p.stop_changes, p.params))
_on_path("accident_lookup", lambda p: acc.accident_lookup(p.state, p.accidents, p.params))
_on_path(
    "accident_lookup_lowest",
    lambda p: acc.accident_lookup_lowest(p.state, p.accidents, p.params),
)
_on_path("accident_alerts", lambda p: p.alerts)


def _accident_minutes(p: LivePath) -> DataFrame:
    spots = acc.accidents(p.stop_changes, acc.SEGMENT_POSITION, p.params)
    return acc.accident_minutes(p.state, spots, p.params)


_on_path("accident_minutes", _accident_minutes)
_on_path("accident_minute_lookup", lambda p: acc.accident_minute_lookup(p.state, p.params))

# Segments
_on_path("segment_minute_stats", lambda p: p.stats)
_on_path("nov", lambda p: seg.nov(p.stats, p.params))
_on_path("lav", lambda p: seg.lav(p.stats, p.params))
_on_path("nov_distinct", lambda p: seg.nov_distinct(p.reports, p.params))
_on_path("lav_mean_of_minutes", lambda p: seg.lav_mean_of_minutes(p.reports, p.params))
_on_path("segment_minute_report_count", lambda p: seg.segment_minute_report_count(p.reports))
_on_path("running_speed_sum", lambda p: seg.running_speed_sum(p.reports, p.params))
_on_path("running_crossing_stats", lambda p: seg.running_crossing_stats(p.state, p.params))
_on_path("vehicle_minute_speed", lambda p: seg.vehicle_minute_speed(p.reports))
_on_path("minute_speed", lambda p: seg.minute_speed(seg.vehicle_minute_speed(p.reports)))
_on_path("single_report_segments", lambda p: seg.single_report_segments(p.reports))
_on_path("segment_tolls", lambda p: seg.segment_tolls(p.stats, _accident_minutes(p), p.params))

# Tolls and accounts
_on_path(
    "report_segment_context", lambda p: tol.report_segment_context(p.state, p.context)
)
_on_path("toll_notifications", lambda p: p.tolls)
_on_path("account_balance", lambda p: p.balances)
_on_path("daily_expenditure", lambda p: p.expenditures)
_on_path(
    "historical_balances",
    lambda p: tol.historical_balances(rep.expenditure_requests(p.events), p.history),
)
_on_path("all_notifications", lambda p: p.notifications)
_on_path("notification_lines", lambda p: tol.notification_lines(p.notifications))


# The form for recordings longer than a group may be: groups are cut along time, and each step is
# written. Here the pieces are short, so that all vehicles and segments are cut several times.
CUT_SECONDS, CUT_MINUTES = 600, 10


def _cut_path(spark: SparkSession, sf_dir: str) -> LivePath:
    path = live_path(spark, sf_dir)
    params = replace(path.params, piece_seconds=CUT_SECONDS, piece_minutes=CUT_MINUTES)
    return LivePath(path.events, path.history, params, has_copies=False)


_queries["cut_vehicle_state"] = lambda spark, sf_dir: _cut_path(spark, sf_dir).state
_queries["cut_notification_lines"] = lambda spark, sf_dir: tol.notification_lines(
    _cut_path(spark, sf_dir).notifications
)

# Words
_queries["word_count"] = lambda spark, sf_dir: wrd.word_count(
    wrd.words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
)

