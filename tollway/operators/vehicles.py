"""What a vehicle's report says against the vehicle's earlier reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators.ordered import running, time_piece, with_previous
from tollway.schema import EXIT_LANE, REPORT_COLUMNS, ROAD, Params

VEHICLE = [*ROAD, "vid"]


def _in_order(columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """Time first, then every other column: a total order, and one shuffle for all users."""
    return ["time", *[c for c in columns if c != "time" and c not in keys]]


def _all_equal(fields: Sequence[str], start: int, stop: int) -> str:
    """Whether the rows `start`..`stop` back (0 = this one) agree; false beyond the first."""

    def at(f: str, k: int) -> str:
        return f if k == 0 else f"{f}_{k}"

    pairs = [f"{at(f, k)} = {at(f, k + 1)}" for k in range(start, stop) for f in fields]
    return f"coalesce({' AND '.join(pairs)}, false)"


def vehicle_state(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Position reports with what changed since the vehicle's last one on this road.

    `is_stopped`: at least the `stop_reports`-th report in a row from one position and lane.
    `is_crossing`: another segment than before, back from the exit lane, or first report.
    `new_minute`: first report of its minute. `stop_began` and `stop_ended` mark the reports
    at which `is_stopped` turns true, and the first elsewhere after it was. `last_lane`,
    `last_position` and `last_segment` are those of the report before, 0 at the first.

    One report per (xway, dir, vid, time) is expected; see `distinct_events`.
    """
    n, place = params.stop_reports, ["position", "lane"]
    back = with_previous(
        reports.select(*REPORT_COLUMNS),
        VEHICLE,
        time_piece(params),
        _in_order(REPORT_COLUMNS, VEHICLE),
        {"position": n, "lane": n, "segment": 1, "time": 1},
    )
    stands, minute = _all_equal(place, 0, n - 1), "time div 60 + 1"
    return back.selectExpr(
        *REPORT_COLUMNS,
        f"{minute} AS minute",
        f"{stands} AS is_stopped",
        f"time_1 IS NULL OR segment <> position_1 div {params.feet_per_segment} "
        f"OR lane_1 = {EXIT_LANE} AS is_crossing",
        f"time_1 IS NULL OR {minute} <> time_1 div 60 + 1 AS new_minute",
        f"{stands} AND NOT {_all_equal(place, n - 1, n)} AS stop_began",
        f"{_all_equal(place, 1, n)} AND NOT {_all_equal(place, 0, 1)} AS stop_ended",
        "coalesce(lane_1, 0) AS last_lane",
        "coalesce(position_1, 0) AS last_position",
        "coalesce(segment_1, 0) AS last_segment",
    )


def segment_crossings(state: DataFrame) -> DataFrame:
    """Reports that enter a segment and are not on the exit lane."""
    return state.where(F.col("is_crossing") & (F.col("lane") != EXIT_LANE))


def stopped_vehicles(state: DataFrame) -> DataFrame:
    return state.where("is_stopped")


def stop_changes(state: DataFrame) -> DataFrame:
    """One row where a stop begins (`delta` 1) and where it ends (-1), at the stop's place."""
    return state.where("stop_began OR stop_ended").selectExpr(
        *VEHICLE,
        "time",
        *[f"if(stop_began, {c}, last_{c}) AS {c}" for c in ("segment", "lane", "position")],
        "if(stop_began, 1, -1) AS delta",
    )


def stop_intervals(changes: DataFrame, params: Params = Params()) -> DataFrame:
    """Stops with their begin and end times; `end_time` is null while the vehicle stands."""
    later_first = [f"{c} DESC" for c in _in_order(changes.columns, VEHICLE)]
    ends = with_previous(changes, VEHICLE, time_piece(params), later_first, {"time": 1})
    return ends.where("delta = 1").selectExpr(
        *VEHICLE, "segment", "lane", "position", "time AS begin_time", "time_1 AS end_time"
    )


def stop_detection(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Reports with `is_stopped` judged over all roads of a vehicle.

    True from the `stop_reports`-th report in a row with one expressway, direction, lane and
    position; any other report starts the count anew.
    """
    place, depth = ["xway", "dir", "lane", "position"], params.stop_reports - 1
    back = with_previous(
        reports.select(*REPORT_COLUMNS),
        ["vid"],
        time_piece(params),
        _in_order(REPORT_COLUMNS, ["vid"]),
        {f: depth for f in place},
    )
    return back.selectExpr(*REPORT_COLUMNS, f"{_all_equal(place, 0, depth)} AS is_stopped")


def trip_reports(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Reports with the number of the vehicle's trip, counted from 1.

    A trip ends when nothing is heard of the vehicle for `trip_gap_seconds`. Its reports
    stay rows; an array of them would have no bound.
    """
    rows = reports.select(*REPORT_COLUMNS)
    piece = time_piece(params)
    back = with_previous(rows, ["vid"], piece, _in_order(rows.columns, ["vid"]), {"time": 1})
    goes_on = f"coalesce(time - time_1 < {params.trip_gap_seconds}, false)"
    marked = back.selectExpr(*REPORT_COLUMNS, f"if({goes_on}, 0, 1) AS starts")
    numbered = running(
        marked, ["vid"], piece, _in_order(marked.columns, ["vid"]), sums={"trip": "starts"}
    )
    return numbered.drop("starts")


def vehicle_trips(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Trips with their span, number of reports and extent."""
    return (
        trip_reports(reports, params)
        .groupBy("vid", "trip")
        .agg(
            F.min("time").alias("begin_time"),
            F.max("time").alias("end_time"),
            F.count("*").alias("reports"),
            F.min("position").alias("low_position"),
            F.max("position").alias("high_position"),
        )
        .drop("trip")
    )
