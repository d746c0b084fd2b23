"""Accidents: two or more vehicles standing in one place at the same time.

Everything is a sweep over changes: +1 where something begins and -1 where it ends, summed
per place and time before the shuffle, then run up along time. No pair of vehicles, and no
report with an accident, is ever formed to be filtered away later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.functions import affected_segments, minute_of
from tollway.operators.ordered import minute_piece, running, time_piece, with_previous
from tollway.schema import REPORT_COLUMNS, SEGMENT, SEGMENT_MINUTE, Params

SPOT = ["xway", "dir", "lane", "position"]
SEGMENT_POSITION = [*SEGMENT, "position"]


def stopped_at_place(state: DataFrame, changes: DataFrame, params: Params = Params()) -> DataFrame:
    """Reports with the number of vehicles standing at the report's own lane and position.

    Only the reports of places where something ever stood are counted; the others get 0.
    """
    reports = state.select(*REPORT_COLUMNS)
    begun = changes.select(*SPOT, "time", "delta")
    places = begun.select(*SPOT).distinct()
    asked = reports.join(places, SPOT, "left_semi").select(*SPOT, "time", F.lit(0).alias("delta"))
    by_time = begun.unionByName(asked).groupBy(*SPOT, "time").agg(F.sum("delta").alias("delta"))
    counted = running(
        by_time,
        SPOT,
        time_piece(params),
        ["time", "delta"],
        sums={"standing": "delta"},
    ).drop("delta")
    return reports.join(counted, [*SPOT, "time"], "left").select(
        *REPORT_COLUMNS, F.coalesce("standing", F.lit(0)).alias("standing")
    )


def accidents(changes: DataFrame, place: list[str], params: Params = Params()) -> DataFrame:
    """Maximal times with `crash_vehicles` or more standing in one `place`.

    `begin_time` is the second vehicle's stop; `end_time` the departure that leaves fewer,
    null if there is none. A vehicle stands once per road, so the count is of vehicles.
    """
    by_time = changes.groupBy(*place, "time").agg(F.sum("delta").alias("delta"))
    piece = time_piece(params)
    counted = running(
        by_time, place, piece, ["time", "delta"], sums={"standing": "delta"}
    )
    crash = F.col("standing") >= params.crash_vehicles
    before = F.col("standing") - F.col("delta") >= params.crash_vehicles
    edges = counted.where(crash != before).select(*place, "time", crash.alias("begins"))
    ends = with_previous(
        edges, place, piece, ["time DESC", "begins DESC"], {"time": 1}
    )
    return ends.where("begins").select(
        *place, F.col("time").alias("begin_time"), F.col("time_1").alias("end_time")
    )


def accidents_by_segment(changes: DataFrame, params: Params = Params()) -> DataFrame:
    """Accidents of a segment with the minutes they were created and cleared in."""
    return accidents(changes, SEGMENT, params).select(
        *SEGMENT,
        minute_of("begin_time").alias("created_minute"),
        minute_of("end_time").alias("cleared_minute"),
    )


def accidents_by_position(changes: DataFrame, params: Params = Params()) -> DataFrame:
    return accidents(changes, SEGMENT_POSITION, params).select(
        *SEGMENT_POSITION,
        minute_of("begin_time").alias("created_minute"),
        minute_of("end_time").alias("cleared_minute"),
    )


def ahead_columns(params: Params) -> list[str]:
    """Accidents by distance: `ahead_0` in the segment itself, `ahead_1` in the next, ..."""
    return [f"ahead_{d}" for d in range(params.alert_reach + 1)]


def accident_edges(by_segment: DataFrame, params: Params = Params()) -> DataFrame:
    """Where and when accidents come into force (1) and out of it (-1), by distance.

    An accident counts from the minute after it was created through the one it was cleared
    in, for its own segment and up to `alert_reach` segments before it. It costs two rows
    per segment however long it lasts.
    """
    edges = F.array(
        F.struct((F.col("created_minute") + 1).alias("minute"), F.lit(1).alias("delta")),
        F.struct((F.col("cleared_minute") + 1).alias("minute"), F.lit(-1).alias("delta")),
    )
    return (
        by_segment.select("xway", "dir", "segment", F.explode(edges).alias("edge"))
        .where("edge.minute IS NOT NULL")
        .select(
            "xway",
            "dir",
            F.posexplode(affected_segments("segment", "dir", params)).alias("distance", "segment"),
            "edge.minute",
            "edge.delta",
        )
        .select(
            *SEGMENT_MINUTE,
            *[
                F.when(F.col("distance") == d, F.col("delta")).otherwise(0).alias(c)
                for d, c in enumerate(ahead_columns(params))
            ],
        )
    )


def accidents_in_force(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Run the edges in `rows` (one per segment and minute) up along the minutes.

    Adds `accident_segment`, the nearest segment with an accident in force, and
    `lowest_segment`, the lowest numbered; null where there is none.
    """
    ahead = ahead_columns(params)
    run = running(
        rows,
        SEGMENT,
        minute_piece(params),
        ["minute"],
        sums={f"sum_{c}": c for c in ahead},
    )
    sign = F.when(F.col("dir") == 0, 1).otherwise(-1)
    by_distance = [
        F.when(F.col(f"sum_{c}") > 0, (F.col("segment") + sign * d).cast("int"))
        for d, c in enumerate(ahead)
    ]
    nearest, farthest = F.coalesce(*by_distance), F.coalesce(*by_distance[::-1])
    return run.select(
        *rows.columns,
        nearest.alias("accident_segment"),
        F.when(F.col("dir") == 0, nearest).otherwise(farthest).alias("lowest_segment"),
    )


def accident_zones(
    by_segment: DataFrame, minutes: DataFrame, params: Params = Params()
) -> DataFrame:
    """The segments and minutes, of those in `minutes`, with an accident ahead."""
    ahead = ahead_columns(params)
    asked = minutes.select(
        *SEGMENT_MINUTE, *[F.lit(0).alias(c) for c in ahead], F.lit(True).alias("asked")
    )
    summed = (
        accident_edges(by_segment, params)
        .withColumn("asked", F.lit(False))
        .unionByName(asked)
        .groupBy(*SEGMENT_MINUTE)
        .agg(*[F.sum(c).alias(c) for c in ahead], F.bool_or("asked").alias("asked"))
    )
    return (
        accidents_in_force(summed, params)
        .where(F.col("asked") & F.col("accident_segment").isNotNull())
        .select(*SEGMENT_MINUTE, "accident_segment", "lowest_segment")
    )


def _minutes(state: DataFrame) -> DataFrame:
    return state.select(*SEGMENT_MINUTE).distinct()


def _lookup(state: DataFrame, zones: DataFrame, column: str) -> DataFrame:
    """Reports with `column` of their zone as `accident_segment`, -1 where nothing is ahead."""
    found = zones.select(*SEGMENT_MINUTE, F.col(column).alias("accident_segment"))
    return state.join(found, SEGMENT_MINUTE, "left").select(
        *SEGMENT_MINUTE,
        "vid",
        "time",
        "lane",
        "is_crossing",
        F.coalesce("accident_segment", F.lit(-1)).alias("accident_segment"),
    )


def accident_lookup(
    state: DataFrame, by_segment: DataFrame, params: Params = Params()
) -> DataFrame:
    """Reports with the nearest accident ahead."""
    zones = accident_zones(by_segment, _minutes(state), params)
    return _lookup(state, zones, "accident_segment")


def accident_lookup_lowest(
    state: DataFrame, by_segment: DataFrame, params: Params = Params()
) -> DataFrame:
    """Reports with the lowest numbered segment in reach that has an accident."""
    zones = accident_zones(by_segment, _minutes(state), params)
    return _lookup(state, zones, "lowest_segment")


def accident_alerts(crossings: DataFrame, zones: DataFrame) -> DataFrame:
    """Chargeable crossings of vehicles heading for an accident."""
    return crossings.join(zones, SEGMENT_MINUTE).select(
        "vid", "time", "xway", "dir", "accident_segment"
    )


def accident_minutes(
    state: DataFrame, by_position: DataFrame, params: Params = Params()
) -> DataFrame:
    """Whether any report of a segment and minute came while an accident stood in it.

    `by_position` are `accidents` by segment and position.
    """
    edges = F.array(
        F.struct(F.col("begin_time").alias("time"), F.lit(1).alias("delta")),
        F.struct(F.col("end_time").alias("time"), F.lit(-1).alias("delta")),
    )
    changes = (
        by_position.select(*SEGMENT, F.inline(edges))
        .where("time IS NOT NULL")
        .select(*SEGMENT, "time", "delta", F.lit(False).alias("asked"))
    )
    asked = state.select(*SEGMENT, "time", F.lit(0).alias("delta"), F.lit(True).alias("asked"))
    by_time = (
        changes.unionByName(asked)
        .groupBy(*SEGMENT, "time")
        .agg(F.sum("delta").alias("delta"), F.bool_or("asked").alias("asked"))
    )
    run = running(
        by_time,
        SEGMENT,
        time_piece(params),
        ["time", "delta", "asked"],
        sums={"active": "delta"},
    )
    return (
        run.where("asked")
        .groupBy(*SEGMENT, minute_of("time").alias("minute"))
        .agg(F.bool_or(F.col("active") > 0).alias("accident"))
    )


def accident_minute_lookup(state: DataFrame, params: Params = Params()) -> DataFrame:
    """Reports with a per-minute notion of an accident.

    A segment's minute is a crash when `crash_vehicles` or more vehicles reported standing
    there. A standing report asks for its own segment, in this minute or the one before; a
    moving one for any segment in reach, in the minute before.
    """
    crashes = (
        state.where("is_stopped")
        .groupBy(*SEGMENT_MINUTE)
        .agg(F.count_distinct("vid").alias("vehicles"))
        .where(F.col("vehicles") >= params.crash_vehicles)
    )
    warned = crashes.select(
        "xway",
        "dir",
        F.posexplode(affected_segments("segment", "dir", params)).alias("distance", "segment"),
        (F.col("minute") + 1).alias("minute"),
    )
    own = crashes.select("xway", "dir", F.lit(0).alias("distance"), "segment", "minute")
    flags = (
        warned.withColumn("before", F.lit(True))
        .unionByName(own.withColumn("before", F.lit(False)))
        .groupBy(*SEGMENT_MINUTE)
        .agg(
            F.bool_or("before").alias("near"),
            F.bool_or(F.col("distance") == 0).alias("here"),
        )
    )
    flag = F.when(F.col("is_stopped"), F.col("here")).otherwise(F.col("near"))
    return state.join(flags, SEGMENT_MINUTE, "left").select(
        *SEGMENT_MINUTE, "vid", "time", F.coalesce(flag, F.lit(False)).alias("accident")
    )
