"""Event-time aggregations: windows, watermarks, sessions. All of it runs inside the JVM.

Append mode tells a window once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.functions import minute_of
from tollway.functions.road import CLOCK_START
from tollway.operators import reports as rep
from tollway.schema import POSITION_REPORT, SEGMENT, SEGMENT_MINUTE, Params


def timed_reports(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Position reports with their event time, and a watermark that much behind all events.

    The filter names the event time, so that it stays above the watermark: a request, or the line
    that closes a recording, moves it too.
    """
    timed = rep.with_event_time(events).withWatermark("event_ts", f"{delay_seconds} seconds")
    return timed.where(F.when(F.col("event_ts").isNotNull(), F.col("typ")) == POSITION_REPORT)


def _seconds(ts: Column) -> Column:
    """A timestamp on the event clock, in seconds since its start."""
    return F.unix_seconds(ts) - CLOCK_START


def lav_stream(events: DataFrame, delay_seconds: int, params: Params = Params()) -> DataFrame:
    """Mean speed of the five minutes before each minute.

    Two windows in a chain: reports are summed by minute, one row of state for each, and a window
    that slides by minutes sums the minutes that are complete, not the reports five times.
    """
    minutes = (
        timed_reports(events, delay_seconds)
        .groupBy(F.window("event_ts", "1 minute"), *SEGMENT)
        .agg(F.sum("speed").alias("speed_sum"), F.count("*").alias("reports"))
        .select(F.window_time("window").alias("minute_ts"), *SEGMENT, "speed_sum", "reports")
    )
    span = F.window("minute_ts", f"{params.lav_minutes} minutes", "1 minute")
    return (
        minutes.groupBy(span, *SEGMENT)
        .agg(F.sum("speed_sum").alias("speed_sum"), F.sum("reports").alias("reports"))
        .select(
            *SEGMENT,
            minute_of(_seconds(F.col("window.end"))).alias("minute"),
            F.floor(F.col("speed_sum") / F.col("reports") + 0.5).cast("int").alias("lav"),
        )
    )


def nov_distinct_stream(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Distinct vehicles of each segment and minute.

    A vehicle's further reports of the minute come within 60 seconds of its first, so the
    delay must be at least that for all of them to be recognised.
    """
    if delay_seconds < 60:
        raise ValueError("the watermark must lag by a minute or more")
    return (
        timed_reports(events, delay_seconds)
        .withColumn("minute", minute_of("time"))
        .dropDuplicatesWithinWatermark([*SEGMENT_MINUTE, "vid"])
        .groupBy(F.window("event_ts", "1 minute"), *SEGMENT)
        .agg(F.count("*").alias("vehicles"))
        .select(*SEGMENT, minute_of(_seconds(F.col("window.start"))).alias("minute"), "vehicles")
    )


def report_count_stream(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Reports of each segment and minute; in update mode a running count."""
    return (
        timed_reports(events, delay_seconds)
        .groupBy(F.window("event_ts", "1 minute"), *SEGMENT)
        .agg(F.count("*").alias("reports"))
        .select(*SEGMENT, minute_of(_seconds(F.col("window.start"))).alias("minute"), "reports")
    )


def trip_stream(events: DataFrame, delay_seconds: int, params: Params = Params()) -> DataFrame:
    """Finished trips: sessions of a vehicle's reports less than `trip_gap_seconds` apart."""
    session = F.session_window("event_ts", f"{params.trip_gap_seconds} seconds")
    return (
        timed_reports(events, delay_seconds)
        .groupBy(session, "vid")
        .agg(
            F.min("time").alias("begin_time"),
            F.max("time").alias("end_time"),
            F.count("*").alias("reports"),
            F.min("position").alias("low_position"),
            F.max("position").alias("high_position"),
        )
        .drop("session_window")
    )
