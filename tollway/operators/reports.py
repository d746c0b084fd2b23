"""Selections over the event stream; all of them reach the scan as pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.functions import event_timestamp, is_travel_lane, minute_of
from tollway.schema import (
    ACCOUNT_BALANCE,
    DAILY_EXPENDITURE,
    POSITION_REPORT,
    REPORT_COLUMNS,
)


def position_reports(events: DataFrame) -> DataFrame:
    return events.where(F.col("typ") == POSITION_REPORT).select(
        *REPORT_COLUMNS, minute_of("time").alias("minute")
    )


def toll_path_events(events: DataFrame) -> DataFrame:
    """Reports and balance requests, the input of the toll and account path."""
    return events.where(F.col("typ").isin(POSITION_REPORT, ACCOUNT_BALANCE))


def balance_requests(events: DataFrame) -> DataFrame:
    return events.where(F.col("typ") == ACCOUNT_BALANCE).select("vid", "time", "xway", "qid")


def expenditure_requests(events: DataFrame) -> DataFrame:
    return events.where(F.col("typ") == DAILY_EXPENDITURE).select(
        "vid", "time", "xway", "qid", "day"
    )


def travel_lane_reports(reports: DataFrame) -> DataFrame:
    return reports.where(is_travel_lane("lane"))


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_ts", event_timestamp("time"))
