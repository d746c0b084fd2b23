"""Record layouts and the constants of the tolling rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Message types, in and out.
POSITION_REPORT = 0
ACCIDENT_ALERT = 1
ACCOUNT_BALANCE = 2
DAILY_EXPENDITURE = 3

EXIT_LANE = 4


@dataclass(frozen=True)
class Params:
    """Constants of the tolling rules. The defaults are fixed values of the benchmark."""

    feet_per_segment: int = 5280
    last_segment: int = 99
    stop_reports: int = 4
    crash_vehicles: int = 2
    alert_reach: int = 4
    lav_minutes: int = 5
    lav_limit: int = 40
    free_vehicles: int = 50
    trip_gap_seconds: int = 60
    # Seconds the recording spans at most, if measured; and how far one ordered group may
    # reach before it is cut (see operators/ordered.py).
    horizon: int | None = None
    piece_seconds: int = 1_000_000
    piece_minutes: int = 100_000
    piece_vehicles: int = 1_000_000


# Positions of the fields in an input line; fields 10-13 are carried but not used.
LINE_FIELDS = (
    "typ", "time", "vid", "speed", "xway", "lane", "dir", "segment", "position", "qid",
    "init", "end", "dow", "tod", "day",
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("typ", T.IntegerType()),
        T.StructField("time", T.LongType()),
        T.StructField("vid", T.IntegerType()),
        T.StructField("speed", T.IntegerType()),
        T.StructField("xway", T.IntegerType()),
        T.StructField("lane", T.IntegerType()),
        T.StructField("dir", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("qid", T.StringType()),
        T.StructField("day", T.IntegerType()),
    ]
)

TOLL_HISTORY = T.StructType(
    [
        T.StructField("vid", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("xway", T.IntegerType()),
        T.StructField("toll", T.IntegerType()),
    ]
)

REPORT_COLUMNS = ("vid", "time", "speed", "xway", "lane", "dir", "segment", "position")
ROAD = ["xway", "dir"]
SEGMENT = ["xway", "dir", "segment"]
SEGMENT_MINUTE = ["xway", "dir", "segment", "minute"]
EVENT_KEY = ["typ", "vid", "time", "xway", "dir", "qid"]
