"""Road traffic projected from the `events` table.

Each user drives: their n-th event (by time) becomes a position report 30 seconds after the
one before. Purchases also ask for the account balance and signups for a day's expenditure.
All arithmetic is on integers, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.functions import segment_of, whole_div
from tollway.operators.ordered import running
from tollway.schema import (
    ACCOUNT_BALANCE,
    DAILY_EXPENDITURE,
    EVENT_SCHEMA,
    POSITION_REPORT,
)
from tollway.sources import workdir
from tollway.sources.history import open_toll_history, read_toll_history, store_toll_history
from tollway.sources.lines import event_line, read_lines

HISTORY_DAYS = 69
HISTORY_BUCKETS = 8

_written: dict[tuple[str, str, str], str] = {}


def _once_written(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of a derived table, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = workdir.new_folder(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def _numbered(events: DataFrame) -> DataFrame:
    """Events with `n`, their zero-based place among the user's events, and `last`."""
    ones = events.select("user_id", "ts", "event_id", "event_type", F.lit(1).alias("one"))
    columns = ["ts", "event_id", "event_type", "one"]
    minute = "date_trunc('minute', ts)"
    up = running(ones, ["user_id"], minute, columns, sums={"place": "one"})
    last = F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    lasts = events.groupBy("user_id").agg(last, F.lit(True).alias("last"))
    return up.join(lasts, ["user_id", "event_id"], "left").select(
        "user_id",
        "event_id",
        "event_type",
        (F.col("place") - 1).alias("n"),
        F.coalesce("last", F.lit(False)).alias("last"),
    )


def project_events(events: DataFrame) -> DataFrame:
    """Reports and requests (`EVENT_SCHEMA`) of the traffic described above."""
    n, user = F.col("n"), F.col("user_id")
    half = whole_div(user, 2)
    halts_early = half % 7 == 3
    halts_late = ~halts_early & (half % 11 == 5)
    halted = (halts_early & n.between(20, 26)) | (halts_late & n.between(41, 50))
    steps = (
        F.when(halts_early, F.when(n < 20, n).when(n <= 26, 20).otherwise(n - 6))
        .when(halts_late, F.when(n < 41, n).when(n <= 50, 41).otherwise(n - 9))
        .otherwise(n)
    )
    cruise = F.lit(20) + (half * 7) % 30
    feet = steps * cruise * 44
    end = F.lit(527_999)
    direction = F.when(user % 5 == 0, 1).otherwise(0)
    lane = (
        F.when(F.col("last") | (n % 40 == 39), 4)
        .when(n % 40 == 0, 0)
        .otherwise(1 + (half + whole_div(n, 20)) % 3)
    )

    driven = _numbered(events).select(
        user.cast("int").alias("vid"),
        (n * 30 + user % 30).alias("time"),
        F.when(halted, 0).otherwise(cruise).cast("int").alias("speed"),
        F.when(user % 10 == 0, 1).otherwise(0).alias("xway"),
        lane.cast("int").alias("lane"),
        direction.alias("dir"),
        F.when(direction == 0, F.least(feet, end))
        .otherwise(F.greatest(end - feet, F.lit(0)))
        .cast("int")
        .alias("position"),
        "event_id",
        "event_type",
    ).withColumn("segment", segment_of("position"))

    none, no_id = F.lit(-1), F.lit("-1")

    def message(typ: int, is_report: bool, qid, day):
        def own(c):
            return F.col(c) if is_report else none

        return F.struct(
            F.lit(typ).alias("typ"),
            *[own(c).alias(c) for c in ("speed", "lane", "dir", "segment", "position")],
            qid.alias("qid"),
            day.cast("int").alias("day"),
        )

    qid = F.col("event_id").cast("string")
    report = message(POSITION_REPORT, True, no_id, none)
    balance = message(ACCOUNT_BALANCE, False, qid, none)
    daily = message(DAILY_EXPENDITURE, False, qid, 1 + F.col("event_id") % HISTORY_DAYS)
    messages = (
        F.when(F.col("event_type") == "purchase", F.array(report, balance))
        .when(F.col("event_type") == "signup", F.array(report, daily))
        .otherwise(F.array(report))
    )
    # time, vid and xway stay as they are in all of a report's messages
    return driven.select("time", "vid", "xway", F.explode(messages).alias("m")).select(
        *[
            F.col(f.name) if f.name in ("time", "vid", "xway") else F.col(f"m.{f.name}")
            for f in EVENT_SCHEMA
        ]
    )


def project_history(events: DataFrame) -> DataFrame:
    """Past tolls of every user; every 23rd (vid + day) is missing."""
    days = F.explode(F.sequence(F.lit(1), F.lit(HISTORY_DAYS)))
    vid, day, xway = F.col("vid"), F.col("day"), F.col("xway")
    return (
        events.select(F.col("user_id").cast("int").alias("vid"))
        .distinct()
        .select("vid", days.alias("day"))
        .where((vid + day) % 23 != 0)
        .select("vid", "day", F.explode(F.array(F.lit(0), F.lit(1))).alias("xway"))
        .select("vid", "day", "xway", ((vid * 31 + day * 17 + xway * 7) % 100).alias("toll"))
    )


def project_lines(events: DataFrame) -> DataFrame:
    """The events as input lines, with bad and repeated lines among them.

    Where (vid + time) % 200 is 0, 50, 100 or 150, the line is followed by a copy of itself,
    by its first six fields, by one with a word for the speed, or by a blank one.
    """
    line, kind = F.col("value"), F.col("kind")
    wordy = F.concat_ws(
        ",", F.substring_index(line, ",", 3), F.lit("fast"), F.substring_index(line, ",", -11)
    )
    lines = (
        F.when(kind == 0, F.array(line, line))
        .when(kind == 50, F.array(line, F.substring_index(line, ",", 6)))
        .when(kind == 100, F.array(line, wordy))
        .when(kind == 150, F.array(line, F.lit("  ")))
        .otherwise(F.array(line))
    )
    return (
        project_events(events)
        .select(event_line().alias("value"), ((F.col("vid") + F.col("time")) % 200).alias("kind"))
        .select(F.explode(lines).alias("value"))
    )


def _events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def road_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and requests projected from `events`, read from a table written once."""

    def derive() -> DataFrame:
        return project_events(_events_table(spark, sf_dir))

    path = _once_written(spark, sf_dir, "road_events", lambda p: derive().write.parquet(p))
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def road_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past tolls, read back from a CSV file with the declared schema."""

    def derive() -> DataFrame:
        return project_history(_events_table(spark, sf_dir))

    path = _once_written(spark, sf_dir, "toll_history", lambda p: derive().write.csv(p))
    return read_toll_history(spark, path)


def road_history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row a key, as a table in buckets that is written once."""
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), HISTORY_BUCKETS)

    def write(path: str) -> None:
        store_toll_history(road_history(spark, sf_dir), path, buckets)

    path = _once_written(spark, sf_dir, "toll_history_table", write)
    return open_toll_history(spark, path, buckets)


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input lines, read back as text."""

    def derive() -> DataFrame:
        return project_lines(_events_table(spark, sf_dir))

    path = _once_written(spark, sf_dir, "road_lines", lambda p: derive().write.text(p))
    return read_lines(spark, path)
