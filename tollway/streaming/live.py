"""The live path on streams: event stream in, answers out as soon as an event arrives.

Three keyed states follow each other: vehicle, segment, account. The reports of a vehicle go
to its segment; the begin and end of a stop go to the segments it can affect, five rows at
most, so that each segment knows of the accidents ahead without a join.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.functions import affected_segments, toll_amount
from tollway.operators.tolls import notification_line
from tollway.operators.vehicles import VEHICLE
from tollway.schema import (
    ACCOUNT_BALANCE,
    DAILY_EXPENDITURE,
    EXIT_LANE,
    POSITION_REPORT,
    REPORT_COLUMNS,
    SEGMENT,
    Params,
)
from tollway.streaming import state

cloudpickle.register_pickle_by_value(state)

_STATE_STORE = "spark.sql.streaming.stateStore"
_STATE_CONF = {
    f"{_STATE_STORE}.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # a micro-batch uploads its changes, not a snapshot of all state
    f"{_STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def stream_settings(spark: SparkSession, partitions: int | None = None):
    """Start queries with the state store that keyed processors need.

    A stateful query keeps for good the number of shuffle partitions it is first started
    with, and adaptive execution does not merge them; `partitions` sets it.
    """
    conf = dict(_STATE_CONF)
    if partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def vehicle_state_stream(events: DataFrame, params: Params = Params()) -> DataFrame:
    """`vehicle_state` for a stream of events; also carries `ingest_ms`.

    Reports overtaken by later ones of their vehicle are told too, as `late`; those that come
    within the allowed lateness are `counted` in their minute (see `late_reports`).

    The reports of a vehicle are brought together and packed into few rows before they go to its
    state, which costs a shuffle more, and their states come back packed.
    """
    states = (
        events.where(F.col("typ") == POSITION_REPORT)
        .select(*REPORT_COLUMNS, "ingest_ms")
        .repartition(*VEHICLE)
        .mapInArrow(state.pack_reports, state.PACKED_REPORTS)
        .groupBy(*VEHICLE)
        .transformWithState(
            statefulProcessor=state.PackedVehicleProcessor(
                params.stop_reports, params.feet_per_segment, EXIT_LANE
            ),
            outputStructType=state.PACKED_STATE,
            outputMode="Append",
            timeMode="None",
        )
    )
    each = [c for c in state.STATE_COLUMNS if c not in state.VEHICLE_KEY]
    told = states.select(*state.VEHICLE_KEY, F.inline(F.arrays_zip(*each)))
    return told.select(*state.STATE_COLUMNS)


def late_reports(vehicle_states: DataFrame) -> DataFrame:
    """The side output of reports that came after a later one of their vehicle.

    `counted` tells whether a report came in time for its minute's statistics. No report is
    dropped untold; a copy of one seen within the allowed lateness is no report.
    """
    return vehicle_states.where("late").select(*REPORT_COLUMNS, "counted", "ingest_ms")


def summed_reports(told: DataFrame) -> DataFrame:
    """Rows for segments, with the reports of a segment and minute summed before they are shuffled.

    A sum stands in `speed`, `reports` and `novel` at the first second of its minute. Rows that ask for an
    answer and those of stops and late reports stay, and count no report.
    """
    return told.mapInArrow(state.sum_reports, state.SUMMED)


def segment_answers(vehicle_states: DataFrame, params: Params = Params()) -> DataFrame:
    """`toll_stream`, with late reports passing through in `report`, as lines, if they are kept.

    States of the event-time path may have `expired`: such a row is no report, but ends a stop.
    """
    asks = F.col("is_crossing") & (F.col("lane") != EXIT_LANE)
    none, no_report = F.lit(0), F.lit(None).cast("string")
    in_order = "expired" in vehicle_states.columns

    def to_segment(segment, distance, delta, report=no_report):
        is_report = delta is None
        return F.struct(
            segment.alias("segment"),
            distance.alias("distance"),
            (F.lit(0) if is_report else delta).alias("delta"),
            (asks if is_report else F.lit(False)).alias("asks"),
            report.alias("report"),
        )

    began = F.col("stop_began")
    stop_segment = F.when(began, F.col("segment")).otherwise(F.col("last_segment"))
    warned = F.transform(
        affected_segments(stop_segment, "dir", params),
        lambda s, i: to_segment(s, i, F.when(began, 1).otherwise(-1)),
    )
    if in_order:
        line = F.concat_ws(",", *[F.col(c).cast("string") for c in REPORT_COLUMNS])
        late = F.when(F.col("late"), line)
        own = F.array(to_segment(F.col("segment"), none, None, late))
        own = F.when(~F.col("expired"), own).otherwise(F.slice(own, 1, 0))
    else:
        own = F.array(to_segment(F.col("segment"), none, None))
        vehicle_states = vehicle_states.where("counted")
    rows = F.when(began | F.col("stop_ended"), F.concat(own, warned)).otherwise(own)
    kept = ["vid", "time", "speed", "xway", "dir", "new_minute", "ingest_ms"]
    told = vehicle_states.select(*kept, F.explode(rows).alias("r")).select(*kept, "r.*")
    answers = (
        summed_reports(told)
        .groupBy(*SEGMENT)
        .transformWithState(
            statefulProcessor=state.SummedSegmentProcessor(
                params.lav_minutes, params.crash_vehicles
            ),
            outputStructType=state.SEGMENT_ANSWER,
            outputMode="Append",
            timeMode="None",
        )
    )
    toll = toll_amount("lav", "nov", F.col("accident_segment") != -1, params)
    return answers.withColumn("toll", toll)


def toll_stream(vehicle_states: DataFrame, params: Params = Params()) -> DataFrame:
    """`toll_notifications` for a stream of vehicle states."""
    return segment_answers(vehicle_states, params).drop("report")


def account_stream(tolls: DataFrame, requests: DataFrame) -> DataFrame:
    """Toll, alert and balance messages for streams of tolls and requests.

    Requests for a day's expenditure pass through; they come with their answer as `toll`.
    """
    wanted = ["vid", "xway", "time", "dir", "lav", "toll", "accident_segment", "ingest_ms"]
    requests = requests.select(
        "typ", "vid", "time", "xway", "qid", "ingest_ms",
        F.col("toll") if "toll" in requests.columns else F.lit(None).cast("bigint").alias("toll"),
    )
    wanted += [F.col("report") if "report" in tolls.columns else F.lit(None).alias("report")]
    told = tolls.select(F.lit(POSITION_REPORT).alias("typ"), *wanted)
    told = told.withColumn("report", F.col("report").cast("string"))
    return (
        told.unionByName(requests, allowMissingColumns=True)
        .groupBy("vid", "xway")
        .transformWithState(
            statefulProcessor=state.AccountProcessor(),
            outputStructType=state.ACCOUNT_ANSWER,
            outputMode="Append",
            timeMode="None",
        )
    )


def packed_history(history: DataFrame, block: int) -> DataFrame:
    """One row for each (vid, xway) and `block` days: the days it has and their tolls.

    Of several tolls of a day the largest stands last.
    """
    known = F.sort_array(F.collect_list(F.struct("day", F.col("toll").cast("bigint").alias("toll"))))
    return (
        history.groupBy("vid", "xway", F.floor(F.col("day") / block).alias("block"))
        .agg(known.alias("known"))
        .select("vid", "xway", "block", F.col("known.day").alias("days"), F.col("known.toll").alias("tolls"))
    )


# Days of the history that are one value of state.
HISTORY_BLOCK = 128


def past_tolls(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests with the past toll of their day as `toll`; null if they ask for none, or unknown.

    The history is loaded into the state of (vid, xway), as its initial state: Spark reads it in the
    first micro-batch only, and later ones look the day up. Its days come in blocks, so that loading
    takes a call to the state for many days, not for each.
    """
    return (
        requests.select("typ", "vid", "xway", "day", "time", "qid", "ingest_ms")
        .groupBy("vid", "xway")
        .transformWithState(
            statefulProcessor=state.ExpenditureProcessor(DAILY_EXPENDITURE, HISTORY_BLOCK),
            outputStructType=state.ANSWERED,
            outputMode="Append",
            timeMode="None",
            initialState=packed_history(history, HISTORY_BLOCK).groupBy("vid", "xway"),
        )
    )


def daily_expenditure_stream(events: DataFrame, history: DataFrame) -> DataFrame:
    """Answers to requests for a day's expenditure, from the toll history."""
    answered = past_tolls(events.where(F.col("typ") == DAILY_EXPENDITURE), history)
    return answered.select("vid", "time", "xway", "qid", "day", F.col("toll").cast("int"))


def balance_request_stream(events: DataFrame) -> DataFrame:
    return events.where(F.col("typ") == ACCOUNT_BALANCE).select(
        "typ", "vid", "time", "xway", "qid", "ingest_ms"
    )


def answer_stream(events: DataFrame, history: DataFrame, params: Params = Params()) -> DataFrame:
    """Every answer to a stream of events, as in `all_notifications`, with `ingest_ms`.

    The source is read by two branches, reports and requests.
    """
    tolls = toll_stream(vehicle_state_stream(events, params), params)
    asked = events.where(F.col("typ").isin(ACCOUNT_BALANCE, DAILY_EXPENDITURE))
    requests = past_tolls(asked, history)
    return account_stream(tolls, requests).drop("report")


def line_stream(answers: DataFrame, with_latency: bool = True) -> DataFrame:
    """Answers as output lines in `value`, the column a message broker's sink takes.

    The latency is the time since the event was taken in, in ms; -1 where that is unknown.
    """
    emit = None
    if with_latency:
        now = F.unix_millis(F.current_timestamp())
        emit = F.coalesce(now - F.col("ingest_ms"), F.lit(-1)).cast("string")
    return answers.select(notification_line(emit).alias("value"))


def start_answers(
    lines: DataFrame,
    checkpoint: str,
    fmt: str = "kafka",
    trigger: dict | None = None,
    **options,
):
    """Write output lines to a sink; two-second micro-batches unless told otherwise.

    For "kafka" give `topic` and `kafka.bootstrap.servers`; "parquet" and "text" take `path`.
    """
    writer = (
        lines.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
    )
    with stream_settings(lines.sparkSession):
        return writer.options(**options).start()
