"""The live path in event time: answers that do not depend on the order of arrival.

Reports and requests wait in keyed state until the watermark has passed them, and are then handled
in order, all keys up to the same second. As long as nothing comes later than the watermark's
delay, the answers are those of the batch; they come that much later than on the path of `live`.
Reports behind the watermark are told as late, and vehicles that fall silent leave the state.

Only the first stage of each branch needs event time. What it lets out in a micro-batch is all that
happened between two watermarks, so the stages behind it keep plain state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.functions.road import CLOCK_START
from tollway.operators import reports as rep
from tollway.operators.tolls import notification_line
from tollway.operators.vehicles import VEHICLE
from tollway.schema import (
    ACCOUNT_BALANCE,
    DAILY_EXPENDITURE,
    EXIT_LANE,
    POSITION_REPORT,
    REPORT_COLUMNS,
    Params,
)
from tollway.streaming import state
from tollway.streaming.live import account_stream, past_tolls, segment_answers, stream_settings


def with_watermark(events: DataFrame, delay_seconds: int) -> DataFrame:
    return rep.with_event_time(events).withWatermark("event_ts", f"{delay_seconds} seconds")


def _of_type(*types: int) -> Column:
    """A filter that stays above the watermark, so that events of all types move it."""
    return F.when(F.col("event_ts").isNotNull(), F.col("typ")).isin(*types)


def ordered_states(
    events: DataFrame,
    delay_seconds: int,
    idle_seconds: int | None = None,
    params: Params = Params(),
) -> DataFrame:
    """`vehicle_state` for a stream in any order; with `late`, and `expired` vehicles.

    Vehicles silent for more than `idle_seconds` leave the state; without it they stay.
    """
    return (
        with_watermark(events, delay_seconds)
        .where(_of_type(POSITION_REPORT))
        .select(*REPORT_COLUMNS, "ingest_ms")
        .groupBy(*VEHICLE)
        .transformWithState(
            statefulProcessor=state.OrderedVehicleProcessor(
                params.stop_reports,
                params.feet_per_segment,
                EXIT_LANE,
                clock_start=CLOCK_START,
                idle_seconds=idle_seconds,
            ),
            outputStructType=state.ORDERED_STATE,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def expired_vehicles(states: DataFrame, idle_seconds: int) -> DataFrame:
    """The vehicles that left the state: when they were last heard of, and whether they stood."""
    return states.where("expired").select(
        "vid",
        "xway",
        "dir",
        (F.col("time") - idle_seconds).alias("last_time"),
        F.col("time").alias("expired_time"),
        F.col("stop_ended").alias("was_stopped"),
    )


def waiting_requests(requests: DataFrame, kept_seconds: int) -> DataFrame:
    """Requests (of events with a watermark), with answers, when it has passed them; no copies."""
    return (
        requests.select("typ", "vid", "time", "xway", "qid", "toll", "ingest_ms")
        .groupBy("vid", "xway")
        .transformWithState(
            statefulProcessor=state.WaitingRequestProcessor(CLOCK_START, kept_seconds),
            outputStructType=(
                "typ int, vid int, time bigint, xway int, qid string, toll bigint, ingest_ms bigint"
            ),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def ordered_answers(
    events: DataFrame,
    history: DataFrame,
    delay_seconds: int,
    idle_seconds: int | None = None,
    params: Params = Params(),
) -> DataFrame:
    """Every answer to a stream of events in any order, and its late reports.

    As `answer_stream`, with rows of type `LATE_REPORT` that have a report in `report`.
    """
    tolls = segment_answers(ordered_states(events, delay_seconds, idle_seconds, params), params)
    requests = with_watermark(events, delay_seconds).where(
        _of_type(ACCOUNT_BALANCE, DAILY_EXPENDITURE)
    )
    answered = past_tolls(requests, history)
    return account_stream(tolls, waiting_requests(answered, delay_seconds))


LATE_ROW = (
    "vid int, time bigint, speed int, xway int, lane int, dir int, segment int, position int,"
    " ingest_ms bigint"
)


def late_rows(answers: DataFrame) -> DataFrame:
    """The late reports among the answers, as columns."""
    fields = F.split("report", ",")
    kinds = {"time": "bigint"}
    return answers.where(F.col("typ") == state.LATE_REPORT).select(
        *[
            fields[i].cast(kinds.get(c, "int")).alias(c) for i, c in enumerate(REPORT_COLUMNS)
        ],
        "ingest_ms",
    )


def answer_lines(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("typ") != state.LATE_REPORT).select(
        notification_line(None).alias("value")
    )


def lines_by_topic(answers: DataFrame, topic: str, late_topic: str) -> DataFrame:
    """Answers and late reports as lines, with the `topic` they are for, as a broker's sink takes."""
    is_late = F.col("typ") == state.LATE_REPORT
    return answers.select(
        F.when(is_late, late_topic).otherwise(topic).alias("topic"),
        F.when(is_late, F.col("report")).otherwise(notification_line(None)).alias("value"),
    )


def two_sinks(out: str) -> Callable[[DataFrame, int], None]:
    """A sink for answers and late reports: `out/answers` and `out/late`, from one pass.

    Each micro-batch has a folder of its own in both. One that is repeated after a failure
    overwrites its folders, so that nothing is lost or told twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # both read it; without this the states would be updated twice
        try:
            for name, rows in (("answers", answer_lines(kept)), ("late", late_rows(kept))):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    return write


def start_two_sinks(
    answers: DataFrame, out: str, checkpoint: str, trigger: dict | None = None,
    partitions: int | None = None,
):
    """Write answers and late reports side by side; see `two_sinks`."""
    with stream_settings(answers.sparkSession, partitions):
        return (
            answers.writeStream.outputMode("append")
            .foreachBatch(two_sinks(out))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"}))
            .start()
        )


def read_sink(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """What a sink of `two_sinks` has so far, with `batch_id`."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{out}/{name}")
