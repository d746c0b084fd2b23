"""The registered streaming queries: a recording is replayed and the answers returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.operators.words import word_count, words
from tollway.plans.live import LivePath
from tollway.plans.queries import Query, live_path
from tollway.sources import roads
from tollway.sources.lines import event_line, format_lines, parse_events
from tollway.sources.workdir import new_folder
from tollway.streaming import audit, event_time, live, replay, state, windows

# A micro-batch takes in one slice; there are as many as keep it within this size. State is
# spread so that a task handles about so many of its events.
EVENTS_PER_SLICE = 200_000_000
EVENTS_PER_TASK = 100_000
# Seconds the watermark lags behind the newest report.
DELAY = 60

_queries: dict[str, Query] = {}


def stream_queries() -> dict[str, Query]:
    return dict(_queries)


def _replayed(
    path: LivePath, lines: DataFrame, build: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    spark, events = lines.sparkSession, path.events.count()
    slices = max(2, -(-events // EVENTS_PER_SLICE))
    tasks = max(spark.sparkContext.defaultParallelism, events // slices // EVENTS_PER_TASK)
    partitions = min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = replay.by_time(lines, path.params.horizon, slices)
    return replay.replayed(spark, sliced, slices, build, name, partitions)


def _over_events(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Register `build(event stream, toll history)`, fed with the road events as lines."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = live_path(spark, sf_dir)
        return _replayed(path, format_lines(path.events), lambda e: build(e, path.history), name)

    _queries[name] = query


def _over_closed(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register `build(event stream)`, fed with the road events and the line that closes them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = live_path(spark, sf_dir)
        out, events = new_folder(spark, f"{name}-out"), path.events.count()
        slices = max(2, -(-events // EVENTS_PER_SLICE))
        tasks = max(spark.sparkContext.defaultParallelism, events // slices // EVENTS_PER_TASK)
        partitions = min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        schema = []

        def start(lines: DataFrame, checkpoint: str):
            rows = build(parse_events(lines))
            schema[:] = [rows.schema]
            return (
                rows.writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )

        sliced = replay.by_time(format_lines(path.events), path.params.horizon, slices)
        files = max(1, events // slices // EVENTS_PER_TASK // 10)
        closing = path.params.horizon + 3600  # past every window and session
        replay.in_one_start(spark, sliced, slices, start, name, closing, partitions, files)
        return spark.read.schema(schema[0]).parquet(out)

    _queries[name] = query


def _source_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines, bad ones included, through the source and the parser."""
    lines = roads.road_lines(spark, sf_dir)
    return _replayed(
        live_path(spark, sf_dir), lines, lambda e: e.drop("ingest_ms"), "stream_source_replay"
    )


_queries["stream_source_replay"] = _source_replay
_over_events(
    "stream_vehicle_state",
    lambda e, h: live.vehicle_state_stream(e).drop("ingest_ms", "late", "counted"),
)
_over_closed("stream_lav", lambda e: windows.lav_stream(e, DELAY))
_over_closed("stream_nov_distinct", lambda e: windows.nov_distinct_stream(e, DELAY))
_over_closed("stream_report_count", lambda e: windows.report_count_stream(e, DELAY))
_over_closed("stream_vehicle_trips", lambda e: windows.trip_stream(e, DELAY))
_over_events("stream_daily_expenditure", live.daily_expenditure_stream)
_over_events(
    "stream_toll_notifications",
    lambda e, h: live.toll_stream(live.vehicle_state_stream(e)).drop("ingest_ms"),
)


def _account_balance(events: DataFrame, history: DataFrame) -> DataFrame:
    tolls = live.toll_stream(live.vehicle_state_stream(events))
    answers = live.account_stream(tolls, live.balance_request_stream(events))
    return answers.where(F.col("typ") == 2).select("vid", "time", "xway", "qid", "balance")


_over_events("stream_account_balance", _account_balance)
_over_events(
    "stream_notifications",
    lambda e, h: live.line_stream(live.answer_stream(e, h), with_latency=False),
)


# Event time. Lines arrive up to LAG seconds late, which the watermark waits for; of some, where the
# query is about late reports, VERY_LATE seconds.
SLICES, LAG, VERY_LATE, IDLE = 4, 50, 400, 120


def _out_of_order(
    spark: SparkSession,
    sf_dir: str,
    build: Callable[[DataFrame, DataFrame], DataFrame],
    name: str,
    very_late: bool = False,
) -> str:
    """Feed the road events in order of arrival; the folder of answers and late reports."""
    path = live_path(spark, sf_dir)
    vid, time = F.col("vid").cast("bigint"), F.col("time")
    arrival = time + (vid * 7919 + time * 1047 + F.col("typ") * 31) % (LAG + 1)
    if very_late:
        arrival += F.when((vid * 31 + time) % 97 == 0, VERY_LATE).otherwise(0)
    span = path.params.horizon + LAG + VERY_LATE + 1
    at = F.call_function("div", arrival * SLICES, F.lit(span)).alias("slice")
    events, out = path.events.count(), new_folder(spark, f"{name}-out")
    files = max(1, events // SLICES // EVENTS_PER_TASK // 10)
    tasks = max(spark.sparkContext.defaultParallelism, events // SLICES // EVENTS_PER_TASK)
    partitions = min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def start(lines: DataFrame, checkpoint: str):
        rows = build(parse_events(lines), path.history)
        trigger = {"availableNow": True}
        return event_time.start_two_sinks(rows, out, checkpoint, trigger, partitions)

    lines = path.events.select(event_line().alias("value"), at)
    replay.in_one_start(spark, lines, SLICES, start, name, 2 * span + IDLE, partitions, files)
    return out


def _disordered_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to lines out of order are those of the batch."""
    out = _out_of_order(
        spark, sf_dir, lambda e, h: event_time.ordered_answers(e, h, DELAY), "disordered"
    )
    return event_time.read_sink(spark, out, "answers", "value string").select("value")


def _late_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports behind the watermark, from the second sink."""
    out = _out_of_order(
        spark, sf_dir, lambda e, h: event_time.ordered_answers(e, h, DELAY), "late", True
    )
    return event_time.read_sink(spark, out, "late", event_time.LATE_ROW).drop("batch_id", "ingest_ms")


def _state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that left the state, and when: no report for IDLE seconds."""
    path = live_path(spark, sf_dir)
    out, span = new_folder(spark, "expiry-out"), path.params.horizon + LAG + VERY_LATE + 1
    schema, events = state.EXPIRED, path.events.count()
    files = max(1, events // SLICES // EVENTS_PER_TASK // 10)
    tasks = max(spark.sparkContext.defaultParallelism, events // SLICES // EVENTS_PER_TASK)
    partitions = min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def start(lines: DataFrame, checkpoint: str):
        states = event_time.ordered_states(parse_events(lines), DELAY, IDLE)
        return (
            event_time.expired_vehicles(states, IDLE)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    sliced = replay.by_time(format_lines(path.events), path.params.horizon, SLICES)
    replay.in_one_start(spark, sliced, SLICES, start, "expiry", 2 * span + IDLE, partitions, files)
    return spark.read.schema(schema).parquet(out)


def _state_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts and open stops in the state of the live path, at the end of the recording."""
    path = live_path(spark, sf_dir)
    out = new_folder(spark, "audit-out")

    def start(lines: DataFrame, checkpoint: str):
        answers = live.answer_stream(parse_events(lines), path.history)
        return (
            live.line_stream(answers, with_latency=False)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    sliced = replay.by_time(format_lines(path.events), path.params.horizon, 2)
    return audit.audit(spark, replay.run_slices(spark, sliced, 2, start, "audit"))


_queries["stream_state_audit"] = _state_audit
_queries["stream_disordered_notifications"] = _disordered_notifications
_queries["stream_late_reports"] = _late_reports
_queries["stream_state_expiry"] = _state_expiry


def _word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over the documents, read as a stream; the last batch has them all."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a pattern, as a stream takes no path of a single file
    texts = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    out, checkpoint = new_folder(spark, "word-totals"), new_folder(spark, "word-state")
    replay.batches(word_count(words(texts)), checkpoint, out).awaitTermination()
    totals = spark.read.parquet(out)
    last = totals.agg(F.max("batch_id")).first()[0]
    return totals.where(F.col("batch_id") == last).drop("batch_id")


_queries["stream_word_count"] = _word_count
