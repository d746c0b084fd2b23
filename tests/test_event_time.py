"""The event-time path: disorder, late reports beside answers, expiry, history as initial state."""

from __future__ import annotations

import random
from types import SimpleNamespace

from pyspark.sql import functions as F
from traffic import as_frame, random_traffic, report, request
from walk import walk

from tollway import app
from tollway.schema import TOLL_HISTORY, Params
from tollway.sources.lines import event_line, parse_events
from tollway.sources.workdir import new_folder
from tollway.streaming import event_time, replay, state
from tollway.streaming.live import past_tolls, stream_settings

PARAMS = Params(free_vehicles=4)
DELAY = 60


def _arriving(spark, events, arrivals, slices):
    """Lines with the slice of their arrival."""
    span = max(arrivals) + 1
    lines = as_frame(spark, events).select(event_line().alias("value")).collect()
    data = [(line["value"], a * slices // span) for line, a in zip(lines, arrivals)]
    return spark.createDataFrame(data, "value string, slice bigint")


def _run(spark, events, arrivals, slices, name, sink=None, idle=None):
    history = spark.createDataFrame([(1, 3, 0, 42)], TOLL_HISTORY)
    out = new_folder(spark, name)

    def start(lines, checkpoint):
        rows = event_time.ordered_answers(parse_events(lines), history, DELAY, idle, PARAMS)
        if sink is not None:
            return sink(rows, out, checkpoint)
        return event_time.start_two_sinks(rows, out, checkpoint, {"availableNow": True}, 2)

    lines = _arriving(spark, events, arrivals, slices)
    replay.in_one_start(spark, lines, slices, start, name, 100_000, 2)
    answers = event_time.read_sink(spark, out, "answers", "value string")
    late = event_time.read_sink(spark, out, "late", event_time.LATE_ROW)
    return [r["value"] for r in answers.collect()], late.collect()


def _lines(events):
    """The answers of the plain walk, as lines."""
    want = walk(events, PARAMS.free_vehicles)
    tolls = [f"0,{t[0]},{t[1]},{t[5]},{t[8]}" for t in want["tolls"]]
    return tolls, want


def test_disorder_within_the_delay_changes_no_answer(spark):
    """Copies, differing order of arrival, requests before the reports they count."""
    rng = random.Random(9)
    events = random_traffic(11, vehicles=40, steps=14)
    events.append(request(3, 200, 1, 0, "day", 3))
    copies = rng.sample(events, 60)
    everything = events + copies
    arrivals = [e["time"] + rng.randrange(DELAY) for e in everything]
    got, late = _run(spark, everything, arrivals, 4, "disorder")
    assert late == []
    tolls, want = _lines(events)
    assert sorted(line for line in got if line.startswith("0,")) == sorted(tolls)
    balances = sorted(line for line in got if line.startswith("2,"))
    assert len(balances) == len({e["qid"] for e in events if e["typ"] == 2}) == len(want["balances"])
    assert [line.split(",")[2:] for line in got if line.startswith("3,")] == [["day", "42"]]
    told = {(t[0], t[1]) for t in want["tolls"] if t[7] >= 0}
    assert len([line for line in got if line.startswith("1,")]) == len(told) > 0


def test_nothing_is_lost_or_told_twice_when_a_batch_is_repeated(spark):
    """A sink that dies between its two writes; the batch is run again after a restart."""
    rng = random.Random(10)
    events = random_traffic(12, vehicles=20, steps=12)
    arrivals = [e["time"] + rng.randrange(DELAY) + 300 * (rng.random() < 0.05) for e in events]
    died = []

    def dying(rows, out, checkpoint):
        write = event_time.two_sinks(out)

        def once(batch, batch_id):
            if batch_id == 2 and not died:
                died.append(batch_id)
                event_time.answer_lines(batch).write.parquet(f"{out}/answers/batch_id=2")
                raise RuntimeError("killed")
            write(batch, batch_id)

        def begin():
            with stream_settings(spark, 2):
                return (
                    rows.writeStream.outputMode("append")
                    .foreachBatch(once)
                    .option("checkpointLocation", checkpoint)
                    .trigger(availableNow=True)
                    .start()
                )

        try:
            begin().awaitTermination()
        except Exception as e:
            assert "killed" in str(e)
        return begin()

    whole, late = _run(spark, events, arrivals, 4, "whole")
    again, late_again = _run(spark, events, arrivals, 4, "again", dying)
    assert died == [2]
    assert sorted(again) == sorted(whole)
    assert sorted(map(tuple, late_again), key=str) == sorted(map(tuple, late), key=str) != []
    # every report takes part or is told as late, and those that take part give the batch's answers
    missed = {(r["vid"], r["time"], r["xway"], r["dir"]) for r in late}
    took_part = [e for e in events if e["typ"] or (e["vid"], e["time"], e["xway"], e["dir"]) not in missed]
    assert len(events) - len(took_part) == len(late)
    tolls, _ = _lines(took_part)
    assert sorted(line for line in whole if line.startswith("0,")) == sorted(tolls)


def test_silent_vehicles_expire_and_their_stops_end(spark):
    stands = [report(30 * i, 1, 0, 0, 1, 0, 5, 5 * 5280 + 7) for i in range(6)]
    comes_back = [report(t, 2, 30, 0, 1, 0, 5, 5 * 5280 + t) for t in (0, 30, 60, 600, 630)]
    events = stands + comes_back
    lines = _arriving(spark, events, [e["time"] for e in events], 3)
    out = new_folder(spark, "expiry")

    def start(lines, checkpoint):
        states = event_time.ordered_states(parse_events(lines), DELAY, 120)
        with stream_settings(spark, 2):
            return (
                states.writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            )

    replay.in_one_start(spark, lines, 3, start, "expiry", 100_000, 2)
    states = spark.read.schema(state.ORDERED_STATE).parquet(out)
    gone = event_time.expired_vehicles(states, 120).collect()
    assert sorted((r["vid"], r["last_time"], r["expired_time"], r["was_stopped"]) for r in gone) == [
        (1, 150, 270, True), (2, 60, 180, False), (2, 630, 750, False),
    ]
    back = states.where("vid = 2 AND time = 600 AND NOT expired").first()
    assert back["is_crossing"] and back["new_minute"]  # it starts anew


def test_history_is_read_in_the_first_batch_only(spark, tmp_path):
    """After a restart the history would raise an error if any row of it were read."""
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "typ int, vid int, xway int, day int, time bigint, qid string, ingest_ms bigint"
    good = spark.createDataFrame([(v, 1, 0, 100 + v) for v in range(10)], TOLL_HISTORY)
    bad = good.withColumn("toll", F.raise_error(F.lit("history read")).cast("int"))
    found = []
    for history, vids in ((good, [0]), (bad, range(12))):
        rows = [(3, v, 0, 1, 5, f"q{v}", None) for v in vids] + [(2, 3, 0, 1, 5, "b", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        events = spark.readStream.schema(schema).parquet(inbox)
        with stream_settings(spark, 2):
            (
                past_tolls(events, history)
                .writeStream.foreachBatch(lambda df, i: found.extend((i, r["typ"], r["vid"], r["toll"]) for r in df.collect()))
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
    want = [(0, 2, 3, None), (0, 3, 0, 100), (1, 2, 3, None)]
    want += [(1, 3, v, 100 + v if v < 10 else None) for v in range(12)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_application_options():
    given = ["c", "in", "out", "h", "b:9092"]
    plain = app.source_options(app.arguments(given))
    assert plain["subscribe"] == "in" and plain["startingOffsets"] == "latest"
    more = app.arguments([*given, "--pattern", "--starting-offsets", "earliest", "--max-offsets", "5"])
    assert app.source_options(more) == {
        "subscribePattern": "in",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": 5,
        "kafka.bootstrap.servers": "b:9092",
    }


def test_lines_have_the_topic_they_are_for(spark):
    schema = f"{state.ACCOUNT_ANSWER}"
    rows = [
        (0, 7, 30, 0, 25, 0, None, None, None, None, None, None),
        (9, 7, 30, 0, None, None, None, None, None, None, None, "7,30,20,0,1,0,3,16000"),
    ]
    lines = event_time.lines_by_topic(spark.createDataFrame(rows, schema), "out", "late").collect()
    assert [tuple(r) for r in lines] == [("out", "0,7,30,25,0"), ("late", "7,30,20,0,1,0,3,16000")]


class _Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


HANDLE = SimpleNamespace(
    getValueState=lambda *_: _Value(), getMapState=lambda *_: _Map(), registerTimer=lambda _: None
)


def _row(time, **fields):
    base = {"vid": 1, "time": time, "speed": 30, "xway": 0, "lane": 1, "dir": 0, "segment": 3}
    return SimpleNamespace(**{**base, "position": 3 * 5280 + time % 5000, "ingest_ms": None, **fields})


def test_a_bad_clock_does_not_stop_a_vehicle():
    vehicle = state.VehicleProcessor(4, 5280, 4)
    vehicle.init(HANDLE)
    times = [0, 30, 10**9, 60, 90]
    told = [r for t in times for r in vehicle.handleInputRows((0, 0, 1), [_row(t)], None)]
    assert [(r.time, r.late) for r in told] == [(0, False), (30, False), (10**9, True), (60, False), (90, False)]
    # a vehicle that was away for days is heard again from its second report on
    days = [10 * 86_400, 10 * 86_400 + 30, 10 * 86_400 + 60]
    told = [r for t in days for r in vehicle.handleInputRows((0, 0, 1), [_row(t)], None)]
    assert [r.late for r in told] == [True, False, False]


def test_a_bad_clock_does_not_stop_a_segment():
    segment = state.SegmentProcessor(5, 2)
    segment.init(HANDLE)

    def tell(*times, asks=False):
        rows = [_row(t, vid=i, delta=0, asks=asks, new_minute=True, report=None) for i, t in enumerate(times)]
        return list(segment.handleInputRows((0, 0, 3), rows, None))

    tell(10, 20, 10**9)
    for minute in range(1, 100):
        tell(60 * minute, 60 * minute + 30)
    (answer,) = tell(6000, asks=True)
    assert (answer.nov, answer.lav) == (2, 30)
    assert len(segment.sums) <= segment.kept_minutes


def test_a_late_report_passes_through_a_segment():
    segment = state.SegmentProcessor(5, 2)
    segment.init(HANDLE)
    row = _row(10, delta=0, asks=False, new_minute=False, report="1,10,30")
    (told,) = segment.handleInputRows((0, 0, 3), [row], None)
    assert told.report == "1,10,30" and not segment.sums
