"""Streaming forms: parity with the batch SQL, restarts, copies, late rows, running counts."""

from __future__ import annotations

import pytest
from compare import difference, duck
from pyspark.sql import functions as F
from traffic import as_frame, random_traffic, report, request
from walk import walk

from tollway.app import answer_lines
from tollway.operators.words import word_count, words
from tollway.plans.stream_queries import stream_queries
from tollway.schema import TOLL_HISTORY, Params
from tollway.sources.lines import format_lines, parse_events, read_line_stream
from tollway.streaming import live, replay, state, windows
from tollway.streaming.live import start_answers


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(stream_queries()))
def test_stream_equals_its_sql(spark, con, sf_dir, name):
    assert difference(spark, con, name, sf_dir) is None


def _replay(spark, events, build, slices=2):
    lines = format_lines(as_frame(spark, events))
    horizon = max(e["time"] for e in events)
    sliced = replay.by_time(lines, horizon, slices)
    return replay.replayed(spark, sliced, slices, build, "test")


def test_answers_agree_with_a_walk_across_restarts(spark):
    events = random_traffic(4, vehicles=60)
    params = Params(free_vehicles=4)
    history = spark.createDataFrame([], TOLL_HISTORY)
    answers = _replay(
        spark, [*events, *events[:50]], lambda e: live.answer_stream(e, history, params), slices=3
    )
    want = walk(events, params.free_vehicles)
    assert any(t[8] for t in want["tolls"]) and any(t[7] >= 0 for t in want["tolls"])
    tolls = answers.where("typ = 0").select("vid", "time", "xway", "lav", "toll").collect()
    assert sorted(map(tuple, tolls)) == sorted((*t[:3], t[5], t[8]) for t in want["tolls"])
    alerts = answers.where("typ = 1").select("vid", "time", "accident_segment").collect()
    assert sorted(map(tuple, alerts)) == sorted((*t[:2], t[7]) for t in want["tolls"] if t[7] >= 0)
    balances = answers.where("typ = 2").select("vid", "time", "xway", "qid", "balance")
    got = set(map(tuple, balances.collect()))
    assert got == set(want["balances"])


def test_application_from_lines_to_lines(spark, tmp_path):
    """The application's query on files, with the time each line was taken in."""
    events = [*random_traffic(6, vehicles=3, steps=5), request(3, 9, 0, 0, "day", 2)]
    history = spark.createDataFrame([(0, 2, 0, 77)], TOLL_HISTORY)
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    format_lines(as_frame(spark, events)).write.text(inbox)
    lines = read_line_stream(spark, "text", path=inbox)
    taken_in = lines.withColumn("timestamp", F.current_timestamp())
    start_answers(
        answer_lines(taken_in, history), checkpoint, "text", {"availableNow": True}, path=out
    ).awaitTermination()
    rows = [r.value.split(",") for r in spark.read.text(out).collect()]
    assert {r[0] for r in rows} >= {"0", "3"}
    assert all(0 <= int(r[3 if r[0] == "0" else 2]) < 600_000 for r in rows)
    assert [(r[1], *r[3:]) for r in rows if r[0] == "3"] == [("9", "day", "77")]


class _Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def getValueState(self, name, schema):
        return _Value()


def test_late_reports_are_told_and_counted_in_their_minute():
    from pyspark.sql import Row

    processor = state.VehicleProcessor(4, 5280, 4)
    processor.init(_Handle())

    def told(*times):
        rows = [Row(**report(t, 1, 30, 0, 1, 0, 0, 10), ingest_ms=None) for t in times]
        found = processor.handleInputRows((0, 0, 1), rows, None)
        return [(r.time, r.late, r.counted, r.new_minute) for r in found]

    assert told(0, 130) == [(0, False, True, True), (130, False, True, True)]
    # overtaken: once in a minute of its own, once in one that was seen; then copies of both
    assert told(70) == [(70, True, True, True)]
    assert told(100, 70, 130) == [(100, True, True, False)]
    assert told(100, 0) == []
    assert told(1000) == [(1000, False, True, True)]
    # too late to be counted, but told
    assert told(200) == [(200, True, False, False)]
    assert told(1000, 1030) == [(1030, False, True, True)]


def test_trips_split_at_gaps_and_open_ones_wait(spark):
    times = [0, 30, 60, 300, 330, 2000]
    events = [report(t, 1, 30, 0, 1, 0, 0, t) for t in times]
    trips = _replay(spark, events, lambda e: windows.trip_stream(e, 60)).collect()
    assert sorted((t.begin_time, t.end_time, t.reports) for t in trips) == [(0, 60, 3), (300, 330, 2)]


def test_late_reports_are_dropped(spark, tmp_path):
    early = [report(t, 1, 30, 0, 1, 0, 0, t) for t in (0, 30, 900)]
    late = [report(10, 2, 30, 0, 1, 0, 0, 5), report(2000, 2, 30, 0, 1, 0, 0, 50)]
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    dropped = 0
    for batch in (early, late):
        format_lines(as_frame(spark, batch)).coalesce(1).write.mode("append").text(inbox)
        events = parse_events(read_line_stream(spark, "text", path=inbox))
        query = start_answers(
            windows.report_count_stream(events, 60),
            checkpoint,
            "parquet",
            {"availableNow": True},
            path=out,
        )
        query.awaitTermination()
        for p in query.recentProgress:
            dropped += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
    counts = {r.minute: r.reports for r in spark.read.parquet(out).collect()}
    assert counts == {1: 2, 16: 1}
    assert dropped == 1


def test_running_word_count(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for batch in ("a b c", "a e", "b c e f", "a e"):
        spark.createDataFrame([(batch,)], "value string").write.mode("append").text(inbox)
        texts = read_line_stream(spark, "text", path=inbox).withColumnRenamed("value", "text")
        replay.batches(word_count(words(texts)), checkpoint, out).awaitTermination()
    totals = spark.read.parquet(out).where("word = 'a'").orderBy("batch_id").collect()
    assert [r["count"] for r in totals] == [1, 2, 2, 3]


def test_update_mode_tells_what_changed(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for batch in ("a b c", "a e"):
        spark.createDataFrame([(batch,)], "value string").write.mode("append").text(inbox)
        texts = read_line_stream(spark, "text", path=inbox).withColumnRenamed("value", "text")
        counts = word_count(words(texts))
        replay.batches(counts, checkpoint, out, "update").awaitTermination()
    rows = spark.read.parquet(out).where("batch_id = 1").collect()
    assert sorted((r.word, r["count"]) for r in rows) == [("a", 2), ("e", 1)]


def test_one_file_at_a_time(spark, tmp_path):
    """A queue of batches: one per trigger, or all pending ones together."""
    inbox = str(tmp_path / "in")
    for batch in ("a b c", "a e", "b c e f", "a e"):
        spark.createDataFrame([(batch,)], "value string").coalesce(1).write.mode("append").text(inbox)
    for limit, batches in (({"maxFilesPerTrigger": 1}, 4), ({}, 1)):
        name = f"queue{batches}"
        lines = read_line_stream(spark, "text", path=inbox, **limit)
        texts = lines.withColumnRenamed("value", "text")
        out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")
        replay.batches(word_count(words(texts)), checkpoint, out).awaitTermination()
        got = spark.read.parquet(out)
        assert got.select("batch_id").distinct().count() == batches
        last = got.where(got.batch_id == batches - 1).where("word = 'a'").first()
        assert last["count"] == 3


def test_stream_of_a_missing_connector_says_so(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        read_line_stream(spark, "kafka", subscribe="lines", **{"kafka.bootstrap.servers": "localhost:1"})
