"""The live application: lines from a topic in, answers to a topic out.

    spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:<spark version> \\
        tollway/app.py CHECKPOINT INPUT_TOPIC OUTPUT_TOPIC TOLL_HISTORY BROKER [--late-topic TOPIC]

CHECKPOINT and TOLL_HISTORY are on storage that all executors reach. A run that stopped goes
on where it was when it is started again with the same checkpoint.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tollway.session import with_settings  # noqa: E402
from tollway.sources.history import read_toll_history  # noqa: E402
from tollway.sources.lines import parse_events, read_line_stream  # noqa: E402
from tollway.streaming import event_time  # noqa: E402
from tollway.streaming.live import answer_stream, line_stream, start_answers  # noqa: E402


def answer_lines(lines: DataFrame, history: DataFrame) -> DataFrame:
    return line_stream(answer_stream(parse_events(lines), history))


def topic_lines(
    lines: DataFrame, history: DataFrame, topic: str, late_topic: str, delay_seconds: int,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Answers in event time and late reports, each line with its `topic`: one sink writes both."""
    rows = event_time.ordered_answers(parse_events(lines), history, delay_seconds, idle_seconds)
    return event_time.lines_by_topic(rows, topic, late_topic)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Answer vehicles' reports and requests.")
    parser.add_argument("checkpoint")
    parser.add_argument("input_topic")
    parser.add_argument("output_topic")
    parser.add_argument("toll_history")
    parser.add_argument("broker")
    parser.add_argument("--shuffle-partitions", type=int, default=200)
    parser.add_argument(
        "--max-offsets", type=int, default=10_000_000, help="most lines taken in by a micro-batch"
    )
    parser.add_argument(
        "--pattern", action="store_true", help="INPUT_TOPIC is a pattern of topic names"
    )
    parser.add_argument(
        "--starting-offsets", default="latest", help="latest, earliest, or offsets as JSON"
    )
    parser.add_argument(
        "--late-topic",
        help="wait for reports out of order, and tell those that come too late on this topic",
    )
    parser.add_argument(
        "--delay", type=int, default=60, help="seconds to wait, with --late-topic"
    )
    parser.add_argument(
        "--idle", type=int, help="seconds after which a silent vehicle is given up, with --late-topic"
    )
    return parser.parse_args(argv)


def source_options(args: argparse.Namespace) -> dict[str, str | int]:
    """Options of the broker's source."""
    return {
        "subscribePattern" if args.pattern else "subscribe": args.input_topic,
        "startingOffsets": args.starting_offsets,
        "maxOffsetsPerTrigger": args.max_offsets,
        "kafka.bootstrap.servers": args.broker,
    }


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    builder = SparkSession.builder.appName("tollway")
    spark = with_settings(builder, args.shuffle_partitions).getOrCreate()
    lines = read_line_stream(spark, "kafka", **source_options(args))
    history = read_toll_history(spark, args.toll_history)
    sink = {"kafka.bootstrap.servers": args.broker}
    if args.late_topic:
        answers = topic_lines(
            lines, history, args.output_topic, args.late_topic, args.delay, args.idle
        )
    else:
        answers = answer_lines(lines, history)
        sink["topic"] = args.output_topic
    start_answers(answers, args.checkpoint, "kafka", **sink).awaitTermination()


if __name__ == "__main__":
    main()
