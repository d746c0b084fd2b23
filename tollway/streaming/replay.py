"""Feeding a recording to a streaming query, slice by slice, and reading the answers back.

Each slice is written as files and taken in by one run of the query, which then stops. The
next run goes on from the checkpoint, as after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.sources.lines import parse_events, read_line_stream
from tollway.sources.workdir import new_folder
from tollway.streaming.live import stream_settings


def by_time(lines: DataFrame, horizon: int, slices: int) -> DataFrame:
    """Lines with the slice of the recording they belong to; lines without a time go first."""
    time = F.get(F.split("value", ","), F.lit(1)).try_cast("bigint")
    at = F.call_function("div", F.coalesce(time, F.lit(0)) * slices, F.lit(horizon + 1))
    return lines.select("value", at.alias("slice"))


# Files a slice is spread over, so that no slice is written by one task.
FILES_PER_SLICE = 32


def _staged(sliced: DataFrame, folder: str, files: int = 1) -> None:
    """Lay the lines out by slice; the more files a slice is to have, the more tasks write it."""
    spread = F.pmod(F.xxhash64("value"), F.lit(max(FILES_PER_SLICE, files)))
    sliced.repartition("slice", spread).write.partitionBy("slice").text(folder)


def run_slices(
    spark: SparkSession,
    sliced: DataFrame,
    slices: int,
    start: Callable[[DataFrame, str], object],
    name: str,
    partitions: int | None = None,
) -> str:
    """Run `start(line stream, checkpoint)` to the end of each slice in turn; the checkpoint.

    The lines are laid out by slice first, so that each of them is read once more only.
    """
    staged, inbox, checkpoint = (
        new_folder(spark, f"{name}-{part}") for part in ("staged", "in", "state")
    )
    _staged(sliced, staged)
    for i in range(slices):
        part = spark.read.schema("value string, slice bigint").text(staged)
        part.where(F.col("slice") == i).select("value").write.mode("append").text(inbox)
        with stream_settings(spark, partitions):
            start(read_line_stream(spark, "text", path=inbox), checkpoint).awaitTermination()
    return checkpoint


def replayed(
    spark: SparkSession,
    sliced: DataFrame,
    slices: int,
    build: Callable[[DataFrame], DataFrame],
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """What `build(event stream)` appends while the slices are fed to it, as a table."""
    out = new_folder(spark, f"{name}-out")
    schema = []

    def start(lines: DataFrame, checkpoint: str):
        answers = build(parse_events(lines))
        schema[:] = [answers.schema]
        return (
            answers.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    run_slices(spark, sliced, slices, start, name, partitions)
    return spark.read.schema(schema[0]).parquet(out)


def in_one_start(
    spark: SparkSession,
    sliced: DataFrame,
    slices: int,
    start: Callable[[DataFrame, str], object],
    name: str,
    closing: int,
    partitions: int | None = None,
    files: int = 1,
):
    """Run `start(line stream, checkpoint)` once over all slices, a micro-batch for each.

    A slice is `files` files. Behind the last one comes a line that is no report or request, at
    second `closing`: it moves the watermark past everything, so that what waits is told.
    """
    staged, inbox, checkpoint = (
        new_folder(spark, f"{name}-{part}") for part in ("staged", "in", "state")
    )
    _staged(sliced, staged, files)
    layout = "value string, slice bigint"
    for i in range(slices):
        part = spark.read.schema(layout).text(staged).where(F.col("slice") == i).select("value")
        part.repartition(files).write.mode("append").text(inbox)
    last = f"-1,{closing}" + ",-1" * 13
    end = spark.range(files).select(F.lit(last).alias("value"))
    end.repartition(files).write.mode("append").text(inbox)
    lines = read_line_stream(spark, "text", path=inbox, maxFilesPerTrigger=files)
    with stream_settings(spark, partitions):
        query = start(lines, checkpoint)
        query.awaitTermination()
    return query


def batches(
    totals: DataFrame,
    checkpoint: str,
    out: str,
    mode: str = "complete",
    partitions: int | None = None,
):
    """Run `totals` over all available input, keeping each micro-batch's result apart.

    The batch number becomes the column `batch_id` of the table in `out`; a batch that is
    run again after a failure replaces its own folder only.
    """

    def keep(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with stream_settings(totals.sparkSession, partitions):
        return (
            totals.writeStream.outputMode(mode)
            .foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
