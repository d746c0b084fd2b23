"""Lines of a slice are laid out by many tasks, however few slices there are."""

from __future__ import annotations

from pathlib import Path

from tollway.sources.workdir import new_folder
from tollway.streaming import replay


def test_a_slice_is_staged_by_many_tasks(spark, monkeypatch):
    folders = []

    def folder(spark, name):
        folders.append(new_folder(spark, name))
        return folders[-1]

    monkeypatch.setattr(replay, "new_folder", folder)
    lines = spark.range(2000).selectExpr("concat('0,', id) AS value", "id % 2 AS slice")
    out = new_folder(spark, "staging-out")

    def start(lines, checkpoint):
        return (
            lines.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        replay.in_one_start(spark, lines, 2, start, "staging", 9)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    staged = next(Path(f) for f in folders if "staging-staged" in f)
    assert all(len(list((staged / f"slice={i}").glob("*.txt"))) > 1 for i in range(2))
    told = spark.read.parquet(out).where("value NOT LIKE '-1,%'")
    assert told.count() == told.distinct().count() == 2000
