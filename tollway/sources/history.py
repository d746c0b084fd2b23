"""Past tolls: one row per vehicle, day and expressway."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.schema import TOLL_HISTORY


KEY = ("vid", "day", "xway")
BUCKET_KEY = ("vid", "xway", "day")


def _history_lines(spark: SparkSession, path: str) -> DataFrame:
    """The file's lines as `value`, with the declared columns; a field that is no number is null."""
    fields = F.split("value", ",", -1)
    return (
        spark.read.text(path)
        .where(F.length(F.trim("value")) > 0)
        .select("value", F.explode(F.array(fields)).alias("f"))
        .select(
            "value",
            (F.size("f") == len(TOLL_HISTORY)).alias("whole"),
            *[
                F.trim(F.get("f", F.lit(i))).try_cast(c.dataType).alias(c.name)
                for i, c in enumerate(TOLL_HISTORY)
            ],
        )
    )


def _is_good() -> Column:
    good = F.col("whole")
    for c in TOLL_HISTORY:
        good = good & F.col(c.name).isNotNull()
    return good


def read_toll_history(spark: SparkSession, path: str) -> DataFrame:
    """The history file, `vid,day,xway,toll` a line: one row for each (vid, day, xway).

    Malformed lines are left out; `toll_history_rejects` has them. Of lines that differ in the
    toll only, the largest toll counts, in whatever order they come.
    """
    return (
        _history_lines(spark, path)
        .where(_is_good())
        .groupBy(*KEY)
        .agg(F.max("toll").alias("toll"))
        .select(*TOLL_HISTORY.fieldNames())
    )


def _table_name(folder: str) -> str:
    return f"toll_history_{zlib.crc32(folder.encode()):08x}"


def store_toll_history(history: DataFrame, folder: str, buckets: int | None = None) -> DataFrame:
    """The history written once as a table in buckets of (vid, xway, day), each of them sorted.

    Requests are joined with it without moving it: only the requests are shuffled, to its buckets.
    There are at least as many buckets as shuffle partitions, since Spark deals both sides anew
    where there are fewer. `folder` has to be one that all executors reach; `open_toll_history`
    opens it in another session.
    """
    spark = history.sparkSession
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        history.select(*TOLL_HISTORY.fieldNames())
        .repartition(buckets, *BUCKET_KEY)  # one file a bucket
        .write.format("parquet")
        .bucketBy(buckets, *BUCKET_KEY)
        .sortBy(*BUCKET_KEY)
        .option("path", folder)
        .saveAsTable(_table_name(folder))
    )
    return spark.table(_table_name(folder))


def open_toll_history(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """A history that `store_toll_history` wrote, with the buckets it was written in."""
    name, key = _table_name(folder), ", ".join(BUCKET_KEY)
    columns = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in TOLL_HISTORY)
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
        f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def toll_history_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the history that are neither blank nor well-formed."""
    return _history_lines(spark, path).where(~_is_good()).select("value")


def tolls_by_vehicle(history: DataFrame) -> DataFrame:
    """Each vehicle's tolls on an expressway in day order, as `day:toll` joined by commas.

    The history holds one row per (vid, xway, day), so a list is as long as the days kept;
    copies of a row, should there be any, are merged on the map side.
    """
    days = F.sort_array(F.collect_set(F.struct("day", "toll")))
    return (
        history.groupBy("vid", "xway")
        .agg(days.alias("_days"))
        .select(
            "vid",
            "xway",
            F.size("_days").alias("days"),
            F.array_join(
                F.transform("_days", lambda d: F.concat_ws(":", d["day"], d["toll"])), ","
            ).alias("tolls"),
        )
    )
