"""Input lines: 15 comma-separated fields, parsed into `EVENT_SCHEMA`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.schema import (
    EVENT_KEY,
    EVENT_SCHEMA,
    EXIT_LANE,
    LINE_FIELDS,
    POSITION_REPORT,
    Params,
)


def _attempt(lines: DataFrame) -> DataFrame:
    """Every non-blank line with its fields; a field that is absent or no number is null.

    The split is exploded as an array of one, so that filters on the fields stay above it
    and a line is split once, not once for every field.
    """
    keep = [c for c in ("timestamp",) if c in lines.columns]
    fields = F.explode(F.array(F.split(F.trim("value"), ",", -1))).alias("_fields")
    return (
        lines.where(F.length(F.trim("value")) > 0)
        .select("value", *keep, fields)
        .select(
            "value",
            *keep,
            *[
                F.get("_fields", F.lit(LINE_FIELDS.index(f.name)))
                .try_cast(f.dataType)
                .alias(f.name)
                for f in EVENT_SCHEMA
            ],
        )
    )


def _bad_field(params: Params) -> Column:
    """Name of the first field that is no value, or that is out of range; null if all are good.

    Only position reports have to have a place: in requests these fields are unused.
    """
    missing = [F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in EVENT_SCHEMA]
    report = F.col("typ") == POSITION_REPORT
    ranges = [
        ("time", F.col("time") >= 0),
        ("lane", ~report | F.col("lane").between(0, EXIT_LANE)),
        ("dir", ~report | F.col("dir").between(0, 1)),
        ("segment", ~report | F.col("segment").between(0, params.last_segment)),
    ]
    return F.coalesce(*missing, *[F.when(~ok, F.lit(name)) for name, ok in ranges])


def parse_events(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """Events of the well-formed lines: every field is there and, in reports, on the road.

    `lines` has `value string` and, from a message broker, `timestamp`, which becomes
    `ingest_ms` (null elsewhere). Blank lines are skipped; `parse_rejects` gives the rest.
    """
    ingest = (
        F.unix_millis("timestamp") if "timestamp" in lines.columns else F.lit(None).cast("bigint")
    )
    return _attempt(lines).where(_bad_field(params).isNull()).select(
        *EVENT_SCHEMA.fieldNames(), ingest.alias("ingest_ms")
    )


def parse_rejects(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """The lines that are neither blank nor well-formed, with the first bad field's name."""
    tried = _attempt(lines).select("value", _bad_field(params).alias("bad_field"))
    return tried.where(F.col("bad_field").isNotNull())


def distinct_events(events: DataFrame) -> DataFrame:
    """One event per (typ, vid, time, xway, dir, qid).

    Copies are merged on the map side before the shuffle, so a much-repeated event costs one
    row per task. Of differing rows with one key the smallest is kept, whatever the order.
    """
    rest = [c for c in events.columns if c not in EVENT_KEY]
    kept = events.groupBy(*EVENT_KEY).agg(F.min(F.struct(*rest)).alias("_kept"))
    return kept.select(*[F.col(f"_kept.{c}") if c in rest else F.col(c) for c in events.columns])


def event_line() -> Column:
    """An event as an input line; the unused fields are -1."""
    have = set(EVENT_SCHEMA.fieldNames())
    return F.concat_ws(
        ",", *[F.col(f).cast("string") if f in have else F.lit("-1") for f in LINE_FIELDS]
    )


def format_lines(events: DataFrame) -> DataFrame:
    return events.select(event_line().alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_line_stream(spark: SparkSession, fmt: str = "kafka", **options) -> DataFrame:
    """Lines as a stream, as `value string` and, where the source has one, `timestamp`.

    `fmt` is any line source: "kafka" (needs the connector on the class path; give
    `kafka.bootstrap.servers` and `subscribe` or `subscribePattern`; starts at the latest
    offset unless told otherwise), "socket", or "text" with `path`.
    """
    if fmt == "kafka":
        options.setdefault("startingOffsets", "latest")
    raw = spark.readStream.format(fmt).options(**options).load()
    if "timestamp" in raw.columns:
        return raw.select(F.col("value").cast("string"), "timestamp")
    return raw.select(F.col("value").cast("string"))
