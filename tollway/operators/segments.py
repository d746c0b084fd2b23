"""Traffic per segment and minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.functions import toll_amount
from tollway.operators.accidents import accident_edges, accidents_in_force, ahead_columns
from tollway.operators.ordered import running, trailing
from tollway.schema import SEGMENT, SEGMENT_MINUTE, Params


def segment_minute_stats(state: DataFrame) -> DataFrame:
    """Speed sum, reports and vehicles (`nov`) of each segment and minute.

    A vehicle counts where it sends its first report of the minute. Partial sums are made
    before the shuffle, so a crowded segment costs one row per task.
    """
    return state.groupBy(*SEGMENT_MINUTE).agg(
        F.sum("speed").alias("speed_sum"),
        F.count("*").alias("reports"),
        F.count_if("new_minute").alias("nov"),
    )


def _rounded_mean(total: Column, count: Column) -> Column:
    """Mean rounded half up, 0 of nothing."""
    mean = F.floor(F.try_divide(total, count) + 0.5)
    return F.coalesce(mean, F.lit(0)).cast("int")


def _conditions(stats: DataFrame, params: Params) -> DataFrame:
    span = params.lav_minutes
    summed = trailing(
        stats,
        SEGMENT,
        params,
        {"_speed": ("speed_sum", span), "_reports": ("reports", span), "_nov": ("nov", 1)},
    )
    return summed.select(
        *[c for c in stats.columns if c not in ("speed_sum", "reports", "nov")],
        F.coalesce("_nov", F.lit(0)).alias("nov"),
        _rounded_mean(F.col("_speed"), F.col("_reports")).alias("lav"),
    )


def segment_conditions(stats: DataFrame, params: Params = Params()) -> DataFrame:
    """`nov` of the minute before and `lav`, the mean speed of the five minutes before."""
    return _conditions(stats, params)


def segment_context(
    stats: DataFrame, by_segment: DataFrame, params: Params = Params()
) -> DataFrame:
    """What a report finds in its segment and minute: `nov`, `lav` and the accident ahead.

    The statistics and the edges of accidents are laid over each other, one row per segment
    and minute, and swept together; `accident_segment` is -1 where nothing is ahead. Minutes
    that have an edge and no report are in it, too; no report looks them up.
    """
    ahead, counts = ahead_columns(params), ["speed_sum", "reports", "nov"]
    own = stats.selectExpr(*SEGMENT_MINUTE, *counts, *[f"0 AS {c}" for c in ahead])
    edges = accident_edges(by_segment, params).selectExpr(
        *SEGMENT_MINUTE, *[f"0L AS {c}" for c in counts], *ahead
    )
    sums = [F.sum(c).alias(c) for c in [*counts, *ahead]]
    summed = own.unionByName(edges).groupBy(*SEGMENT_MINUTE).agg(*sums)
    swept = accidents_in_force(_conditions(summed, params), params)
    return swept.selectExpr(
        *SEGMENT_MINUTE, "nov", "lav", "coalesce(accident_segment, -1) AS accident_segment"
    )


def nov(stats: DataFrame, params: Params = Params()) -> DataFrame:
    return segment_conditions(stats, params).select(*SEGMENT_MINUTE, "nov")


def lav(stats: DataFrame, params: Params = Params()) -> DataFrame:
    return segment_conditions(stats, params).select(*SEGMENT_MINUTE, "lav")


def nov_distinct(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Distinct vehicles of the minute and of the minute before."""
    seen = reports.groupBy(*SEGMENT_MINUTE).agg(F.count_distinct("vid").alias("vehicles"))
    before = trailing(seen, SEGMENT, params, {"_before": ("vehicles", 1)})
    return before.select(*SEGMENT_MINUTE, "vehicles", F.coalesce("_before", F.lit(0)).alias("nov"))


def lav_mean_of_minutes(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Mean of the minutes' mean speeds over the five minutes before, a silent minute being 0."""
    means = reports.groupBy(*SEGMENT_MINUTE).agg(F.avg("speed").alias("mean_speed"))
    span = params.lav_minutes
    summed = trailing(means, SEGMENT, params, {"_sum": ("mean_speed", span)})
    return summed.select(
        *SEGMENT_MINUTE,
        F.round(F.coalesce(F.col("_sum"), F.lit(0.0)) / span, 6).alias("lav"),
    )


def segment_minute_report_count(reports: DataFrame) -> DataFrame:
    return reports.groupBy(*SEGMENT_MINUTE).agg(F.count("*").alias("reports"))


def _arrival(params: Params) -> str:
    """Pieces of one second of a segment: at most `piece_vehicles` rows, as each vehicle
    reports once a second."""
    return f"struct(time, coalesce(vid div {params.piece_vehicles}, 0) AS vehicles)"


def running_speed_sum(reports: DataFrame, params: Params = Params()) -> DataFrame:
    """Reports with the count and speed sum of their segment and minute so far."""
    columns = ["time", "vid", "speed", "one"]
    rows = reports.select(*SEGMENT_MINUTE, "time", "vid", "speed", F.lit(1).alias("one"))
    return running(
        rows,
        SEGMENT_MINUTE,
        _arrival(params),
        columns,
        sums={"reports": "one", "speed_sum": "speed"},
    ).drop("one", "speed")


def running_crossing_stats(state: DataFrame, params: Params = Params()) -> DataFrame:
    """As `running_speed_sum`, with the vehicles that crossed into the segment so far."""
    columns = ["time", "vid", "speed", "one", "crossed"]
    rows = state.select(
        *SEGMENT_MINUTE,
        "time",
        "vid",
        "speed",
        F.lit(1).alias("one"),
        F.col("is_crossing").cast("int").alias("crossed"),
    )
    return running(
        rows,
        SEGMENT_MINUTE,
        _arrival(params),
        columns,
        sums={"crossings": "crossed", "reports": "one", "speed_sum": "speed"},
    ).drop("one", "speed", "crossed")


def vehicle_minute_speed(reports: DataFrame) -> DataFrame:
    return reports.groupBy("vid", "minute").agg(F.avg("speed").alias("mean_speed"))


def minute_speed(vehicle_speeds: DataFrame) -> DataFrame:
    """Mean over the vehicles of their mean speed in a minute."""
    return vehicle_speeds.groupBy("minute").agg(F.round(F.avg("mean_speed"), 6).alias("mean_speed"))


def single_report_segments(events: DataFrame) -> DataFrame:
    """Segments of which a vehicle sent exactly one report."""
    counted = events.groupBy("vid", "segment").agg(F.count("*").alias("reports"))
    return counted.where(F.col("reports") == 1)


def segment_tolls(
    stats: DataFrame, accident_minutes: DataFrame, params: Params = Params()
) -> DataFrame:
    """Each segment and minute with the statistics and toll of the minute before.

    The toll goes by the minute's own mean speed and number of reports. Where the minute
    before has no statistics, they are zeros.
    """
    joined = stats.join(accident_minutes, SEGMENT_MINUTE)
    own = joined.select(
        *SEGMENT_MINUTE,
        "reports",
        "speed_sum",
        F.col("accident").cast("int").alias("accident"),
        toll_amount(
            F.col("speed_sum") / F.col("reports"), F.col("reports"), F.lit(False), params
        ).alias("toll"),
    )
    before = trailing(
        own,
        SEGMENT,
        params,
        {
            "_reports": ("reports", 1),
            "_speed": ("speed_sum", 1),
            "_accident": ("accident", 1),
            "_toll": ("toll", 1),
        },
    )

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    return before.select(
        *SEGMENT_MINUTE,
        zero("_reports").alias("vehicles"),
        zero("_speed").cast("double").alias("speed_sum"),
        (zero("_accident") > 0).alias("accident"),
        zero("_toll").cast("double").alias("toll"),
    )
