from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollway.schema import Params

# Second 0 of the event clock. Event times are seconds since the start of the
# recording; a stream needs a timestamp for its watermark.
CLOCK_START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_div(a, b: int) -> Column:
    """Integer quotient of non-negative numbers, as bigint."""
    return F.call_function("div", _col(a), F.lit(b))


def minute_of(time) -> Column:
    """One-based minute of a time in seconds."""
    return whole_div(time, 60) + 1


def segment_of(position, params: Params = Params()) -> Column:
    return whole_div(position, params.feet_per_segment).cast("int")


def is_travel_lane(lane) -> Column:
    """Lanes 1 to 3; 0 is the entry and 4 the exit ramp."""
    return _col(lane).between(1, 3)


def event_timestamp(time) -> Column:
    return F.timestamp_seconds(F.lit(CLOCK_START) + _col(time))


def toll_amount(lav, nov, accident, params: Params = Params()) -> Column:
    """Quadratic toll; free when traffic is fast or light, or when an accident is ahead."""
    over = _col(nov) - F.lit(params.free_vehicles)
    free = (_col(lav) >= params.lav_limit) | (over <= 0) | _col(accident)
    return F.when(free, F.lit(0)).otherwise(F.lit(2) * over * over)


def affected_segments(segment, direction, params: Params = Params()) -> Column:
    """Array of the segments whose vehicles are warned of an accident in `segment`.

    Eastbound traffic (0) comes from lower segments, westbound (1) from higher ones. The
    accident's own segment comes first, so the array index is the distance. Segments that do not
    exist are left out; an accident in one of them warns nobody.
    """
    seg = _col(segment)
    step = F.when(_col(direction) == 0, F.lit(-1)).otherwise(F.lit(1))
    on_road = lambda s: s.between(0, params.last_segment)
    reach = F.array(*[F.lit(k) for k in range(params.alert_reach + 1)])
    there = F.filter(F.transform(reach, lambda k: seg + step * k), on_road)
    return F.when(on_road(seg), there).otherwise(F.array().cast("array<int>"))
