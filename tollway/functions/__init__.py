"""Column expressions of the tolling rules; all run inside the JVM."""

from tollway.functions.road import (
    affected_segments,
    event_timestamp,
    is_travel_lane,
    minute_of,
    segment_of,
    toll_amount,
    whole_div,
)

__all__ = [
    "affected_segments",
    "event_timestamp",
    "is_travel_lane",
    "minute_of",
    "segment_of",
    "toll_amount",
    "whole_div",
]
