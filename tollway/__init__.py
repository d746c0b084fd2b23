"""Variable road tolling on Spark: stops, accidents, segment statistics, tolls and accounts."""

from tollway.schema import Params

__all__ = ["Params"]
