"""Word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(texts: DataFrame) -> DataFrame:
    """The words of `text`, split at spaces, tabs and line ends."""
    split = F.explode(F.split("text", "[ \\t\\r\\n]+"))
    return texts.select(split.alias("word")).where(F.length("word") > 0)


def word_count(word_rows: DataFrame) -> DataFrame:
    return word_rows.groupBy("word").agg(F.count("*").alias("count"))
