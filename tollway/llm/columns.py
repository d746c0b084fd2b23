"""Column expressions and table helpers that several text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.sources.workdir import new_folder

# white space of the word rules: space, and tab through carriage return
OTHER_SPACES = "\t\n\x0b\f\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text that is not null, in order.

    Plain replacing and splitting at one character; a pattern takes several times as long.
    """
    for other in OTHER_SPACES:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def lines(text: Column) -> Column:
    """Lines of a text that have a word, as they are."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like `base` that `df` does not have (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def where_computed(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Rows that meet a condition on columns that took much to compute.

    The optimizer would move a plain filter below the projections and put their expressions in
    place of the columns, each as often as it is named. It does not move one past a row number;
    `name` is a free column name for that.
    """
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    return numbered.where(condition & (F.col(name) >= 0)).drop(name)


def free_prefix(df: DataFrame, base: str) -> str:
    """A prefix like `base` that no column of `df` starts with."""
    prefix = base
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def digest(*columns: Column) -> Column:
    """128 bits over the columns, as 32 hex characters; equal rows have equal digests.

    Lengths go in, so that neighbouring columns cannot trade characters.
    """
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns]
    return F.md5(F.concat(*parts))


def store(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a new folder below the shared one, and read back.

    Cuts the lineage: what follows survives the loss of executors without computing `df` again.
    """
    return read_stored(df.sparkSession, write_new(df, name), df)


def write_new(df: DataFrame, name: str) -> str:
    path = new_folder(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return path


def read_stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
