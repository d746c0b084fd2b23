"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document are hashed. A window found more than once anywhere is
kept where it comes first, by id and then by position; the lines of all later occurrences go.
Overlapping occurrences are merged into one removed span.

A line is counted with the lines without a word that follow it, so blank lines neither make nor
break a window and go with the line before them. Lines are compared without the spaces around
them. A document of fewer than three lines has no window and stays as it is.

Nulls and odd input: a null text has no lines and stays null; an empty one stays empty. A null id
comes before all others. Rows that repeat both id and text are one document: they are edited
alike, and are no copies of each other. Rows that share only the id are told apart by a hash of
the text. Other columns, whatever their names, are carried along. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import free_prefix, whole

WIDTH = 3
# a line break before a line that has a word
_BREAK = r"\n(?=[^\n]*[^\x20\x09-\x0D])"


def _units(text: Column) -> Column:
    """Lines, each with the blank lines after it."""
    return F.when(whole(text) == "", F.array().cast("array<string>")).otherwise(
        F.split(text, _BREAK, -1)
    )


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """One row for each window: (id, th, pos, h1, h2), with 128 bits of hash."""
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.hash(text_col).alias("th"),
        F.transform(
            _units(F.col(text_col)), lambda unit: F.trim(F.substring_index(unit, "\n", 1))
        ).alias("lines"),
    )
    parts = ", ".join(f"get(lines, i + {k})" for k in range(width))
    hashes = lines.select(
        "id",
        "th",
        F.posexplode(
            F.expr(
                f"transform(slice(lines, 1, greatest(size(lines) - {width - 1}, 0)), (x, i) ->"
                f" struct(xxhash64({parts}) as h1, xxhash64('second', {parts}) as h2))"
            )
        ).alias("pos", "h"),
    )
    return hashes.select("id", "th", "pos", "h.h1", "h.h2")


def later_windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, th, at): the positions of a document's windows that came earlier elsewhere, sorted."""
    rows = windows(docs, id_col, text_col, width)
    firsts = (
        rows.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    later = rows.join(firsts.drop("n"), ["h1", "h2"]).where(
        ~F.struct("id", "th", "pos").eqNullSafe(F.col("first"))
    )
    return later.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """`docs` with repeated lines taken out of the text, and `n_lines` and `n_removed` (long).

    If the table has columns of these two names, they are replaced.
    """
    p = free_prefix(docs, "__l")
    later = later_windows(docs, id_col, text_col, width).select(
        F.col("id").alias(f"{p}id"), F.col("th").alias(f"{p}th"), F.col("at").alias(f"{p}at")
    )
    joined = (
        docs.withColumn(f"{p}hash", F.hash(text_col))
        .join(
            later,
            F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}th")),
            "left",
        )
        .withColumn(f"{p}units", _units(F.col(text_col)))
    )
    # what is kept lies before the first removed window, between two, and after the last
    between = F.expr(
        f"flatten(concat(array(slice({p}units, 1, {p}at[0])),"
        f" transform({p}at, (x, i) -> slice({p}units, x + {width + 1},"
        f" greatest(coalesce(get({p}at, i + 1), size({p}units)) - x - {width}, 0)))))"
    )
    step = joined.withColumn(
        f"{p}kept", F.when(F.col(f"{p}at").isNull(), F.col(f"{p}units")).otherwise(between)
    )
    replaced = {
        text_col: F.when(F.col(f"{p}at").isNull(), F.col(text_col)).otherwise(
            F.array_join(f"{p}kept", "\n")
        )
    }
    own = ("n_lines", "n_removed")
    return step.select(
        *[
            replaced.get(c, F.col(f"`{c}`")).alias(c)
            for c in docs.columns
            if c.lower() not in own
        ],
        F.size(f"{p}units").cast("long").alias("n_lines"),
        (F.size(f"{p}units") - F.size(f"{p}kept")).cast("long").alias("n_removed"),
    )
