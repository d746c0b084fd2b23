"""Small tables with everything odd in them, and helpers of the operators' tests."""

from __future__ import annotations

import random
import re

SPACES = r"[^\x20\x09-\x0D]+"

#: Columns that clash with names the operators use inside.
EXTRA = "extra string, id string, th int, n long, failed long, blob string, key string, row int"


def words(text: str | None) -> list[str]:
    return re.findall(SPACES, text or "")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """Text of n made-up words, with lines."""
    rng = random.Random(seed)
    some = [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in some).strip()


def odd_documents() -> list[tuple[int | None, str | None]]:
    long = prose(1, 4_000, 50_000)
    near = prose(2, 120).split(" ")
    near[60:61] = ["changed"]
    return [
        (1, prose(2, 120)),
        (2, prose(2, 120)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one"),
        (8, "Two words"),
        (9, long),
        (10, long + " and more"),
        (11, "a\nb\nc\nd\n\n" + prose(3, 60) + "\na\nb\nc\nd"),
        (None, prose(4, 80)),
        (12, prose(5, 70)),
        (12, prose(5, 70)),
        (13, "ÄÖÜ ß é 中文 \U0001f600 " * 20),
        (14, "same same same " * 40),
    ]


def documents(spark, rows=None):
    """A table of (doc_id, text) with more columns, some of clashing names."""
    rows = odd_documents() if rows is None else rows
    data = [(k, t, "x", "y", 1, 2, 3, "b", "k", 4) for k, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {EXTRA}")
