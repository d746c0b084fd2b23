"""The cut scans against plain Python, whatever the piece."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from tollway.operators.ordered import running, trailing, with_previous
from tollway.schema import Params

PIECES = [None, 1, 7, 50, 10_000]


def _rows(seed: int) -> list[tuple]:
    """(k, t, v): one group has a third of the rows; t is distinct in a group."""
    rnd = random.Random(seed)
    rows = []
    for k, n in [(0, 60), (1, 40), (2, 40), (3, 39), (4, 1)]:
        for t in rnd.sample(range(400), n):
            rows.append((k, t, rnd.choice([None, *range(-3, 9)])))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t bigint, v bigint")


def _piece(width):
    return None if width is None else f"t div {width}"


@pytest.mark.parametrize("width", PIECES)
@pytest.mark.parametrize("down", [False, True])
def test_with_previous(spark, width, down):
    rows = _rows(1)
    order = ["t DESC", "v DESC"] if down else ["t", "v"]
    got = with_previous(_frame(spark, rows), ["k"], _piece(width), order, {"v": 3, "t": 1})
    want = []
    for k in range(5):
        group = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if down else r[1])
        for i, r in enumerate(group):
            back = [group[i - j] if i >= j else (None, None, None) for j in (1, 2, 3)]
            want.append((*r, *[b[2] for b in back], back[0][1]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("width", PIECES)
def test_running(spark, width):
    rows = _rows(2)
    got = running(
        _frame(spark, rows),
        ["k"],
        _piece(width),
        ["t", "v"],
        sums={"total": "v"},
        lasts={"latest": "v"},
    )
    want = []
    for k in range(5):
        total, latest = 0, None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if r[2] is not None:
                total, latest = total + r[2], r[2]
            want.append((*r, total, latest))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [6, 50, 10_000])
def test_trailing(spark, width):
    rows = _rows(3)
    params = replace(Params(), piece_minutes=width)
    df = _frame(spark, rows).withColumnRenamed("t", "minute")
    got = trailing(df, ["k"], params, {"five": ("v", 5), "one": ("v", 1)})

    def total(k, t, n):
        vs = [v for k2, t2, v in rows if k2 == k and t - n <= t2 < t and v is not None]
        return sum(vs) if vs else None

    want = [(*r, total(r[0], r[1], 5), total(r[0], r[1], 1)) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
