"""Exact ordered scans over groups of any size.

A window function sends each group to one task, and a group here (a vehicle, an account, a
segment) may hold a large share of all rows. Its rows have distinct times, though, so a
recording known to end within `piece_seconds` bounds the group, and a plain window will do.

Otherwise every group is cut into pieces along the order, `piece_seconds` each, and the
window runs over (group, piece). What a piece needs from the pieces before it is small: the
last few rows, or a running total. It is taken from the tail rows of each piece, walked over
the pieces of the group (one row or a few per piece), and joined back on (group, piece).
Both branches read the same shuffle of (group, piece). Spark reuses that exchange when both
need the same columns and filters. That is why callers order by all columns they keep (the
order is then total, too, and a retried task sees the same rows in the same places) and why
the filters the join would put on one branch, that keys are not null, are put on both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tollway.schema import Params

PIECE = "_piece"


def time_piece(params: Params) -> str | None:
    """Pieces along `time`; None where one piece is known to hold the whole recording."""
    if params.horizon is not None and params.horizon < params.piece_seconds:
        return None
    return f"coalesce(time div {params.piece_seconds}, 0)"


def minute_piece(params: Params) -> str | None:
    """Pieces along `minute`, likewise."""
    if params.horizon is not None and params.horizon // 60 + 1 < params.piece_minutes:
        return None
    return f"coalesce(minute div {params.piece_minutes}, 0)"


def _over(keys: Sequence[str], order: Sequence[str], frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)} {frame})"


def _cut(df: DataFrame, keys: Sequence[str], piece: str) -> DataFrame:
    """`df` with its piece. Keys are never null; saying so keeps both branches alike."""
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return df.where(known).selectExpr("*", f"{piece} AS {PIECE}")


_UP_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    piece: str | None,
    order: Sequence[str],
    fields: Mapping[str, int],
) -> DataFrame:
    """Add `<field>_<k>`: the field's value k rows earlier in the group, for k = 1..depth.

    `fields` maps a column to its depth. `piece` must not decrease along `order` (or not
    increase, when the order descends). Values before the first row are null.
    """
    back = [(f, k) for f, depth in fields.items() for k in range(1, depth + 1)]
    along = _over(keys, order)
    if piece is None:
        return df.selectExpr("*", *[f"lag({f}, {k}) {along} AS {f}_{k}" for f, k in back])

    part = [*keys, PIECE]
    here = _over(part, order)
    cut = _cut(df, keys, piece)
    inside = cut.selectExpr(
        "*", f"row_number() {here} AS _rn", *[f"lag({f}, {k}) {here} AS _{f}_{k}" for f, k in back]
    )

    # The last rows of each piece, as many as are looked back at; then the very last one of
    # them with those before it, for the piece that follows.
    tails = cut.selectExpr("*", f"lead(1, {max(fields.values())}) {here} AS _more")
    carried = (
        tails.where("_more IS NULL")
        .selectExpr(
            *keys,
            f"{PIECE} AS _from",
            f"lead({PIECE}) {along} AS {PIECE}",
            *[f"lag({f}, {k - 1}) {along} AS _c_{f}_{k}" for f, k in back],
        )
        .where(f"{PIECE} <> _from")
        .drop("_from")
    )

    def reach(f: str, k: int) -> str:
        before = " ".join(f"WHEN _rn = {rn} THEN _c_{f}_{k - rn + 1}" for rn in range(1, k + 1))
        return f"CASE WHEN _rn > {k} THEN _{f}_{k} {before} END AS {f}_{k}"

    joined = inside.join(carried, part, "left")
    return joined.selectExpr(*df.columns, *[reach(f, k) for f, k in back])


def running(
    df: DataFrame,
    keys: Sequence[str],
    piece: str | None,
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums and last non-null values over each group, current row included.

    `sums` and `lasts` map the new column to the column it runs over. A sum is 0 and a last
    value null until something non-null was seen.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if piece is None:
        whole = _over(keys, order, _UP_TO_HERE)
        return df.selectExpr(
            "*",
            *[f"coalesce(sum({c}) {whole}, 0) AS {n}" for n, c in sums.items()],
            *[f"last({c}) IGNORE NULLS {whole} AS {n}" for n, c in lasts.items()],
        )

    part = [*keys, PIECE]
    upto = _over(part, order, _UP_TO_HERE)
    inside = _cut(df, keys, piece).selectExpr(
        "*",
        *[f"sum({c}) {upto} AS _{n}" for n, c in sums.items()],
        *[f"last({c}) IGNORE NULLS {upto} AS _{n}" for n, c in lasts.items()],
        f"lead(1) {_over(part, order)} AS _more",
    )
    along, before = _over(keys, [PIECE]), _over(keys, [PIECE], _BEFORE)
    carried = (
        inside.where("_more IS NULL")
        .selectExpr(
            *part,
            f"lag(1) {along} AS _earlier",
            *[f"sum(_{n}) {before} AS _c_{n}" for n in sums],
            *[f"last(_{n}) IGNORE NULLS {before} AS _c_{n}" for n in lasts],
        )
        .where("_earlier IS NOT NULL")
        .drop("_earlier")
    )
    return (
        inside.drop("_more")
        .join(carried, part, "left")
        .selectExpr(
            *df.columns,
            *[f"coalesce(_{n}, 0) + coalesce(_c_{n}, 0) AS {n}" for n in sums],
            *[f"coalesce(_{n}, _c_{n}) AS {n}" for n in lasts],
        )
    )


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    params: Params,
    sums: Mapping[str, tuple[str, int]],
) -> DataFrame:
    """Add sums over the rows of the 1..n minutes before the current row's `minute`.

    `sums` maps the new column to (column, n). A row that frames of the next piece reach is
    copied into it, so no frame looks outside its piece and nothing has to be carried.
    """

    def summed(rows: DataFrame, part: Sequence[str]) -> DataFrame:
        frames = {n: f"RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING" for _, n in sums.values()}
        return rows.selectExpr(
            "*",
            *[f"sum({c}) {_over(part, ['minute'], frames[n])} AS {o}" for o, (c, n) in sums.items()],
        )

    home = minute_piece(params)
    if home is None:
        return summed(df, keys)
    width, length = max(n for _, n in sums.values()), params.piece_minutes
    pieces = (
        f"CASE WHEN minute % {length} >= {length - width} THEN array({home}, {home} + 1) "
        f"ELSE array({home}) END"
    )
    spread = df.selectExpr("*", f"explode({pieces}) AS {PIECE}")
    return summed(spread, [*keys, PIECE]).where(f"{PIECE} = {home}").drop(PIECE)
