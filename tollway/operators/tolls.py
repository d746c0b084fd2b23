"""Tolls, account balances, daily expenditures and the messages that tell of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.functions import toll_amount
from tollway.operators.ordered import running, time_piece
from tollway.schema import (
    ACCIDENT_ALERT,
    ACCOUNT_BALANCE,
    DAILY_EXPENDITURE,
    POSITION_REPORT,
    SEGMENT_MINUTE,
    Params,
)


def report_segment_context(state: DataFrame, context: DataFrame) -> DataFrame:
    """Reports with the context of their segment and minute."""
    return state.join(context, SEGMENT_MINUTE).select(
        "vid", "time", "xway", "dir", "segment", "lav", "nov", "accident_segment", "is_crossing"
    )


def toll_notifications(
    crossings: DataFrame, context: DataFrame, params: Params = Params()
) -> DataFrame:
    """The toll of every chargeable crossing, told on entering the segment."""
    toll = toll_amount("lav", "nov", F.col("accident_segment") != -1, params)
    return crossings.join(context, SEGMENT_MINUTE).select(
        *["vid", "time", "xway", "dir", "segment", "lav", "nov", "accident_segment"],
        toll.alias("toll"),
    )


def account_balance(tolls: DataFrame, requests: DataFrame, params: Params = Params()) -> DataFrame:
    """The balance each request sees: the sum of the tolls told so far but the last.

    The last told toll falls due when the vehicle leaves its segment. A toll told in the
    second of the request counts as told.

    An as-of join by union and running sum over the seconds of an account: those with a toll
    and those with a request, however many requests there are. The requests then look up
    their second.
    """
    account = ["vid", "xway"]
    told = tolls.select(*account, "time", F.lit(False).alias("asks"), "toll")
    asked = (
        requests.select(*account, "time")
        .distinct()
        .selectExpr(*account, "time", "true AS asks", "CAST(NULL AS bigint) AS toll")
    )
    run = running(
        told.unionByName(asked),
        account,
        time_piece(params),
        ["time", "asks", "toll"],
        sums={"told": "toll"},
        lasts={"latest": "toll"},
    )
    at = run.where("asks").select(
        *account, "time", (F.col("told") - F.coalesce("latest", F.lit(0))).alias("balance")
    )
    return requests.join(at, [*account, "time"]).select("vid", "time", "xway", "qid", "balance")


def daily_expenditure(requests: DataFrame, history: DataFrame) -> DataFrame:
    """The past toll of the asked day and expressway; null where the history has none."""
    return requests.join(history, ["vid", "xway", "day"], "left").select(
        "vid", "time", "xway", "qid", "day", "toll"
    )


def historical_balances(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests with the tolls of the asked day on every expressway."""
    past = history.select("vid", "day", F.col("xway").alias("toll_xway"), "toll")
    return requests.join(past, ["vid", "day"]).select(
        "vid", "time", "xway", "qid", "day", "toll_xway", "toll"
    )


def all_notifications(
    tolls: DataFrame, balances: DataFrame, expenditures: DataFrame
) -> DataFrame:
    """Every answer in one table; a toll row with an accident ahead gives an alert, too."""

    def message(typ: int, *fields: str) -> Column:
        kinds = {"lav": "int", "toll": "bigint", "dir": "int", "accident_segment": "int"}
        return F.struct(
            F.lit(typ).alias("typ"),
            *[
                (F.col(c) if c in fields else F.lit(None)).cast(t).alias(c)
                for c, t in kinds.items()
            ],
        )

    told = message(POSITION_REPORT, "lav", "toll")
    alert = message(ACCIDENT_ALERT, "dir", "accident_segment")
    ahead = F.col("accident_segment") != -1
    messages = F.when(ahead, F.array(told, alert)).otherwise(F.array(told))
    toll_rows = tolls.select("vid", "time", "xway", F.explode(messages).alias("m")).select(
        "vid", "time", "xway", "m.*"
    )
    balance_rows = balances.select(
        F.lit(ACCOUNT_BALANCE).alias("typ"), "vid", "time", "xway", "qid", "balance"
    )
    daily_rows = expenditures.select(
        F.lit(DAILY_EXPENDITURE).alias("typ"),
        "vid",
        "time",
        "xway",
        "qid",
        F.col("toll").cast("bigint").alias("toll"),
    )
    return toll_rows.unionByName(balance_rows, allowMissingColumns=True).unionByName(
        daily_rows, allowMissingColumns=True
    )


def notification_line(emit: Column | None = None) -> Column:
    """A row of `all_notifications` as an output line; `emit` is the answer's latency in ms."""
    typ = F.col("typ")

    def line(*fields: str) -> Column:
        parts = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields if f != "emit"}
        if emit is not None:
            parts["emit"] = emit
        return F.concat_ws(",", *[parts[f] for f in fields if f in parts])

    return (
        F.when(typ == POSITION_REPORT, line("typ", "vid", "time", "emit", "lav", "toll"))
        .when(
            typ == ACCIDENT_ALERT,
            line("typ", "time", "emit", "xway", "accident_segment", "dir", "vid"),
        )
        .when(typ == ACCOUNT_BALANCE, line("typ", "time", "emit", "time", "qid", "balance"))
        .otherwise(line("typ", "time", "emit", "qid", "toll"))
    )


def notification_lines(notifications: DataFrame, emit: Column | None = None) -> DataFrame:
    return notifications.select(notification_line(emit).alias("value"))
