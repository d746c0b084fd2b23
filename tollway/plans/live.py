"""The batch form of the live path: events and toll history in, answers out."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators import accidents as acc
from tollway.operators import reports as rep
from tollway.operators import segments as seg
from tollway.operators import tolls as tol
from tollway.operators import vehicles as veh
from tollway.operators.ordered import time_piece
from tollway.schema import Params
from tollway.sources.lines import distinct_events
from tollway.sources.workdir import written


def measured(events: DataFrame, params: Params = Params()) -> Params:
    """`params` with the recording's last second, found by a scan of the `time` column."""
    last = events.agg(F.max("time")).first()[0]
    return replace(params, horizon=int(last or 0))


class LivePath:
    """The operators wired together over one events table; the attributes are DataFrames.

    The statistics, the accidents and the crossings all start from `state`. Its shuffle is
    the same in all of them, so Spark runs it once and reads it again. All of it is lazy,
    unless `write_steps` is set: each step is then written to the shared folder where it is
    first used, and read from there. That is the default for a recording so long that groups
    are cut, as each cut reads its input twice.

    Copies of events are dropped first, unless the source is known to have none.
    """

    def __init__(
        self,
        events: DataFrame,
        history: DataFrame,
        params: Params = Params(),
        write_steps: bool | None = None,
        has_copies: bool = True,
    ):
        self.events = distinct_events(events) if has_copies else events
        self.history = history
        self.params = params
        self.write_steps = time_piece(params) is not None if write_steps is None else write_steps

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if self.write_steps else df

    @cached_property
    def reports(self) -> DataFrame:
        return rep.position_reports(self.events)

    @cached_property
    def state(self) -> DataFrame:
        return self._step(veh.vehicle_state(self.reports, self.params), "state")

    @cached_property
    def crossings(self) -> DataFrame:
        return veh.segment_crossings(self.state)

    @cached_property
    def stop_changes(self) -> DataFrame:
        return self._step(veh.stop_changes(self.state), "stop_changes")

    @cached_property
    def stats(self) -> DataFrame:
        return self._step(seg.segment_minute_stats(self.state), "stats")

    @cached_property
    def conditions(self) -> DataFrame:
        return seg.segment_conditions(self.stats, self.params)

    @cached_property
    def accidents(self) -> DataFrame:
        return self._step(acc.accidents_by_segment(self.stop_changes, self.params), "accidents")

    @cached_property
    def zones(self) -> DataFrame:
        return acc.accident_zones(self.accidents, self.stats, self.params)

    @cached_property
    def context(self) -> DataFrame:
        return self._step(seg.segment_context(self.stats, self.accidents, self.params), "context")

    @cached_property
    def tolls(self) -> DataFrame:
        tolls = tol.toll_notifications(self.crossings, self.context, self.params)
        return self._step(tolls, "tolls")

    @cached_property
    def alerts(self) -> DataFrame:
        return acc.accident_alerts(self.crossings, self.zones)

    @cached_property
    def balances(self) -> DataFrame:
        return tol.account_balance(self.tolls, rep.balance_requests(self.events), self.params)

    @cached_property
    def expenditures(self) -> DataFrame:
        return tol.daily_expenditure(rep.expenditure_requests(self.events), self.history)

    @cached_property
    def notifications(self) -> DataFrame:
        return tol.all_notifications(self.tolls, self.balances, self.expenditures)
