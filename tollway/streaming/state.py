"""Keyed state of the streaming path, for `transformWithState`.

Each processor keeps a few numbers per key and handles one key's rows of a micro-batch in
time order. This module is sent to the executors with the query, so it imports nothing of
the package; the rules it needs come in as plain numbers.
"""

from __future__ import annotations

from collections import namedtuple
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

VEHICLE_STATE = (
    "vid int, time bigint, speed int, xway int, lane int, dir int, segment int, position int, "
    "minute bigint, is_stopped boolean, is_crossing boolean, new_minute boolean, "
    "stop_began boolean, stop_ended boolean, last_lane int, last_position int, "
    "last_segment int, ingest_ms bigint, late boolean, counted boolean"
)

# Reports of a vehicle side by side in one row, and their states: what a row costs on its way to a
# processor and back is paid once for many reports.
VEHICLE_KEY = ("xway", "dir", "vid")
PACKED_REPORTS = (
    "xway int, dir int, vid int, time array<bigint>, speed array<int>, lane array<int>, "
    "segment array<int>, position array<int>, ingest_ms array<bigint>"
)
PACKED_STATE = ", ".join(
    f"{name} {kind}" if name in VEHICLE_KEY else f"{name} array<{kind}>"
    for name, kind in (field.split() for field in VEHICLE_STATE.split(", "))
)
STATE_COLUMNS = [field.split()[0] for field in VEHICLE_STATE.split(", ")]
PACKED_ROWS = 10_000  # reports in one row at most
BUFFERED_ROWS = 200_000  # reports sorted at once

Report = namedtuple("Report", "xway dir vid time speed lane segment position ingest_ms")

SEGMENT_ANSWER = (
    "vid int, time bigint, xway int, dir int, segment int, lav int, nov bigint, "
    "accident_segment int, ingest_ms bigint, report string"
)

ACCOUNT_ANSWER = (
    "typ int, vid int, time bigint, xway int, lav int, toll bigint, dir int, "
    "accident_segment int, qid string, balance bigint, ingest_ms bigint, report string"
)

# What waits in event time is kept by the hour of the recording, in seconds.
HOUR = 3600

# The type of a row that tells of a late report, beside those of the answers, 0 to 3.
LATE_REPORT = 9


class VehicleProcessor(StatefulProcessor):
    """Per (xway, dir, vid): the last report and how often its place was reported in a row.

    The seconds of the reports of the last `late_seconds` are kept too. A report overtaken by a
    later one is told as `late`: it starts and ends no stop and asks for no toll, but is `counted`
    in its minute, unless it is a copy or comes later than that.

    A report more than `leap_seconds` after the one before is taken for a bad clock's, and told as
    late, until another one within that time of it says that the vehicle was away so long.
    """

    def __init__(
        self,
        stop_reports: int,
        feet_per_segment: int,
        exit_lane: int,
        late_seconds: int = 300,
        leap_seconds: int = 86_400,
    ):
        self.stop_reports = stop_reports
        self.feet_per_segment = feet_per_segment
        self.exit_lane = exit_lane
        self.late_seconds = late_seconds
        self.leap_seconds = leap_seconds

    def init(self, handle) -> None:
        self.last = handle.getValueState(
            "last",
            "time bigint, position int, lane int, segment int, counter bigint, seen array<bigint>",
        )
        self.doubt = handle.getValueState("doubt", "time bigint")

    def handleInputRows(self, key, rows, timerValues):
        last, seen = self.last.get(), []
        if last is not None:
            last, seen = tuple(last)[:5], list(last[5])
        reports = {}  # one a second; of differing copies the smallest, whatever the order
        for r in rows:
            rank = (r.speed, r.lane, r.segment, r.position)
            if r.time not in reports or rank < reports[r.time][0]:
                reports[r.time] = (rank, r)
        for _, (_, r) in sorted(reports.items(), key=lambda item: item[0]):
            if last is not None and r.time <= last[0]:
                if r.time not in seen:
                    counted = r.time > last[0] - self.late_seconds
                    fresh = counted and all(t // 60 != r.time // 60 for t in seen)
                    yield self._late(r, counted, fresh)
                    if counted:
                        seen.append(r.time)
                continue
            if last is not None and r.time > last[0] + self.leap_seconds:
                doubted = self.doubt.get()
                if doubted is None or abs(r.time - doubted[0]) > self.leap_seconds:
                    self.doubt.update((r.time,))
                    yield self._late(r, False, False)
                    continue
                self.doubt.clear()
            last, row = self._next(last, r)
            yield row
            seen = [t for t in seen if t > r.time - self.late_seconds] + [r.time]
        if last is not None:
            self.last.update((*last, seen))

    def _next(self, last, r):
        """The vehicle's state after a report, and what the report comes to."""
        time, position, lane, segment, counter = last or (None, 0, 0, 0, 0)
        minute = r.time // 60 + 1
        first = time is None
        same = not first and (position, lane) == (r.position, r.lane)
        count = counter + 1 if same else 1
        row = Row(
            vid=r.vid,
            time=r.time,
            speed=r.speed,
            xway=r.xway,
            lane=r.lane,
            dir=r.dir,
            segment=r.segment,
            position=r.position,
            minute=minute,
            is_stopped=count >= self.stop_reports,
            is_crossing=first
            or r.segment != position // self.feet_per_segment
            or lane == self.exit_lane,
            new_minute=first or minute != time // 60 + 1,
            stop_began=count == self.stop_reports,
            stop_ended=not same and counter >= self.stop_reports,
            last_lane=lane,
            last_position=position,
            last_segment=segment,
            ingest_ms=r.ingest_ms,
            late=False,
            counted=True,
        )
        return (r.time, r.position, r.lane, r.segment, count), row

    @staticmethod
    def _late(r, counted, new_minute):
        return Row(
            vid=r.vid,
            time=r.time,
            speed=r.speed,
            xway=r.xway,
            lane=r.lane,
            dir=r.dir,
            segment=r.segment,
            position=r.position,
            minute=r.time // 60 + 1,
            is_stopped=False,
            is_crossing=False,
            new_minute=new_minute,
            stop_began=False,
            stop_ended=False,
            last_lane=r.lane,
            last_position=r.position,
            last_segment=r.segment,
            ingest_ms=r.ingest_ms,
            late=True,
            counted=counted,
        )

    def close(self) -> None:
        pass


def pack_reports(batches):
    """Rows of `PACKED_REPORTS` of a task's reports; a vehicle can have several."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= BUFFERED_ROWS:
            yield _packed(some)
            some, n = [], 0
    if n:
        yield _packed(some)


def _packed(batches):
    table = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in VEHICLE_KEY])
    columns = {c: table[c].combine_chunks() for c in Report._fields}
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in VEHICLE_KEY:
        key = columns[c].to_numpy(zero_copy_only=False)
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    at = np.arange(len(new))
    new |= (at - first[np.cumsum(new) - 1]) % PACKED_ROWS == 0
    first = np.flatnonzero(new)
    ends = pa.array(np.append(first, len(new)), pa.int32())
    arrays = [
        column.take(pa.array(first)) if c in VEHICLE_KEY else pa.ListArray.from_arrays(ends, column)
        for c, column in columns.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


class PackedVehicleProcessor(VehicleProcessor):
    """The same of rows of `PACKED_REPORTS`, as rows of `PACKED_STATE`."""

    def handleInputRows(self, key, rows, timerValues):
        states = super().handleInputRows(key, self._unpacked(rows), timerValues)
        while some := list(islice(states, PACKED_ROWS)):
            columns = zip(STATE_COLUMNS, zip(*some))
            yield Row(**{c: x[0] if c in VEHICLE_KEY else list(x) for c, x in columns})

    @staticmethod
    def _unpacked(rows):
        for r in rows:
            key = (r.xway, r.dir, r.vid)
            for values in zip(*(r[c] for c in Report._fields[3:])):
                yield Report(*key, *values)


class SegmentProcessor(StatefulProcessor):
    """Per (xway, dir, segment): sums of the last minutes, and accidents by distance ahead.

    Rows are reports of the segment, or stops that begin and end up to a few segments ahead
    (`delta` 1 and -1, with `distance`). An answer depends on the minute alone, so of the
    reports only those that ask are kept until the micro-batch's sums are complete.

    The sums kept are those of the `kept_minutes` that had a report last, whatever their numbers are:
    a report of a bad clock takes the place of one minute, and no other report is lost by it.
    """

    def __init__(self, lav_minutes: int, crash_vehicles: int, late_minutes: int = 5):
        self.lav_minutes = lav_minutes
        self.crash_vehicles = crash_vehicles
        self.kept_minutes = 4 * (lav_minutes + late_minutes)

    def init(self, handle) -> None:
        self.sums = handle.getMapState(
            "minutes", "minute bigint", "speed bigint, reports bigint, nov bigint, touched bigint"
        )
        # vehicles standing; minute the open accident began in; the last one to clear
        self.ahead = handle.getMapState(
            "ahead", "distance int", "standing int, since bigint, began bigint, cleared bigint"
        )

    def handleInputRows(self, key, rows, timerValues):
        xway, direction, segment = key
        blank = dict.fromkeys(("lav", "nov", "accident_segment", "report"))

        def answer(**fields):
            return Row(**{**blank, "xway": xway, "dir": direction, "segment": segment, **fields})

        sums, told = {}, {}  # when each minute was last touched, counted in touches
        for k, v in self.sums.iterator():
            sums[k[0]], told[k[0]] = tuple(v)[:3], v[3]
        kept, clock = set(sums), max(told.values(), default=0)
        asking, changes, touched = [], {}, set()
        for r in rows:
            if r.report is not None:
                yield answer(report=r.report, vid=r.vid, time=r.time, ingest_ms=r.ingest_ms)
                continue
            if r.delta:
                at = (r.distance, r.time)
                changes[at] = changes.get(at, 0) + r.delta
                continue
            minute = r.time // 60 + 1
            reports, novel = self._counted(r)
            if reports:
                speed, count, nov = sums.get(minute, (0, 0, 0))
                sums[minute] = (speed + r.speed, count + reports, nov + novel)
                touched.add(minute)
            if r.asks:
                asking.append((minute, r.vid, r.time, r.ingest_ms))

        in_force = self._accidents(changes)
        found = {}
        step = 1 if direction == 0 else -1
        for minute, vid, time, ingest_ms in asking:
            if minute not in found:
                ahead = [d for d, spans in in_force.items() if self._covers(spans, minute)]
                found[minute] = (
                    *self._traffic(sums, minute),
                    segment + step * min(ahead) if ahead else -1,
                )
            lav, nov, accident = found[minute]
            yield answer(
                vid=vid, time=time, lav=lav, nov=nov, accident_segment=accident, ingest_ms=ingest_ms
            )

        told |= {m: clock + 1 + i for i, m in enumerate(sorted(touched))}
        left = set(sorted(told, key=told.get)[-self.kept_minutes :])
        for m in kept - left:
            self.sums.removeKey((m,))
        for m in touched & left:
            self.sums.updateValue((m,), (*sums[m], told[m]))

    @staticmethod
    def _counted(r):
        """How many reports a row stands for, and how many of them are new in their minute."""
        return 1, int(r.new_minute)

    def _traffic(self, sums, minute):
        """Mean speed of the minutes before, rounded half up, and vehicles of the last one."""
        span = [sums[m] for m in range(minute - self.lav_minutes, minute) if m in sums]
        speed, count = sum(s[0] for s in span), sum(s[1] for s in span)
        lav = (2 * speed + count) // (2 * count) if count else 0
        return lav, sums.get(minute - 1, (0, 0, 0))[2]

    def _accidents(self, changes):
        """Bring the accidents ahead up to date; their (began, cleared) minutes by distance."""
        ahead = {k[0]: tuple(v) for k, v in self.ahead.iterator()}
        in_force = {d: [(began, cleared)] for d, (_, _, began, cleared) in ahead.items() if cleared}
        for (distance, time), delta in sorted(changes.items()):
            standing, since, began, cleared = ahead.get(distance, (0, None, None, None))
            standing, minute = standing + delta, time // 60 + 1
            if since is None and standing >= self.crash_vehicles:
                since = minute
            elif since is not None and standing < self.crash_vehicles:
                if since < minute:  # it was in force for at least this minute
                    began, cleared = since, minute
                    in_force.setdefault(distance, []).append((began, cleared))
                since = None
            ahead[distance] = (standing, since, began, cleared)
        for distance in {d for d, _ in changes}:
            self.ahead.updateValue((distance,), ahead[distance])
        for distance, (_, since, _, _) in ahead.items():
            if since is not None:
                in_force.setdefault(distance, []).append((since, None))
        return in_force

    @staticmethod
    def _covers(spans, minute):
        return any(
            minute > began and (cleared is None or minute <= cleared) for began, cleared in spans
        )

    def close(self) -> None:
        pass


SUMMED = (
    "vid int, time bigint, speed bigint, xway int, dir int, ingest_ms bigint, segment int, "
    "distance int, delta int, asks boolean, report string, reports bigint, novel bigint"
)
# Sums of a task that wait before they are put together, and go on if they stay about as many.
SUMS_KEPT = 50_000


def sum_reports(batches):
    """Arrow batches of rows for segments, with the reports of a segment and minute as one row.

    It counts them in `reports` and `novel` and has the sum of their `speed` and the first second of
    the minute. Rows that ask, and those of stops and late reports, go on and count no report.
    """
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SUMMED.split(",")])
    by, counts = ["xway", "dir", "segment", "time"], ["speed", "reports", "novel"]
    waiting, size = [], 0

    def put_together():
        sums = pa.concat_tables(waiting).group_by(by).aggregate([(c, "sum") for c in counts])
        return sums.select([*by, *(f"{c}_sum" for c in counts)]).rename_columns([*by, *counts])

    def rows(table, **fixed):
        columns = [
            table[f.name].cast(f.type)
            if f.name not in fixed
            else pa.chunked_array([pa.array([fixed[f.name]] * len(table), f.type)])
            for f in schema
        ]
        return pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()

    def sums(table):
        none = dict.fromkeys(("ingest_ms", "report"))
        return rows(table, vid=-1, distance=0, delta=0, asks=False, **none)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        own = pc.and_(pc.equal(table["delta"], 0), pc.is_null(table["report"]))
        yield from rows(table.filter(pc.or_kleene(table["asks"], pc.invert(own))), reports=0, novel=0)
        own = table.filter(own)
        ones = pa.array([1] * len(own), pa.int64())
        minute = pc.floor(pc.divide(pc.cast(own["time"], pa.float64()), 60.0))
        time = pc.multiply(pc.cast(minute, pa.int64()), 60)
        speed, novel = (pc.cast(own[c], pa.int64()) for c in ("speed", "new_minute"))
        columns = [*(own[c] for c in by[:3]), time, speed, ones, novel]
        waiting.append(pa.table(dict(zip([*by, *counts], columns))))
        size += len(own)
        if size > SUMS_KEPT:
            waiting = [put_together()]
            size = len(waiting[0])
            if size > SUMS_KEPT // 2:
                yield from sums(waiting[0])
                waiting, size = [], 0
    if size:
        yield from sums(put_together())


class SummedSegmentProcessor(SegmentProcessor):
    """`SegmentProcessor` for the rows of `sum_reports`: sums of reports, and rows that ask."""

    @staticmethod
    def _counted(r):
        return r.reports, r.novel


class AccountProcessor(StatefulProcessor):
    """Per (vid, xway): the sum of the tolls told and the last one, which is not yet due.

    Rows are tolls (`typ` 0), balance requests (2), and requests for a day's expenditure (3),
    which bring their answer with them in `toll`. Late reports pass through.
    """

    def init(self, handle) -> None:
        self.account = handle.getValueState("account", "told bigint, latest bigint")

    def handleInputRows(self, key, rows, timerValues):
        told, latest = self.account.get() or (0, 0)
        changed = False
        blank = dict.fromkeys(
            ("lav", "toll", "dir", "accident_segment", "qid", "balance", "report"), None
        )

        def answer(r, typ, **fields):
            row = {"typ": typ, "vid": r.vid, "time": r.time, "xway": r.xway, **blank, **fields}
            return Row(**row, ingest_ms=r.ingest_ms)

        # a toll told in the second of a request counts as told
        for r in sorted(rows, key=lambda r: (r.time, r.typ)):
            if r.report is not None:
                yield answer(r, LATE_REPORT, report=r.report)
            elif r.typ == 3:
                yield answer(r, 3, qid=r.qid, toll=r.toll)
            elif r.typ == 2:
                yield answer(r, 2, qid=r.qid, balance=told - latest)
            else:
                told, latest, changed = told + r.toll, r.toll, True
                yield answer(r, 0, lav=r.lav, toll=r.toll)
                if r.accident_segment != -1:
                    yield answer(r, 1, dir=r.dir, accident_segment=r.accident_segment)
        if changed:
            self.account.update((told, latest))

    def close(self) -> None:
        pass


ORDERED_STATE = VEHICLE_STATE + ", expired boolean"

EXPIRED = (
    "vid int, xway int, dir int, last_time bigint, expired_time bigint, was_stopped boolean"
)


class OrderedVehicleProcessor(VehicleProcessor):
    """`VehicleProcessor` in event time: reports wait until the watermark has passed them.

    So their order of arrival does not matter as long as no report comes after the watermark; those
    that do are told as late and take no part. Of copies, and of differing reports of one second,
    the smallest counts. A vehicle that sends nothing for `idle_seconds` leaves the state, which is
    told as a row that has `expired`; if it stood, its stop ends with it.
    """

    def __init__(self, *rules, clock_start: int, idle_seconds: int | None = None, **more):
        super().__init__(*rules, **more)
        self.clock_start = clock_start
        self.idle_seconds = idle_seconds

    def _ms(self, time):
        """A second of the recording on the clock that the watermark is told on."""
        return (self.clock_start + time) * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "time bigint, position int, lane int, segment int, counter bigint"
        )
        # the hours that have waiting reports, and the second of the first one, which has a timer
        self.hours = handle.getValueState("hours", "hours array<bigint>, first bigint")
        # of each hour its reports, one behind the other; an hour has no more than its seconds
        self.waiting = handle.getMapState("waiting", "hour bigint", "reports array<bigint>")

    def _waiting(self, hour):
        """Reports (speed, lane, segment, position, ingest_ms) of an hour by their second."""
        flat = list(self.waiting.getValue((hour,))[0])
        return {flat[i]: tuple(flat[i + 1 : i + 6]) for i in range(0, len(flat), 6)}

    def _keep(self, hour, reports) -> None:
        flat = [x for time, report in reports.items() for x in (time, *report)]
        self.waiting.updateValue((hour,), (flat,))

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        best = {}
        for r in rows:
            if self._ms(r.time) < watermark:
                yield Row(**self._late(r, False, False).asDict(), expired=False)
                continue
            report = (r.speed, r.lane, r.segment, r.position, r.ingest_ms)
            if r.time not in best or report[:4] < best[r.time][:4]:
                best[r.time] = report
        if not best:
            return
        known, first = self.hours.get() or ((), None)
        hours, arrived = set(known), {}
        for time, report in best.items():
            arrived.setdefault(time // HOUR, {})[time] = report
        for hour, reports in arrived.items():
            if hour in hours:
                for time, report in self._waiting(hour).items():
                    if time not in reports or report[:4] <= reports[time][:4]:
                        reports[time] = report
            self._keep(hour, reports)
        if first is None or min(best) < first:
            first = min(best)
            # a timer fires when the watermark has reached it
            self.handle.registerTimer(self._ms(first) + 1)
        self.hours.update((sorted(hours | arrived.keys()), first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        xway, direction, vid = key
        last = self.last.get()
        last = None if last is None else tuple(last)
        hours, first = self.hours.get() or ((), None)
        due = first is not None and self._ms(first) < watermark
        left = list(hours)
        while due and left and self._ms(left[0] * HOUR) < watermark:
            reports = self._waiting(left[0])
            for time in sorted(t for t in reports if self._ms(t) < watermark):
                speed, lane, segment, position, ingest_ms = reports.pop(time)
                if last is not None and self._idle(last, self._ms(time)):
                    yield self._expired(key, last)
                    last = None
                report = Row(
                    vid=vid, time=time, speed=speed, xway=xway, lane=lane, dir=direction,
                    segment=segment, position=position, ingest_ms=ingest_ms,
                )
                last, row = self._next(last, report)
                yield Row(**row.asDict(), expired=False)
            if reports:
                self._keep(left[0], reports)
                break
            self.waiting.removeKey((left.pop(0),))
        if due and left:
            first = min(self._waiting(left[0]))
            self.handle.registerTimer(self._ms(first) + 1)
            self.hours.update((left, first))
        elif due:
            self.hours.clear()
        if last is not None and self._idle(last, watermark):
            yield self._expired(key, last)
            self.last.clear()
        elif due:
            self.last.update(last)
            if self.idle_seconds is not None:
                self.handle.registerTimer(self._ms(last[0] + self.idle_seconds) + 1)

    def _idle(self, last, now_ms: int) -> bool:
        return self.idle_seconds is not None and self._ms(last[0] + self.idle_seconds) < now_ms

    def _expired(self, key, last):
        xway, direction, vid = key
        time, position, lane, segment, counter = last
        stood = counter >= self.stop_reports
        report = Row(
            vid=vid, time=time + self.idle_seconds, speed=0, xway=xway, lane=lane, dir=direction,
            segment=segment, position=position, ingest_ms=None,
        )
        row = self._late(report, False, False).asDict()
        return Row(**{**row, "late": False, "stop_ended": stood, "expired": True})


class WaitingRequestProcessor(StatefulProcessor):
    """Per (vid, xway): requests wait until the watermark has passed them, like the reports.

    A request that comes after the watermark is answered at once. Copies of a request that waits,
    and of one answered within the last `kept_seconds`, are dropped.
    """

    def __init__(self, clock_start: int, kept_seconds: int):
        self.clock_start = clock_start
        self.kept_seconds = kept_seconds

    def _ms(self, time):
        return (self.clock_start + time) * 1000

    def init(self, handle) -> None:
        self.handle = handle
        # the hours that have requests, and when the next of them is due, in ms, which has a timer
        self.hours = handle.getValueState("hours", "hours array<bigint>, due bigint")
        self.seen = handle.getMapState(
            "seen",
            "hour bigint",
            "typ array<int>, time array<bigint>, qid array<string>, toll array<bigint>, "
            "ingest_ms array<bigint>, told array<boolean>",
        )

    def _row(self, key, typ, time, qid, toll, ingest_ms):
        vid, xway = key
        return Row(typ=typ, vid=vid, time=time, xway=xway, qid=qid, toll=toll, ingest_ms=ingest_ms)

    def _known(self, hour):
        """(toll, ingest_ms, told) of an hour's requests by (typ, time, qid)."""
        columns = zip(*(list(c) for c in self.seen.getValue((hour,))))
        return {tuple(x[:3]): tuple(x[3:]) for x in columns}

    def _keep(self, hour, requests) -> None:
        columns = zip(*((*asked, *known) for asked, known in requests.items()))
        self.seen.updateValue((hour,), tuple(list(c) for c in columns))

    def _due(self, asked, told) -> int:
        """When a request is to be told or, a second after it need not be known, forgotten."""
        return self._ms(asked[1] + self.kept_seconds) + 2 if told else self._ms(asked[1]) + 1

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        known, due = self.hours.get() or ((), None)
        hours, requests, changed, next_due = set(known), {}, set(), due
        for r in rows:
            asked, hour = (r.typ, r.time, r.qid), r.time // HOUR
            if hour not in requests:
                requests[hour] = self._known(hour) if hour in hours else {}
            if asked in requests[hour]:
                continue
            late = self._ms(r.time) < watermark
            if late:
                yield self._row(key, *asked, r.toll, r.ingest_ms)
            if late and self._ms(r.time + self.kept_seconds) < watermark:
                continue
            requests[hour][asked] = (r.toll, r.ingest_ms, late)
            changed.add(hour)
            at = self._due(asked, late)
            next_due = at if next_due is None else min(next_due, at)
        for hour in changed:
            self._keep(hour, requests[hour])
        if next_due != due:
            self.handle.registerTimer(next_due)
        if changed:
            self.hours.update((sorted(hours | changed), next_due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        hours, due = self.hours.get() or ((), None)
        if due is None or due > watermark:
            return  # a request that came later was due earlier
        left, next_due = [], None
        for hour in hours:
            if next_due is not None and self._ms(hour * HOUR) >= watermark:
                left.append(hour)
                continue
            requests = self._known(hour)
            before = dict(requests)
            for asked in sorted(before, key=lambda x: (x[1], x[0])):
                toll, ingest_ms, told = before[asked]
                if self._due(asked, told) > watermark:
                    continue
                if told:
                    del requests[asked]
                else:
                    yield self._row(key, *asked, toll, ingest_ms)
                    requests[asked] = (toll, ingest_ms, True)
            if not requests:
                self.seen.removeKey((hour,))
                continue
            if requests != before:
                self._keep(hour, requests)
            left.append(hour)
            first = min(self._due(asked, known[2]) for asked, known in requests.items())
            next_due = first if next_due is None else min(next_due, first)
        if left:
            self.handle.registerTimer(next_due)
            self.hours.update((left, next_due))
        else:
            self.hours.clear()

    def close(self) -> None:
        pass


ANSWERED = (
    "typ int, vid int, xway int, day int, time bigint, qid string, toll bigint, ingest_ms bigint"
)


class ExpenditureProcessor(StatefulProcessor):
    """Per (vid, xway): the tolls of past days, from the initial state, which answer requests.

    A row of the initial state is a block of `block` days: its days and their tolls. Only requests
    of type `asks` look a day up; the others pass through.
    """

    def __init__(self, asks: int, block: int):
        self.asks = asks
        self.block = block

    def init(self, handle) -> None:
        self.days = handle.getMapState(
            "days", "block bigint", "days array<int>, tolls array<bigint>"
        )

    def handleInitialState(self, key, initialState, timerValues) -> None:
        days, tolls = list(initialState.days), list(initialState.tolls)
        self.days.updateValue((initialState.block,), (days, tolls))

    def handleInputRows(self, key, rows, timerValues):
        vid, xway = key
        blocks = {}
        for r in rows:
            toll = None
            if r.typ == self.asks:
                block = None if r.day is None else r.day // self.block
                if block not in blocks:
                    blocks.clear()  # one at a time
                    known = self.days.getValue((block,))
                    blocks[block] = {} if known is None else dict(zip(*map(list, known)))
                toll = blocks[block].get(r.day)
            yield Row(
                typ=r.typ, vid=vid, xway=xway, day=r.day, time=r.time, qid=r.qid,
                toll=toll, ingest_ms=r.ingest_ms,
            )

    def close(self) -> None:
        pass
