"""How often the keyed processors call their state."""

from __future__ import annotations

from types import SimpleNamespace

from tollway.streaming import live, state


class _Counted:
    """A state variable, value or map, that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def getValue(self, key):
        self.calls.append("get")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("update")
        self.held[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        self.held.pop(key, None)

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.held

    def keys(self):
        self.calls.append("keys")
        return iter(list(self.held))

    def iterator(self):
        self.calls.append("iterator")
        return iter(list(self.held.items()))

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.removeKey(())


def _handle(calls):
    timers = set()

    def register(at):
        calls.append("timer")
        timers.add(at)

    return timers, SimpleNamespace(
        getValueState=lambda *_: _Counted(calls),
        getMapState=lambda *_: _Counted(calls),
        registerTimer=register,
    )


def _fire(processor, timers, key, watermark):
    """Rows told by the timers that the watermark has passed, in their order."""
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    told = []
    while due := [t for t in timers if t < watermark]:
        at = min(due)
        told += processor.handleExpiredTimer(key, times, None)
        timers.discard(at)
    return told


def _at(watermark):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)


def _report(time, **fields):
    base = {"vid": 1, "time": time, "speed": 30, "xway": 0, "lane": 1, "dir": 0, "segment": 3}
    return SimpleNamespace(**{**base, "position": 3 * 5280 + time % 5000, "ingest_ms": None, **fields})


def test_waiting_reports_take_few_calls():
    """120 reports, in two micro-batches and any order, wait and are told in order."""
    calls, key = [], (0, 0, 1)
    timers, handle = _handle(calls)
    vehicle = state.OrderedVehicleProcessor(4, 5280, 4, clock_start=0, idle_seconds=120)
    vehicle.init(handle)
    times = [30 * (i * 7 % 120) for i in range(120)]
    assert not list(vehicle.handleInputRows(key, [_report(t) for t in times[:60]], _at(0)))
    again = [_report(t) for t in times[60:]] + [_report(90, speed=10), _report(120, speed=99)]
    assert not list(vehicle.handleInputRows(key, again, _at(0)))
    first = _fire(vehicle, timers, key, 1_800_500)
    assert [r.time for r in first] == [30 * i for i in range(61)]
    assert [r.speed for r in first][3:5] == [10, 30]  # of copies the smallest
    rest = _fire(vehicle, timers, key, 10_000_000)
    assert [(r.time, r.expired) for r in rest][:-1] == [(30 * i, False) for i in range(61, 120)]
    assert rest[-1].expired and rest[-1].time == 30 * 119 + 120
    assert len(calls) < 60
    assert not vehicle.waiting.held and not vehicle.hours.held and not vehicle.last.held


def _ask(time, qid, typ=2, toll=None):
    return SimpleNamespace(typ=typ, time=time, qid=qid, toll=toll, ingest_ms=None)


def test_waiting_requests_take_few_calls():
    """100 requests and copies of them wait and are told once, in order."""
    calls, key = [], (1, 0)
    timers, handle = _handle(calls)
    waiting = state.WaitingRequestProcessor(0, 60)
    waiting.init(handle)
    rows = [_ask(30 * (i * 7 % 100), f"q{i * 7 % 100}") for i in range(100)]
    assert not list(waiting.handleInputRows(key, rows + rows[:20], _at(0)))
    assert not list(waiting.handleInputRows(key, rows[30:50], _at(0)))
    told = _fire(waiting, timers, key, 1_500_500)
    assert [(r.time, r.qid) for r in told] == [(30 * i, f"q{i}") for i in range(51)]
    # a copy of one told within the last minute, then of one that is forgotten: late, told at once
    assert not list(waiting.handleInputRows(key, [_ask(1470, "q49")], _at(1_500_500)))
    assert [r.qid for r in waiting.handleInputRows(key, [_ask(0, "q0")], _at(1_500_500))] == ["q0"]
    told = _fire(waiting, timers, key, 10_000_000)
    assert [r.time for r in told] == [30 * i for i in range(51, 100)]
    assert len(calls) < 60
    assert not waiting.seen.held and not waiting.hours.held


def test_history_is_loaded_in_blocks(spark):
    """Many days a row of the initial state; each day is found, the largest toll of it counts."""
    days = [(7, d, 0, d % 90) for d in range(-3, 300)] + [(7, 5, 0, 99), (7, 5, 0, 1)]
    history = spark.createDataFrame(days, "vid int, day int, xway int, toll int")
    packed = live.packed_history(history, 128).collect()
    assert sorted((r.block, len(r.days)) for r in packed) == [(-1, 3), (0, 130), (1, 128), (2, 44)]
    calls = []
    known = state.ExpenditureProcessor(3, 128)
    known.init(_handle(calls)[1])
    for row in packed:
        known.handleInitialState((7, 0), row, None)
    assert len(calls) == 4
    asked = [SimpleNamespace(**vars(_ask(1, "q", 3)), day=d) for d in (-3, 0, 5, 127, 128, 299, 300, None)]
    tolls = [r.toll for r in known.handleInputRows((7, 0), asked, None)]
    assert tolls == [87, 0, 99, 37, 38, 29, None, None]


def test_reports_of_a_minute_are_one_row():
    """All reports count once, and only rows that ask or tell of stops go on by themselves."""
    import pyarrow as pa

    rows = [
        {
            "vid": i, "time": i % 240, "speed": i % 50, "xway": 0, "dir": 1, "new_minute": i % 3 == 0,
            "ingest_ms": None, "segment": i % 2, "distance": 0, "delta": 1 if i % 500 == 9 else 0,
            "asks": i % 100 == 0, "report": "late" if i % 500 == 8 else None,
        }
        for i in range(5000)
    ]
    small = pa.int32()
    schema = pa.schema({
        "vid": small, "time": pa.int64(), "speed": small, "xway": small, "dir": small,
        "new_minute": pa.bool_(), "ingest_ms": pa.int64(), "segment": small, "distance": small,
        "delta": small, "asks": pa.bool_(), "report": pa.string(),
    })
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=700)
    got = [r for b in state.sum_reports(iter(batches)) for r in b.to_pylist()]
    own = [r for r in rows if not r["delta"] and r["report"] is None]
    assert sum(r["reports"] for r in got) == len(own)
    assert len(got) == 8 + 50 + 10 + 10
    for minute in range(4):
        for segment in range(2):
            here = [r for r in own if (r["time"] // 60, r["segment"]) == (minute, segment)]
            (told,) = (r for r in got if r["reports"] and (r["time"], r["segment"]) == (60 * minute, segment))
            assert (told["reports"], told["speed"], told["novel"]) == (
                len(here), sum(r["speed"] for r in here), sum(r["new_minute"] for r in here),
            )
