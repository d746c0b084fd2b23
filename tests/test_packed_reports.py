"""Reports go to the vehicles' state, and their states come back, many in a row."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Row
from test_state_calls import _handle

from tollway.streaming import state

_INTS = {"xway", "dir", "vid", "speed", "lane", "segment", "position"}
_TYPES = pa.schema([(c, pa.int32() if c in _INTS else pa.int64()) for c in state.Report._fields])


def _reports(n: int, vehicles: int) -> list[state.Report]:
    rng = random.Random(n)
    return [
        state.Report(
            rng.randrange(2), 0, rng.choice([*range(vehicles), None]), rng.randrange(2000), rng.randrange(90),
            rng.randrange(5), 3, 3 * 5280 + rng.randrange(3), rng.choice([None, 5]),
        )
        for _ in range(n)
    ]


def _batches(reports, size):
    for i in range(0, len(reports), size):
        yield pa.RecordBatch.from_pylist([r._asdict() for r in reports[i : i + size]], _TYPES)


def _unpacked(packed):
    rows = [Row(**r) for batch in packed for r in batch.to_pylist()]
    return rows, [r for row in rows for r in state.PackedVehicleProcessor._unpacked([row])]


def test_reports_are_packed_whole(monkeypatch):
    reports = _reports(500, 6)
    rows, again = _unpacked(state.pack_reports(_batches(reports, 70)))
    assert sorted(again, key=repr) == sorted(reports, key=repr)
    assert sum(r.vid is not None for r in rows) == 12  # of two roads
    monkeypatch.setattr(state, "PACKED_ROWS", 4)
    monkeypatch.setattr(state, "BUFFERED_ROWS", 100)
    rows, again = _unpacked(state.pack_reports(_batches(reports, 70)))
    assert sorted(again, key=repr) == sorted(reports, key=repr)
    assert max(len(r.time) for r in rows) == 4
    assert list(state.pack_reports(iter([]))) == []


def test_a_vehicle_has_few_rows_in_its_state_step(monkeypatch):
    reports = [r._replace(xway=0, vid=1) for r in _reports(300, 1)]

    def states(processor, rows):
        processor.init(_handle([])[1])
        return list(processor.handleInputRows((0, 0, 1), iter(rows), None))

    want = [r.asDict() for r in states(state.VehicleProcessor(4, 5280, 4), reports)]
    rows, _ = _unpacked(state.pack_reports(_batches(reports, 50)))
    for size, n in ((10_000, 1), (100, -(-len(want) // 100))):
        monkeypatch.setattr(state, "PACKED_ROWS", size)
        told = states(state.PackedVehicleProcessor(4, 5280, 4), rows)
        assert len(told) == n
        got = []
        for row in told:
            fields = row.asDict()
            key = {c: fields.pop(c) for c in state.VEHICLE_KEY}
            got += [{**key, **dict(zip(fields, values))} for values in zip(*fields.values())]
        assert got == want
