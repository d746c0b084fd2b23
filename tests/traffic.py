"""Small random traffic: crowds, stops, accidents, changes of road, silences, requests."""

from __future__ import annotations

import random

COLUMNS = (
    "typ", "time", "vid", "speed", "xway", "lane", "dir", "segment", "position", "qid", "day",
)


def report(time, vid, speed, xway, lane, dir_, segment, position) -> dict:
    values = (0, time, vid, speed, xway, lane, dir_, segment, position, "-1", -1)
    return dict(zip(COLUMNS, values))


def request(typ, time, vid, xway, qid, day=-1) -> dict:
    return dict(zip(COLUMNS, (typ, time, vid, -1, xway, -1, -1, -1, -1, qid, day)))


def random_traffic(seed: int, vehicles: int = 140, steps: int = 24) -> list[dict]:
    rnd = random.Random(seed)
    events = []
    for vid in range(vehicles):
        xway, dir_, lane = rnd.randrange(2), 0, rnd.randint(1, 3)
        if vid % 3:
            xway = 0  # a crowd on one road, so that tolls arise
        position = rnd.randrange(10 * 5280, 13 * 5280)
        time = rnd.randrange(30)
        stop_at = rnd.choice([None, None, 11 * 5280 + 100, 12 * 5280 + 200])
        stop_left = rnd.randint(3, 10)
        for _ in range(steps):
            speed = rnd.randint(5, 45)
            if stop_at is not None and position >= stop_at and stop_left:
                position, speed, stop_left = stop_at, 0, stop_left - 1
            lane_now = 4 if rnd.random() < 0.03 else lane
            events.append(
                report(time, vid, speed, xway, lane_now, dir_, position // 5280, position)
            )
            if rnd.random() < 0.1:
                events.append(request(2, time, vid, xway, f"q{len(events)}"))
            position = min(position + speed * 44, 527_999)
            time += 30 if rnd.random() < 0.95 else 30 * rnd.randint(2, 9)
            if rnd.random() < 0.02:
                xway = 1 - xway
            if rnd.random() < 0.02:
                dir_ = 1 - dir_
    return events


def as_frame(spark, events: list[dict]):
    from tollway.schema import EVENT_SCHEMA

    rows = [tuple(e[c] for c in COLUMNS) for e in events]
    return spark.createDataFrame(rows, EVENT_SCHEMA)
