"""The tolling rules as a walk over events in time order, for small recordings."""

from __future__ import annotations

from collections import defaultdict


def walk(events: list[dict], free_vehicles: int = 50) -> dict[str, list[tuple]]:
    """Answers to `events` (dicts with the fields of EVENT_SCHEMA), as sorted tuples.

    tolls: (vid, time, xway, dir, segment, lav, nov, accident_segment, toll)
    balances: (vid, time, xway, qid, balance)
    """
    events = sorted(events, key=lambda e: (e["time"], e["typ"], e["vid"]))
    places = defaultdict(list)  # (xway, dir, vid) -> places reported, oldest first
    minutes_of = {}
    stood = {}  # (xway, dir, vid) -> segment it stands in
    changes = []  # (time, xway, dir, segment, +-1)
    seen = []  # (report, crossing, new_minute)
    for e in (e for e in events if e["typ"] == 0):
        key, minute = (e["xway"], e["dir"], e["vid"]), e["time"] // 60 + 1
        past = places[key]
        spot = (e["position"], e["lane"])
        crossing = not past or past[-1][0] // 5280 != e["segment"] or past[-1][1] == 4
        seen.append((e, crossing, minutes_of.get(key) != minute))
        minutes_of[key] = minute
        if past and past[-1] != spot and key in stood:
            changes.append((e["time"], *key[:2], stood.pop(key), -1))
        past.append(spot)
        if key not in stood and len(past) >= 4 and len(set(past[-4:])) == 1:
            stood[key] = e["segment"]
            changes.append((e["time"], *key[:2], e["segment"], 1))

    # accidents: seconds at which the number standing reaches or leaves two
    accidents = []
    for place in {c[1:4] for c in changes}:
        level, since = 0, None
        for t in sorted({c[0] for c in changes if c[1:4] == place}):
            level += sum(c[4] for c in changes if c[1:4] == place and c[0] == t)
            if since is None and level >= 2:
                since = t // 60 + 1
            elif since is not None and level < 2:
                accidents.append((*place, since, t // 60 + 1))
                since = None
        if since is not None:
            accidents.append((*place, since, None))

    stats = defaultdict(lambda: [0, 0, 0])
    for e, _, new in seen:
        s = stats[e["xway"], e["dir"], e["segment"], e["time"] // 60 + 1]
        s[0] += e["speed"]
        s[1] += 1
        s[2] += new

    tolls = []
    for e, crossing, _ in seen:
        if not crossing or e["lane"] == 4:
            continue
        at, minute = (e["xway"], e["dir"], e["segment"]), e["time"] // 60 + 1
        span = [stats[(*at, m)] for m in range(minute - 5, minute) if (*at, m) in stats]
        count = sum(s[1] for s in span)
        lav = int(sum(s[0] for s in span) / count + 0.5) if count else 0
        nov = stats[(*at, minute - 1)][2] if (*at, minute - 1) in stats else 0
        step = 1 if e["dir"] == 0 else -1
        ahead = -1
        for d in range(5):
            if any(
                a[:3] == (at[0], at[1], at[2] + step * d)
                and minute > a[3]
                and (a[4] is None or minute <= a[4])
                for a in accidents
            ):
                ahead = at[2] + step * d
                break
        free = lav >= 40 or nov <= free_vehicles or ahead != -1
        toll = 0 if free else 2 * (nov - free_vehicles) ** 2
        tolls.append((e["vid"], e["time"], *at, lav, nov, ahead, toll))

    balances = []
    for e in (e for e in events if e["typ"] == 2):
        told = [
            t[8]
            for t in sorted(tolls, key=lambda t: t[1])
            if t[0] == e["vid"] and t[2] == e["xway"] and t[1] <= e["time"]
        ]
        balances.append((e["vid"], e["time"], e["xway"], e["qid"], sum(told[:-1])))
    return {"tolls": sorted(tolls), "balances": sorted(balances)}
