"""The same questions as SQL over the given tables, written independently of the operators.

Each query is a chain of named steps; a query gets the steps it needs.
"""

from __future__ import annotations

import re

_steps: dict[str, str] = {}
_final: dict[str, str] = {}

_steps["numbered"] = """
  SELECT event_id, user_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
         count(*) OVER (PARTITION BY user_id) AS cnt
  FROM events"""

_steps["driven"] = """
  SELECT *, (user_id // 2) % 7 = 3 AS early,
         (user_id // 2) % 7 <> 3 AND (user_id // 2) % 11 = 5 AS late,
         20 + ((user_id // 2) * 7) % 30 AS cruise,
         CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS xway,
         CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS dir,
         30 * n + user_id % 30 AS time
  FROM numbered"""

_steps["placed"] = """
  SELECT *,
         CASE WHEN early THEN CASE WHEN n < 20 THEN n WHEN n <= 26 THEN 20 ELSE n - 6 END
              WHEN late THEN CASE WHEN n < 41 THEN n WHEN n <= 50 THEN 41 ELSE n - 9 END
              ELSE n END AS k,
         (early AND n BETWEEN 20 AND 26) OR (late AND n BETWEEN 41 AND 50) AS halted
  FROM driven"""

_steps["located"] = """
  SELECT *, CASE WHEN dir = 0 THEN least(k * cruise * 44, 527999)
                 ELSE greatest(527999 - k * cruise * 44, 0) END AS position
  FROM placed"""

_steps["reports"] = """
  SELECT CAST(user_id AS INTEGER) AS vid, CAST(time AS BIGINT) AS time,
         CAST(CASE WHEN halted THEN 0 ELSE cruise END AS INTEGER) AS speed,
         CAST(xway AS INTEGER) AS xway,
         CAST(CASE WHEN n = cnt - 1 OR n % 40 = 39 THEN 4 WHEN n % 40 = 0 THEN 0
                   ELSE 1 + (user_id // 2 + n // 20) % 3 END AS INTEGER) AS lane,
         CAST(dir AS INTEGER) AS dir, CAST(position // 5280 AS INTEGER) AS segment,
         CAST(position AS INTEGER) AS position, CAST(time // 60 + 1 AS BIGINT) AS minute
  FROM located"""

_steps["requests"] = """
  SELECT CASE WHEN event_type = 'purchase' THEN 2 ELSE 3 END AS typ,
         CAST(user_id AS INTEGER) AS vid, CAST(time AS BIGINT) AS time,
         CAST(xway AS INTEGER) AS xway, CAST(event_id AS VARCHAR) AS qid,
         CAST(CASE WHEN event_type = 'signup' THEN 1 + event_id % 69 ELSE -1 END AS INTEGER) AS day
  FROM located WHERE event_type IN ('purchase', 'signup')"""

_steps["road"] = """
  SELECT 0 AS typ, time, vid, speed, xway, lane, dir, segment, position, '-1' AS qid, -1 AS day
  FROM reports
  UNION ALL
  SELECT typ, time, vid, -1, xway, -1, -1, -1, -1, qid, day FROM requests"""

_steps["history"] = """
  SELECT vid, CAST(d AS INTEGER) AS day, CAST(x AS INTEGER) AS xway,
         CAST((vid * 31 + d * 17 + x * 7) % 100 AS INTEGER) AS toll
  FROM (SELECT DISTINCT CAST(user_id AS INTEGER) AS vid FROM events),
       range(1, 70) AS days(d), range(0, 2) AS xways(x)
  WHERE (vid + d) % 23 <> 0"""

# Run lengths by gaps and islands
_steps["lagged"] = """
  SELECT *, lag(position) OVER v AS p1, lag(lane) OVER v AS l1, lag(segment) OVER v AS s1,
         lag(minute) OVER v AS m1
  FROM reports WINDOW v AS (PARTITION BY xway, dir, vid ORDER BY time)"""

_steps["islands"] = """
  SELECT *, sum(CASE WHEN p1 = position AND l1 = lane THEN 0 ELSE 1 END)
            OVER (PARTITION BY xway, dir, vid ORDER BY time) AS island
  FROM lagged"""

_steps["counted"] = """
  SELECT *, row_number() OVER (PARTITION BY xway, dir, vid, island ORDER BY time) AS counter
  FROM islands"""

_steps["state"] = """
  SELECT vid, time, speed, xway, lane, dir, segment, position, minute,
         counter >= 4 AS is_stopped,
         p1 IS NULL OR segment <> p1 // 5280 OR l1 = 4 AS is_crossing,
         m1 IS NULL OR m1 <> minute AS new_minute,
         counter = 4 AS stop_began,
         counter = 1 AND coalesce(lag(counter) OVER v, 0) >= 4 AS stop_ended,
         coalesce(l1, 0) AS last_lane, coalesce(p1, 0) AS last_position,
         coalesce(s1, 0) AS last_segment
  FROM counted WINDOW v AS (PARTITION BY xway, dir, vid ORDER BY time)"""

_steps["crossings"] = "SELECT * FROM state WHERE is_crossing AND lane <> 4"

# A stop lasts from the fourth report of an island to the first report after the island
_steps["stops"] = """
  SELECT c.xway, c.dir, c.vid, c.segment, c.lane, c.position, c.time AS begin_time,
         (SELECT min(r.time) FROM counted r
          WHERE r.xway = c.xway AND r.dir = c.dir AND r.vid = c.vid AND r.island = c.island + 1
         ) AS end_time
  FROM counted c WHERE c.counter = 4"""


def _sweep(name: str, place: str) -> None:
    _steps[f"{name}_deltas"] = f"""
  SELECT {place}, time, sum(delta) AS delta FROM (
    SELECT {place}, begin_time AS time, 1 AS delta FROM stops
    UNION ALL SELECT {place}, end_time, -1 FROM stops WHERE end_time IS NOT NULL)
  GROUP BY {place}, time"""
    _steps[f"{name}_levels"] = f"""
  SELECT {place}, time, sum(delta) OVER (PARTITION BY {place} ORDER BY time) AS level, delta
  FROM {name}_deltas"""
    _steps[f"{name}_edges"] = f"""
  SELECT {place}, time, level >= 2 AS opens,
         lead(time) OVER (PARTITION BY {place} ORDER BY time) AS next_time
  FROM {name}_levels WHERE (level >= 2) <> (level - delta >= 2)"""
    _steps[name] = f"""
  SELECT {place}, time AS begin_time, next_time AS end_time,
         CAST(time // 60 + 1 AS BIGINT) AS created_minute,
         CAST(next_time // 60 + 1 AS BIGINT) AS cleared_minute
  FROM {name}_edges WHERE opens"""


_sweep("crashes", "xway, dir, segment")
_sweep("spot_crashes", "xway, dir, segment, position")

# Interval and range join, the direct way
_steps["looked"] = """
  SELECT s.xway, s.dir, s.segment, s.minute, s.vid, s.time, s.lane, s.is_crossing,
         coalesce(arg_min(c.segment, abs(c.segment - s.segment)), -1) AS accident_segment,
         coalesce(min(c.segment), -1) AS lowest_segment
  FROM state s LEFT JOIN crashes c
    ON c.xway = s.xway AND c.dir = s.dir
   AND c.segment BETWEEN CASE WHEN s.dir = 0 THEN s.segment ELSE s.segment - 4 END
                     AND CASE WHEN s.dir = 0 THEN s.segment + 4 ELSE s.segment END
   AND s.minute >= c.created_minute + 1
   AND (c.cleared_minute IS NULL OR s.minute <= c.cleared_minute)
  GROUP BY ALL"""

_steps["stats"] = """
  SELECT xway, dir, segment, minute, CAST(sum(speed) AS BIGINT) AS speed_sum,
         count(*) AS reports, count(*) FILTER (WHERE new_minute) AS nov
  FROM state GROUP BY xway, dir, segment, minute"""

_steps["conditions"] = """
  SELECT s.xway, s.dir, s.segment, s.minute,
         coalesce(max(b.nov) FILTER (WHERE b.minute = s.minute - 1), 0) AS nov,
         CAST(coalesce(floor(CAST(sum(b.speed_sum) AS DOUBLE) / sum(b.reports) + 0.5), 0)
              AS INTEGER) AS lav
  FROM stats s LEFT JOIN stats b
    ON b.xway = s.xway AND b.dir = s.dir AND b.segment = s.segment
   AND b.minute BETWEEN s.minute - 5 AND s.minute - 1
  GROUP BY s.xway, s.dir, s.segment, s.minute"""

_steps["in_context"] = """
  SELECT l.vid, l.time, l.xway, l.dir, l.segment, c.lav, c.nov, l.accident_segment,
         l.is_crossing, l.lane
  FROM looked l JOIN conditions c USING (xway, dir, segment, minute)"""

_steps["tolls"] = """
  SELECT vid, time, xway, dir, segment, lav, nov, accident_segment,
         CAST(CASE WHEN lav >= 40 OR nov <= 50 OR accident_segment <> -1 THEN 0
                   ELSE 2 * (nov - 50) * (nov - 50) END AS BIGINT) AS toll
  FROM in_context WHERE is_crossing AND lane <> 4"""

_steps["balances"] = """
  SELECT r.vid, r.time, r.xway, r.qid,
         CAST(coalesce(sum(t.toll), 0) - coalesce(arg_max(t.toll, t.time), 0) AS BIGINT) AS balance
  FROM (SELECT * FROM requests WHERE typ = 2) r LEFT JOIN tolls t
    ON t.vid = r.vid AND t.xway = r.xway AND t.time <= r.time
  GROUP BY r.vid, r.time, r.xway, r.qid"""

_steps["spent"] = """
  SELECT r.vid, r.time, r.xway, r.qid, r.day, h.toll
  FROM (SELECT * FROM requests WHERE typ = 3) r LEFT JOIN history h USING (vid, xway, day)"""

_steps["answers"] = """
  SELECT 0 AS typ, vid, time, xway, lav, toll, CAST(NULL AS INTEGER) AS dir,
         CAST(NULL AS INTEGER) AS accident_segment, CAST(NULL AS VARCHAR) AS qid,
         CAST(NULL AS BIGINT) AS balance
  FROM tolls
  UNION ALL SELECT 1, vid, time, xway, NULL, NULL, dir, accident_segment, NULL, NULL
  FROM tolls WHERE accident_segment <> -1
  UNION ALL SELECT 2, vid, time, xway, NULL, NULL, NULL, NULL, qid, balance FROM balances
  UNION ALL SELECT 3, vid, time, xway, NULL, CAST(toll AS BIGINT), NULL, NULL, qid, NULL
  FROM spent"""

_steps["answer_lines"] = """
  SELECT CASE typ
    WHEN 0 THEN concat('0,', vid, ',', time, ',', lav, ',', toll)
    WHEN 1 THEN concat('1,', time, ',', xway, ',', accident_segment, ',', dir, ',', vid)
    WHEN 2 THEN concat('2,', time, ',', time, ',', qid, ',', balance)
    ELSE concat('3,', time, ',', qid, ',', toll) END AS value
  FROM answers"""

_steps["road_lines"] = """
  SELECT concat_ws(',', typ, time, vid, speed, xway, lane, dir, segment, position, qid,
                   -1, -1, -1, -1, day) AS value,
         concat_ws(',', typ, time, vid, speed, xway, lane) AS cut,
         concat_ws(',', typ, time, vid, 'fast', xway, lane, dir, segment, position, qid,
                   -1, -1, -1, -1, day) AS wordy,
         (vid + time) % 200 AS kind, *
  FROM road"""

_steps["trips_marked"] = """
  SELECT *, CASE WHEN time - lag(time) OVER v < 60 THEN 0 ELSE 1 END AS starts
  FROM reports WINDOW v AS (PARTITION BY vid ORDER BY time)"""

_steps["trips"] = """
  SELECT vid, time, speed, xway, lane, dir, segment, position,
         CAST(sum(starts) OVER (PARTITION BY vid ORDER BY time) AS BIGINT) AS trip
  FROM trips_marked"""

_EVENT = "typ, time, vid, speed, xway, lane, dir, segment, position, qid, day"
_KEY = "xway, dir, segment, minute"
_REPORT = "vid, time, speed, xway, lane, dir, segment, position"

_final["parse_events"] = f"""
  SELECT {_EVENT} FROM road_lines UNION ALL SELECT {_EVENT} FROM road_lines WHERE kind = 0"""
_final["parse_rejects"] = """
  SELECT cut AS value, 'dir' AS bad_field FROM road_lines WHERE kind = 50
  UNION ALL SELECT wordy, 'speed' FROM road_lines WHERE kind = 100"""
_final["distinct_events"] = f"SELECT {_EVENT} FROM road"
_final["toll_history_scan"] = "SELECT vid, day, xway, toll FROM history"
_final["toll_history_by_vehicle"] = """
  SELECT vid, xway, CAST(count(*) AS INTEGER) AS days,
         string_agg(concat(day, ':', toll), ',' ORDER BY day) AS tolls
  FROM history GROUP BY vid, xway"""

_final["position_reports"] = f"SELECT {_REPORT}, minute FROM reports"
_final["toll_path_events"] = f"SELECT {_EVENT} FROM road WHERE typ IN (0, 2)"
_final["travel_lane_reports"] = f"SELECT {_REPORT}, minute FROM reports WHERE lane IN (1, 2, 3)"
_final["event_time"] = """
  SELECT typ, vid, time, xway, CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) + time AS event_second
  FROM road"""

_final["vehicle_state"] = "SELECT * FROM state"
_final["segment_crossings"] = "SELECT * FROM crossings"
_final["stopped_vehicles"] = "SELECT * FROM state WHERE is_stopped"
_final["stop_intervals"] = "SELECT * FROM stops"
_final["stop_detection"] = f"""
  SELECT {_REPORT}, row_number() OVER (PARTITION BY vid, island ORDER BY time) >= 4 AS is_stopped
  FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY vid ORDER BY time)
                  AS island
        FROM (SELECT *, lag((xway, dir, lane, position)) OVER (PARTITION BY vid ORDER BY time)
                        = (xway, dir, lane, position) AS same
              FROM reports))"""
_final["trip_reports"] = "SELECT * FROM trips"
_final["vehicle_trips"] = """
  SELECT vid, min(time) AS begin_time, max(time) AS end_time, count(*) AS reports,
         min(position) AS low_position, max(position) AS high_position
  FROM trips GROUP BY vid, trip"""

_final["stopped_at_place"] = f"""
  SELECT {", ".join("r." + c for c in _REPORT.split(", "))},
         count(s.vid) AS standing
  FROM reports r LEFT JOIN stops s
    ON s.xway = r.xway AND s.dir = r.dir AND s.lane = r.lane AND s.position = r.position
   AND s.begin_time <= r.time AND (s.end_time IS NULL OR s.end_time > r.time)
  GROUP BY ALL"""
_final["accidents_by_segment"] = """
  SELECT xway, dir, segment, created_minute, cleared_minute FROM crashes"""
_final["accidents_by_position"] = """
  SELECT xway, dir, segment, position, created_minute, cleared_minute FROM spot_crashes"""
_final["accident_lookup"] = f"""
  SELECT {_KEY}, vid, time, lane, is_crossing, accident_segment FROM looked"""
_final["accident_lookup_lowest"] = f"""
  SELECT {_KEY}, vid, time, lane, is_crossing, lowest_segment AS accident_segment FROM looked"""
_final["accident_alerts"] = """
  SELECT vid, time, xway, dir, accident_segment FROM tolls WHERE accident_segment <> -1"""
_steps["crash_minutes"] = """
  SELECT s.xway, s.dir, s.segment, s.minute, bool_or(c.begin_time IS NOT NULL) AS accident
  FROM state s LEFT JOIN spot_crashes c
    ON c.xway = s.xway AND c.dir = s.dir AND c.segment = s.segment
   AND c.begin_time <= s.time AND (c.end_time IS NULL OR c.end_time > s.time)
  GROUP BY s.xway, s.dir, s.segment, s.minute"""
_final["accident_minutes"] = "SELECT * FROM crash_minutes"
_final["accident_minute_lookup"] = f"""
  WITH busy AS (SELECT {_KEY} FROM state WHERE is_stopped GROUP BY {_KEY}
                HAVING count(DISTINCT vid) >= 2)
  SELECT {_KEY}, vid, time,
         CASE WHEN is_stopped
              THEN EXISTS (SELECT 1 FROM busy b WHERE b.xway = s.xway AND b.dir = s.dir
                             AND b.segment = s.segment AND b.minute IN (s.minute, s.minute - 1))
              ELSE EXISTS (SELECT 1 FROM busy b WHERE b.xway = s.xway AND b.dir = s.dir
                             AND b.minute = s.minute - 1
                             AND CASE WHEN s.dir = 0 THEN b.segment - s.segment
                                      ELSE s.segment - b.segment END BETWEEN 0 AND 4)
         END AS accident
  FROM state s"""

_final["segment_minute_stats"] = "SELECT * FROM stats"
_final["nov"] = f"SELECT {_KEY}, nov FROM conditions"
_final["lav"] = f"SELECT {_KEY}, lav FROM conditions"
_steps["seen"] = f"""
  SELECT {_KEY}, count(DISTINCT vid) AS vehicles FROM reports GROUP BY {_KEY}"""
_final["nov_distinct"] = """
  SELECT s.xway, s.dir, s.segment, s.minute, s.vehicles, coalesce(b.vehicles, 0) AS nov
  FROM seen s LEFT JOIN seen b ON b.xway = s.xway AND b.dir = s.dir AND b.segment = s.segment
                              AND b.minute = s.minute - 1"""
_steps["minute_means"] = f"SELECT {_KEY}, avg(speed) AS mean FROM reports GROUP BY {_KEY}"
_final["lav_mean_of_minutes"] = """
  SELECT s.xway, s.dir, s.segment, s.minute, round(coalesce(sum(b.mean), 0) / 5, 6) AS lav
  FROM minute_means s LEFT JOIN minute_means b
    ON b.xway = s.xway AND b.dir = s.dir AND b.segment = s.segment
   AND b.minute BETWEEN s.minute - 5 AND s.minute - 1
  GROUP BY s.xway, s.dir, s.segment, s.minute"""
_final["segment_minute_report_count"] = f"""
  SELECT {_KEY}, count(*) AS reports FROM reports GROUP BY {_KEY}"""
_final["running_speed_sum"] = f"""
  SELECT {_KEY}, time, vid, count(*) OVER w AS reports,
         CAST(sum(speed) OVER w AS BIGINT) AS speed_sum
  FROM reports WINDOW w AS (PARTITION BY {_KEY} ORDER BY time, vid
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_final["running_crossing_stats"] = f"""
  SELECT {_KEY}, time, vid, count(*) FILTER (WHERE is_crossing) OVER w AS crossings,
         count(*) OVER w AS reports, CAST(sum(speed) OVER w AS BIGINT) AS speed_sum
  FROM state WINDOW w AS (PARTITION BY {_KEY} ORDER BY time, vid
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_final["vehicle_minute_speed"] = """
  SELECT vid, minute, avg(speed) AS mean_speed FROM reports GROUP BY vid, minute"""
_final["minute_speed"] = """
  SELECT minute, round(avg(m), 6) AS mean_speed
  FROM (SELECT vid, minute, avg(speed) AS m FROM reports GROUP BY vid, minute) GROUP BY minute"""
_final["single_report_segments"] = """
  SELECT vid, segment, count(*) AS reports FROM reports GROUP BY vid, segment
  HAVING count(*) = 1"""
_final["segment_tolls"] = """
  SELECT s.xway, s.dir, s.segment, s.minute, coalesce(b.reports, 0) AS vehicles,
         CAST(coalesce(b.speed_sum, 0) AS DOUBLE) AS speed_sum,
         coalesce(a.accident, false) AS accident,
         CAST(CASE WHEN b.reports IS NULL OR CAST(b.speed_sum AS DOUBLE) / b.reports >= 40
                        OR b.reports <= 50 THEN 0
                   ELSE 2 * (b.reports - 50) * (b.reports - 50) END AS DOUBLE) AS toll
  FROM stats s
  LEFT JOIN stats b ON b.xway = s.xway AND b.dir = s.dir AND b.segment = s.segment
                   AND b.minute = s.minute - 1
  LEFT JOIN crash_minutes a ON a.xway = b.xway AND a.dir = b.dir AND a.segment = b.segment
                           AND a.minute = b.minute"""

_final["report_segment_context"] = """
  SELECT vid, time, xway, dir, segment, lav, nov, accident_segment, is_crossing FROM in_context"""
_final["toll_notifications"] = "SELECT * FROM tolls"
_final["account_balance"] = "SELECT * FROM balances"
_final["daily_expenditure"] = "SELECT * FROM spent"
_final["historical_balances"] = """
  SELECT r.vid, r.time, r.xway, r.qid, r.day, h.xway AS toll_xway, h.toll
  FROM (SELECT * FROM requests WHERE typ = 3) r JOIN history h USING (vid, day)"""
_final["all_notifications"] = "SELECT * FROM answers"
_final["notification_lines"] = "SELECT value FROM answer_lines"

_final["word_count"] = r"""
  SELECT word, count(*) AS count
  FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS word FROM documents)
  WHERE length(word) > 0 GROUP BY word"""


# Streams. A window or session is told when its end is DELAY seconds behind the last report.
_steps["spread"] = """
  SELECT xway, dir, segment, minute + step AS minute, speed
  FROM reports, range(1, 6) AS steps(step)"""

_final["stream_source_replay"] = _final["parse_events"]
_final["stream_vehicle_state"] = _final["vehicle_state"]
_final["stream_lav"] = f"""
  SELECT {_KEY}, CAST(floor(avg(speed) + 0.5) AS INTEGER) AS lav
  FROM spread GROUP BY {_KEY}"""
_final["stream_nov_distinct"] = f"""
  SELECT {_KEY}, vehicles FROM seen"""
_final["stream_report_count"] = f"""
  SELECT {_KEY}, count(*) AS reports FROM reports GROUP BY {_KEY}"""
_final["stream_vehicle_trips"] = """
  SELECT vid, min(time) AS begin_time, max(time) AS end_time, count(*) AS reports,
         min(position) AS low_position, max(position) AS high_position
  FROM trips GROUP BY vid, trip"""
_final["stream_daily_expenditure"] = _final["daily_expenditure"]
_final["stream_toll_notifications"] = _final["toll_notifications"]
_final["stream_account_balance"] = _final["account_balance"]
_final["stream_notifications"] = _final["notification_lines"]
_final["stream_disordered_notifications"] = _final["notification_lines"]
# four slices by arrival; each has the watermark of those before it
_final["stream_late_reports"] = """
  WITH arriving AS (
    SELECT *, time + (CAST(vid AS BIGINT) * 7919 + time * 1047 + typ * 31) % 51
      + CASE WHEN (CAST(vid AS BIGINT) * 31 + time) % 97 = 0 THEN 400 ELSE 0 END AS arrival
    FROM road
  ), slices AS (
    SELECT *, arrival * 4 // ((SELECT max(time) FROM road) + 50 + 400 + 1) AS slice FROM arriving
  ), passed AS (
    SELECT slice, max(max(time)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60
      AS watermark
    FROM slices GROUP BY slice
  )
  SELECT vid, time, speed, xway, lane, dir, segment, position
  FROM slices JOIN passed USING (slice) WHERE typ = 0 AND time < watermark"""
_final["stream_state_expiry"] = """
  WITH gaps AS (
    SELECT *, lead(time) OVER w AS next_time,
      CASE WHEN time - lag(time) OVER w > 120 THEN 1 ELSE 0 END AS anew
    FROM reports WINDOW w AS (PARTITION BY xway, dir, vid ORDER BY time)
  ), heard AS (
    SELECT *, sum(anew) OVER (PARTITION BY xway, dir, vid ORDER BY time) AS period FROM gaps
  ), stood AS (
    SELECT *, lag(position, 3) OVER w IS NOT NULL
      AND max(position) OVER last4 = min(position) OVER last4
      AND max(lane) OVER last4 = min(lane) OVER last4 AS was_stopped
    FROM heard
    WINDOW w AS (PARTITION BY xway, dir, vid, period ORDER BY time),
      last4 AS (PARTITION BY xway, dir, vid, period ORDER BY time ROWS 3 PRECEDING)
  )
  SELECT vid, xway, dir, time AS last_time, time + 120 AS expired_time, was_stopped
  FROM stood WHERE next_time IS NULL OR next_time - time > 120"""
_final["cut_vehicle_state"] = _final["vehicle_state"]
_final["cut_notification_lines"] = _final["notification_lines"]
_final["stream_state_audit"] = """
  SELECT 'account' AS kind, vid, xway, CAST(sum(toll) AS BIGINT) AS told,
    arg_max(toll, time) AS latest, CAST(NULL AS INTEGER) AS dir, CAST(NULL AS INTEGER) AS position,
    CAST(NULL AS INTEGER) AS lane, CAST(NULL AS BIGINT) AS last_time, CAST(NULL AS BIGINT) AS reports
  FROM tolls GROUP BY vid, xway
  UNION ALL
  SELECT 'stop', vid, xway, NULL, NULL, dir, position, lane, time, counter FROM (
    SELECT *, row_number() OVER (PARTITION BY xway, dir, vid ORDER BY time DESC) AS back FROM counted)
  WHERE back = 1 AND counter >= 4"""
_final["stream_word_count"] = _final["word_count"]


def _needed(sql: str) -> set[str]:
    """Steps that `sql` names, with the steps those name."""
    found: set[str] = set()
    open_sql = [sql]
    while open_sql:
        for name in set(re.findall(r"[a-z_]+", open_sql.pop())) & _steps.keys() - found:
            found.add(name)
            open_sql.append(_steps[name])
    return found


def _with_steps(sql: str) -> str:
    need = _needed(sql)
    # steps are declared in an order in which each names only earlier ones
    steps = [f"{name} AS ({body})" for name, body in _steps.items() if name in need]
    if not steps:
        return sql.strip()
    body = sql.strip()
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(steps) + ",\n" + body.removeprefix("WITH ")
    return "WITH " + ",\n".join(steps) + "\n" + body


def oracle_queries() -> dict[str, str]:
    return {name: _with_steps(sql) for name, sql in _final.items()}
