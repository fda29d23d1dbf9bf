"""SQL twins of the volume and arrival reports."""

from junctura.sources.derived import PRELUDE

Q = 900_000_000
W = "OVER (PARTITION BY signal_id, phase ORDER BY t, code, param"


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([PRELUDE, *more])} {body}"


HOUR_BIN = f"make_timestamp(t // {Q} * {Q})"
_CYC = "cyc AS (SELECT * FROM (SELECT stm.*, sum(CASE WHEN code = 1 THEN 1 ELSE 0 END) OVER w AS cycle, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER w AS green FROM stm WHERE {codes} WINDOW w AS (PARTITION BY signal_id, phase ORDER BY t, code, param ROWS UNBOUNDED PRECEDING)) WHERE cycle > 0)"

SQL = {
    "report_approach_volume": sql(f"SELECT signal_id, approach_id, direction, {HOUR_BIN} AS bin_start, count(*) AS volume FROM dev WHERE code = 82 GROUP BY ALL"),
    "report_turning_movement_counts": sql(f"SELECT signal_id, approach_id, direction, {HOUR_BIN} AS bin_start, count(*) AS volume FROM dev WHERE code = 82 GROUP BY ALL"),
    "report_bike_volume": sql(f"SELECT signal_id, {HOUR_BIN} AS bin_start, param AS channel, count(*) AS volume FROM win WHERE code = 82 AND param IN (1, 5) GROUP BY ALL"),
    "report_approach_speed": sql(
        "SELECT signal_id, approach_id, direction, round(avg(mph), 6) AS avg_speed, max(CASE WHEN place = least(n * 85 // 100, n - 1) THEN mph END) AS p85_speed, max(CASE WHEN place = least(n * 15 // 100, n - 1) THEN mph END) AS p15_speed, count(*) AS sample_count, 35 AS speed_limit FROM r GROUP BY ALL",
        "p AS (SELECT *, lag(code) OVER w AS pc, lag(t) OVER w AS pt FROM dev WHERE distance > 0 WINDOW w AS (PARTITION BY signal_id, param ORDER BY t, code))",
        "m AS (SELECT *, distance / ((t - pt) / 1e6) / 1.467 AS mph FROM p WHERE code = 81 AND pc = 82 AND t > pt)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, approach_id ORDER BY mph, t) - 1 AS place, count(*) OVER (PARTITION BY signal_id, approach_id) AS n FROM m WHERE mph BETWEEN 5 AND 150)",
    ),
    "report_timing_and_actuations": sql(
        "SELECT signal_id, make_timestamp(t) AS event_time, code AS event_code, param AS event_param, coalesce(n.name, 'Unknown (' || code || ')') AS event_name FROM win LEFT JOIN n USING (code) WHERE code IN (1, 4, 5, 6, 7, 8, 9, 10, 81, 82)",
        "n(code, name) AS (VALUES (1, 'Phase Green'), (4, 'Gap Out'), (5, 'Max Out'), (6, 'Force Off'), (7, 'Green Termination'), (8, 'Yellow Clearance'), (9, 'Red Clearance'), (10, 'Phase End'), (81, 'Detector Off'), (82, 'Detector On'))",
    ),
    "report_ramp_metering": sql(
        "SELECT signal_id, make_timestamp(bin) AS time_bin, CAST(count(p) * 4 AS DOUBLE) AS metering_rate, coalesce(sum(g) / 1e6 / count(g), 0.0) AS avg_green_seconds, count(d) AS demand_volume, count(p) AS passage_volume, CASE WHEN count(o) > 0 THEN least(CAST(sum(o) AS DOUBLE) * 100.0 / 900000000, 100.0) END AS queue_occupancy_pct FROM u GROUP BY signal_id, bin",
        "g0 AS (SELECT *, first_value(CASE WHEN code = 8 THEN t END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY t, code ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS y FROM win WHERE code IN (1, 8) AND param = 2)",
        "q0 AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY signal_id ORDER BY t, code), 81) AS b FROM win WHERE code IN (81, 82) AND param = 3)",
        "q1 AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY signal_id ORDER BY t, code), 1704110400000000) AS f FROM q0 WHERE code <> b)",
        f"q2 AS (SELECT signal_id, t, f, unnest(range(t // {Q}, (f - 1) // {Q} + 1)) * {Q} AS bin FROM q1 WHERE code = 82 AND f > t)",
        f"u AS (SELECT signal_id, t // {Q} * {Q} AS bin, CASE WHEN param = 1 THEN 1 END AS d, CASE WHEN param = 2 THEN 1 END AS p, NULL AS g, NULL AS o FROM win WHERE code = 82 AND param IN (1, 2) UNION ALL SELECT signal_id, t // {Q} * {Q}, NULL, NULL, y - t, NULL FROM g0 WHERE code = 1 AND y > t AND y - t <= 60000000 UNION ALL SELECT signal_id, bin, NULL, NULL, NULL, least(f, bin + {Q}) - greatest(t, bin) FROM q2)",
    ),
    "report_approach_delay": sql(
        f"SELECT signal_id, approach_id, {HOUR_BIN} AS period, sum(t - g) / 1e6 / count(*) AS avg_delay_seconds, count(*) AS volume FROM s WHERE code = 82 AND g IS NOT NULL GROUP BY ALL",
        f"s AS (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS g FROM stm WHERE code IN (1, 82))",
    ),
    "report_arrival_on_red": sql(
        "SELECT signal_id, make_timestamp(bin) AS bin_start, phase AS phase_number, n AS total_detections, r AS arrivals_on_red, r * 100.0 / n AS pct_arrivals_on_red, CAST(n * 4 AS DOUBLE) AS total_vehicles_per_hour, CAST(r * 4 AS DOUBLE) AS arrivals_on_red_per_hour, CAST(sum(n) OVER v AS BIGINT) AS total_detector_hits, CAST(sum(r) OVER v AS BIGINT) AS total_arrival_on_red, CAST(sum(r) OVER v AS DOUBLE) * 100.0 / CAST(sum(n) OVER v AS DOUBLE) AS pct_arrival_on_red_overall FROM b WINDOW v AS (PARTITION BY signal_id)",
        f"s AS (SELECT *, coalesce(last_value(CASE WHEN code = 1 THEN 0 WHEN code IN (8, 9) THEN 1 END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING), 1) AS red FROM stm WHERE code IN (1, 8, 9, 82))",
        f"b AS (SELECT signal_id, t // {Q} * {Q} AS bin, phase, count(*) AS n, CAST(sum(red) AS BIGINT) AS r FROM s WHERE code = 82 GROUP BY ALL)",
    ),
    "report_arrivals_on_green": sql(
        "SELECT app.signal_id, app.phase AS phase_number, coalesce(n, 0) AS total_arrivals, coalesce(g, 0) AS arrivals_on_green, CASE WHEN n > 0 THEN g * 100.0 / n ELSE 0.0 END AS aog_percentage FROM app LEFT JOIN c USING (signal_id, phase)",
        f"s AS (SELECT *, coalesce(last_value(CASE WHEN code = 1 THEN 1 WHEN code = 8 THEN 0 END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING), 0) AS green FROM stm WHERE code IN (1, 8, 82))",
        "c AS (SELECT signal_id, phase, count(*) AS n, CAST(sum(green) AS BIGINT) AS g FROM s WHERE code = 82 GROUP BY ALL)",
    ),
    "report_yellow_red_actuations": sql(
        "SELECT signal_id, phase AS phase_number, make_timestamp(green) AS cycle_start, count(*) FILTER (code = 82 AND s = 0) AS green_actuations, count(*) FILTER (code = 82 AND s = 1) AS yellow_actuations, count(*) FILTER (code = 82 AND s = 2) AS red_actuations, count(*) FILTER (code = 82) AS total_actuations FROM r GROUP BY signal_id, phase, cycle, green",
        _CYC.format(codes="code IN (1, 8, 9, 10, 82)"),
        "r AS (SELECT *, max(CASE WHEN code IN (9, 10) THEN 2 WHEN code = 8 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param ROWS UNBOUNDED PRECEDING) AS s FROM cyc)",
    ),
    "report_red_light_monitor": sql(
        "SELECT signal_id, phase AS phase_number, make_timestamp(green) AS cycle_start, make_timestamp(max(red)) AS red_clearance_start, list(strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S.%f') ORDER BY t) FILTER (hit) AS violations, count(*) FILTER (hit) AS violation_count FROM h GROUP BY signal_id, phase, cycle, green HAVING count(*) FILTER (hit) > 0",
        _CYC.format(codes="code IN (1, 9, 10, 82)"),
        "r AS (SELECT *, last_value(CASE WHEN code = 9 THEN t END IGNORE NULLS) OVER v AS red, last_value(CASE WHEN code = 10 THEN t END IGNORE NULLS) OVER v AS e FROM cyc WINDOW v AS (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param ROWS UNBOUNDED PRECEDING))",
        "h AS (SELECT *, code = 82 AND red IS NOT NULL AND (e IS NULL OR t <= e + 2000000) AS hit FROM r)",
    ),
    "report_wait_time": sql(
        "SELECT g.signal_id, g.phase AS phase_number, make_timestamp(g.t) AS cycle_start, count(d.t) AS arrivals_during_red, coalesce(sum(g.t - d.t) / 1e6 / count(d.t), 0.0) AS avg_wait_time, coalesce(max(g.t - d.t) / 1e6, 0.0) AS max_wait_time, coalesce(min(g.t - d.t) / 1e6, 0.0) AS min_wait_time FROM g LEFT JOIN dev d ON d.code = 82 AND d.signal_id = g.signal_id AND d.phase = g.phase AND d.t > g.e AND d.t < g.t WHERE g.pc = 10 GROUP BY ALL",
        "g0 AS (SELECT *, lag(code) OVER (PARTITION BY signal_id, phase ORDER BY t, code) AS pc, lag(t) OVER (PARTITION BY signal_id, phase ORDER BY t, code) AS e FROM pev WHERE code IN (1, 10))",
        "g AS (SELECT * FROM g0 WHERE code = 1)",
    ),
    "report_split_failure": sql(
        "SELECT signal_id, phase AS phase_number, make_timestamp(green) AS cycle_start, go AS green_start_occupancy, ro AS red_start_occupancy, (yellow - green) / 1e6 AS green_duration, (nxt - green) / 1e6 AS cycle_length, go >= 0.79 AND ro >= 0.79 AS is_split_failure FROM o",
        _CYC.format(codes="code IN (1, 8, 9, 10, 81, 82)"),
        "c0 AS (SELECT signal_id, phase, cycle, min(green) AS green, max(CASE WHEN code = 8 THEN t END) AS yellow, max(CASE WHEN code = 9 THEN t END) AS red, max(CASE WHEN code = 10 THEN t END) AS e FROM cyc GROUP BY ALL)",
        "c1 AS (SELECT *, lead(green) OVER (PARTITION BY signal_id, phase ORDER BY cycle) AS nxt, coalesce(red, e, yellow) AS rf FROM c0)",
        "t0 AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param), 81) AS was FROM cyc WHERE code IN (81, 82))",
        "t1 AS (SELECT *, lead(t) OVER (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param) AS f FROM t0 WHERE code <> was)",
        "o AS (SELECT c1.signal_id, c1.phase, c1.cycle, c1.green, yellow, nxt, least(coalesce(sum(CASE WHEN t IS NOT NULL THEN greatest(0, least(coalesce(f, c1.green + 5000000), c1.green + 5000000) - greatest(t, c1.green)) END), 0) / 5e6, 1.0) AS go, least(coalesce(sum(CASE WHEN t IS NOT NULL THEN greatest(0, least(coalesce(f, rf + 5000000), rf + 5000000) - greatest(t, rf)) END), 0) / 5e6, 1.0) AS ro FROM c1 LEFT JOIN t1 ON t1.code = 82 AND t1.signal_id = c1.signal_id AND t1.phase = c1.phase AND t1.cycle = c1.cycle WHERE yellow IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL)",
    ),
}
