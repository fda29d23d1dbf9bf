"""SQL twins of the cycle, corridor, pedestrian and preemption reports."""

from junctura.plans.arrival_sql import sql

START, END = 1_704_067_200_000_000, 1_704_110_400_000_000
Q, HOUR, DAY = 900_000_000, 3_600_000_000, 86_400_000_000
_CYC = "cyc AS (SELECT * FROM (SELECT *, sum(CASE WHEN code = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id, phase ORDER BY t, code ROWS UNBOUNDED PRECEDING) AS cycle FROM pev WHERE {codes}) WHERE cycle > 0)"
_PW = "PARTITION BY signal_id, phase ORDER BY t, code"


def _plan(code: int, count: str) -> str:
    return sql(
        f"SELECT signal_id, make_timestamp(t) AS event_time, param AS event_param, plan AS plan_number, make_timestamp(b) AS plan_start, make_timestamp(e) AS plan_end, count(*) OVER (PARTITION BY signal_id, plan) AS {count} FROM m",
        f"m AS (SELECT w.signal_id, w.t, w.param, coalesce(CAST(p.plan_number AS VARCHAR), 'unknown') AS plan, coalesce(p.begin, {START}) AS b, coalesce(p.finish, {END}) AS e FROM win w LEFT JOIN plans p ON p.signal_id = w.signal_id AND p.begin <= w.t AND (p.finish IS NULL OR p.finish > w.t) WHERE w.code = {code})",
    )


#: Both machines row by row, a step of the recursion for each event of a signal or channel.
_SKIPS = """
gr AS MATERIALIZED (SELECT signal_id, param AS p, t, row_number() OVER (PARTITION BY signal_id ORDER BY t, param) AS k FROM win WHERE code = 1),
walk AS (
    SELECT signal_id, k, t, 1::BIGINT << p AS seen, 1::BIGINT << p AS known, 0::BIGINT AS gone FROM gr WHERE k = 1
    UNION ALL
    SELECT g.signal_id, g.k, g.t, CASE WHEN w.seen & (1::BIGINT << g.p) = 0 THEN w.seen ELSE 0 END | (1::BIGINT << g.p), w.known | (1::BIGINT << g.p),
        CASE WHEN w.seen & (1::BIGINT << g.p) = 0 THEN 0 ELSE w.known - (w.known & w.seen) END
    FROM walk w JOIN gr g ON g.signal_id = w.signal_id AND g.k = w.k + 1
)"""
_PREEMPTS = """
pe AS MATERIALIZED (SELECT signal_id, param AS ch, t, code, row_number() OVER (PARTITION BY signal_id, param ORDER BY t, code) AS k FROM win WHERE code BETWEEN 102 AND 111),
walk AS (
    SELECT signal_id, ch, k, t, code, CASE code WHEN 105 THEN 2 WHEN 102 THEN 1 ELSE 0 END AS s, CASE WHEN code IN (102, 105) THEN 1 ELSE 0 END AS c, code AS opener FROM pe WHERE k = 1
    UNION ALL
    SELECT signal_id, ch, k, t, code, CASE WHEN code = 105 THEN 2 WHEN code = 102 AND b = 0 THEN 1 ELSE b END,
        c + CASE WHEN code = 102 AND b = 0 OR code = 105 AND b != 1 THEN 1 ELSE 0 END, CASE WHEN code = 102 AND b = 0 OR code = 105 AND b != 1 THEN code ELSE opener END
    FROM (SELECT e.*, w.c, w.opener, CASE WHEN w.code = 111 OR e.t - w.t > 1200000000 THEN 0 ELSE w.s END AS b FROM walk w JOIN pe e ON e.signal_id = w.signal_id AND e.ch = w.ch AND e.k = w.k + 1)
),
f AS (SELECT *, lead(t) OVER v AS nt, lead(c) OVER v AS nc, lead(code) OVER v AS ncode FROM walk WINDOW v AS (PARTITION BY signal_id, ch ORDER BY k)),
o AS (
    SELECT signal_id, ch, c, min(t) AS a, opener = 102 AS delayed, min(t) FILTER (code = 102) AS i, min(t) FILTER (code = 105) AS e, min(t) FILTER (code = 103) AS gd, min(t) FILTER (code = 104) AS io,
        min(t) FILTER (code = 106) AS tc, min(t) FILTER (code = 107) AS dw, min(t) FILTER (code = 110) AS mp, count(*) FILTER (code = 102) AS calls,
        arg_max(struct_pack(t := t, code := code, nt := nt, nc := nc, ncode := ncode), k) AS z
    FROM f WHERE s > 0 GROUP BY signal_id, ch, c, opener
),
q AS (SELECT *, z.code != 111 AND coalesce(z.nc = c + 1 AND z.ncode = 105 AND z.nt - z.t <= 1200000000, false) AS again FROM o)"""

SQL = {
    "report_phase_skips": sql(
        "SELECT signal_id, p AS phase_number, make_timestamp(t // 900000000 * 900000000) AS bin_start, count(*) AS skip_count FROM walk, range(63) r(p) WHERE gone & (1::BIGINT << p::INT) != 0 GROUP BY ALL", _SKIPS
    ).replace("WITH", "WITH RECURSIVE", 1),
    "report_preempt_detail": sql(
        "SELECT signal_id, ch AS preempt_number, make_timestamp(a) AS cycle_start, make_timestamp(fin) AS cycle_end, make_timestamp(coalesce(i, e, a)) AS input_on, make_timestamp(io) AS input_off, make_timestamp(gd) AS gate_down, make_timestamp(e) AS entry_started, make_timestamp(tc) AS begin_track_clearance, make_timestamp(dw) AS begin_dwell_service, make_timestamp(mp) AS max_presence_exceeded, delayed AS has_delay, "
        "CASE WHEN delayed THEN (e - a) / 1e6 ELSE 0.0 END::DOUBLE AS delay_seconds, ((CASE WHEN tc IS NULL OR dw > tc THEN dw ELSE tc END) - coalesce(CASE WHEN delayed THEN e END, a)) / 1e6 AS time_to_service_seconds, (fin - dw) / 1e6 AS dwell_time_seconds, (dw - tc) / 1e6 AS track_clear_seconds, (mp - a) / 1e6 AS call_max_out_seconds, "
        "z.code != 111 AND NOT again AND z.nt IS NOT NULL AS terminated_by_timeout, calls FROM (SELECT *, CASE WHEN again THEN z.nt ELSE z.t END AS fin FROM q)",
        _PREEMPTS,
    ).replace("WITH", "WITH RECURSIVE", 1),
    "report_purdue_diagram": sql(
        "SELECT signal_id, phase AS phase_number, make_timestamp(g) AS green_start, make_timestamp(y) AS yellow_start, make_timestamp(r) AS red_start, make_timestamp(e) AS cycle_end, (y - g) / 1e6 AS green_duration, (r - y) / 1e6 AS yellow_duration, (e - r) / 1e6 AS red_duration, (e - g) / 1e6 AS cycle_duration, x AS termination_type FROM c",
        _CYC.format(codes="code IN (1, 4, 5, 6, 8, 9, 10)"),
        "c AS (SELECT signal_id, phase, cycle, min(CASE WHEN code = 1 THEN t END) AS g, min(CASE WHEN code = 8 THEN t END) AS y, min(CASE WHEN code = 9 THEN t END) AS r, min(CASE WHEN code = 10 THEN t END) AS e, CASE WHEN bool_or(code = 4) THEN 'gap_out' WHEN bool_or(code = 5) THEN 'max_out' WHEN bool_or(code = 6) THEN 'force_off' END AS x FROM cyc GROUP BY ALL)",
    ),
    "report_split_monitor": sql(
        "SELECT *, greatest(total_split - green_time - yellow_time, 0.0) AS red_clearance_time FROM o",
        f"s AS (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN code = 8 THEN t END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN code = 1 THEN 0 WHEN code IN (4, 5, 6) THEN code END IGNORE NULLS) OVER w AS x FROM pev WHERE code IN (1, 4, 5, 6, 8, 9) WINDOW w AS ({_PW} ROWS UNBOUNDED PRECEDING))",
        "o AS (SELECT signal_id, phase AS phase_number, count(*) AS cycles, coalesce(sum(y - g) FILTER (y >= g) / 1e6 / count(*) FILTER (y >= g), 0.0) AS green_time, coalesce(sum(t - y) FILTER (y >= g) / 1e6 / count(*) FILTER (y >= g), 0.0) AS yellow_time, sum(t - g) / 1e6 / count(*) AS total_split, count(*) FILTER (x = 6) * 100.0 / count(*) AS force_off_pct, count(*) FILTER (x = 4) * 100.0 / count(*) AS gap_out_pct, count(*) FILTER (x = 5) * 100.0 / count(*) AS max_out_pct FROM s WHERE code = 9 AND g IS NOT NULL GROUP BY signal_id, phase)",
    ),
    "report_phase_termination": sql(f"SELECT signal_id, phase AS phase_number, make_timestamp(t // {Q} * {Q}) AS bin_start, count(*) FILTER (code = 4) AS gap_out_count, count(*) FILTER (code = 5) AS max_out_count, count(*) FILTER (code = 6) AS force_off_count, count(*) FILTER (code = 1) AS total_cycles FROM pev WHERE code IN (1, 4, 5, 6) GROUP BY ALL"),
    "report_time_space_diagram": sql(
        "SELECT signal_id, make_timestamp(t) AS start, make_timestamp(f) AS \"end\", CASE code WHEN 1 THEN 'green' WHEN 8 THEN 'yellow' ELSE 'red' END AS state FROM s WHERE f IS NOT NULL",
        f"s AS (SELECT *, lead(t) OVER ({_PW}) AS f FROM pev WHERE code IN (1, 8, 9) AND phase = 2)",
    ),
    "report_time_space_diagram_average": sql(
        "SELECT signal_id, plan_number, k AS cycle_index, make_timestamp(ref + k * len) AS green_start, make_timestamp(ref + k * len + g) AS yellow_start, make_timestamp(ref + k * len + g + y) AS red_start, make_timestamp(ref + k * len + len) AS cycle_end, len / 1e6 AS cycle_seconds, CAST(place * 1000 AS DOUBLE) AS distance_feet, place * 1000.0 / (CAST(30.0 AS DOUBLE) * 1.467) AS travel_seconds FROM (SELECT *, unnest(range(CAST(ceil((lim - ref) / len) AS BIGINT))) AS k FROM z)",
        _CYC.format(codes="code IN (1, 8, 9) AND phase = 2"),
        "c0 AS (SELECT signal_id, cycle, min(CASE WHEN code = 1 THEN t END) AS s, min(CASE WHEN code = 8 THEN t END) AS yt, min(CASE WHEN code = 9 THEN t END) AS rt FROM cyc GROUP BY ALL)",
        "c1 AS (SELECT signal_id, s, yt - s AS g, rt - yt AS y, lead(s) OVER (PARTITION BY signal_id ORDER BY cycle) - rt AS r FROM c0)",
        "c2 AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY g, s) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM c1 WHERE g > 0 AND y > 0 AND r > 0)",
        f"m AS (SELECT c2.*, g + y + r AS len, p.plan_number, {START + 3_600_000_000} AS b, {START + 7_320_000_000} AS lim, sig.place FROM c2 JOIN sig USING (signal_id) JOIN LATERAL (SELECT plan_number FROM plans WHERE plans.signal_id = c2.signal_id AND begin <= {START + 3_600_000_000} ORDER BY begin DESC LIMIT 1) p ON true WHERE i = n // 2)",
        "z0 AS (SELECT *, b + plan_number * 10 * 1000000 - (g + y - 35000000) AS ref0 FROM m)",
        "z AS (SELECT *, ref0 - CAST(ceil((ref0 - b) / len) AS BIGINT) * len AS ref FROM z0)",
    ),
    "report_time_space_average_week": sql(
        "SELECT signal_id, 2 AS phase_number, k AS cycle_index, e AS event, make_timestamp(ref + k * len + a) AS event_time, place * 1000.0 AS distance_ft, (len + 500) // 1000 / 1000.0 AS cycle_length_seconds, (g + 500) // 1000 / 1000.0 AS median_green_seconds, (y + 500) // 1000 / 1000.0 AS median_yellow_seconds, (r + 500) // 1000 / 1000.0 AS median_red_seconds, split AS programmed_split_seconds, days AS days_included, 30.0 AS speed_limit_applied FROM (SELECT *, unnest(range((lim - ref) // len + 1)) AS k FROM z) JOIN LATERAL (VALUES ('green', 0), ('yellow', g), ('red', g + y)) s(e, a) ON true",
        f"one AS (SELECT signal_id FROM sig ORDER BY place LIMIT 1), days AS (SELECT {START} + d * {DAY} + {2 * HOUR} AS b, {START} + d * {DAY} + {23 * HOUR // 2} AS f FROM range(5) g(d))",
        "dp AS (SELECT d.*, (SELECT plan_number FROM plans JOIN one USING (signal_id) WHERE begin <= d.b ORDER BY begin DESC LIMIT 1) AS plan FROM days d)",
        f"a AS (SELECT plan FROM dp WHERE b = {START + 2 * HOUR}), kept AS (SELECT b, f FROM dp WHERE (SELECT plan FROM a) IS NULL OR plan = (SELECT plan FROM a))",
        "pe AS (SELECT c.signal_id, c.t, c.code, k.b FROM cel c JOIN kept k ON c.t BETWEEN k.b AND k.f WHERE c.code IN (1, 8, 9) AND c.param = 2)",
        "c0 AS (SELECT signal_id, b, t AS s, lead(t) OVER (PARTITION BY signal_id, b ORDER BY t) AS nx FROM pe WHERE code = 1)",
        "c1 AS (SELECT c0.*, (SELECT min(t) FROM pe WHERE pe.signal_id = c0.signal_id AND pe.b = c0.b AND code = 8 AND t > s AND t < nx) AS yt, (SELECT min(t) FROM pe WHERE pe.signal_id = c0.signal_id AND pe.b = c0.b AND code = 9 AND t > s AND t < nx) AS rt FROM c0)",
        "c2 AS (SELECT signal_id, b, s, yt - s AS g, rt - yt AS y, nx - rt AS r FROM c1 WHERE yt > s AND rt > yt AND nx > rt)",
        "c3 AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY g, s) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM c2)",
        "m AS (SELECT c3.*, (SELECT count(DISTINCT b) FROM c2 WHERE c2.signal_id = c3.signal_id) AS days, place, (SELECT plan FROM a) AS plan FROM c3 JOIN sig USING (signal_id) WHERE i = n // 2)",
        "z0 AS (SELECT *, CASE WHEN plan IS NULL THEN 0.0 ELSE 35.0 END AS split, greatest(CASE WHEN plan IS NULL THEN 0 ELSE 90000000 END, g + y + r) AS len, CASE WHEN plan IS NULL THEN -(g + y) ELSE plan * 10000000 - (g + y - 35000000) END AS off FROM m)",
        f"z AS (SELECT *, {START + 2 * HOUR} + off - CASE WHEN off > 0 THEN (off + len - 1) // len ELSE 0 END * len AS ref, {START + 23 * HOUR // 2 + 120_000_000} AS lim FROM z0)",
    ).replace("epoch_us(ts)", "epoch_us(ts + to_days(CAST(60 * (event_id % 7) AS INT)))"),
    "report_green_time_utilization": sql(
        f"SELECT b.signal_id, b.phase AS phase_number, x_bin, make_timestamp({START} + x_bin * {Q}) AS bin_start, n AS cycle_count, ag AS avg_green_seconds, split AS programmed_split_seconds, CASE WHEN split - coalesce(yr, 0.0) > 0 THEN ag * 100.0 / (split - coalesce(yr, 0.0)) ELSE 0.0 END AS utilization_pct FROM b2 b LEFT JOIN yr USING (signal_id, phase)",
        f"s AS (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN code = 8 THEN t END IGNORE NULLS) OVER w AS y FROM pev WHERE code IN (1, 8, 9) WINDOW w AS ({_PW} ROWS UNBOUNDED PRECEDING))",
        "gr AS (SELECT signal_id, phase, g, min(t) AS e FROM s WHERE code = 8 AND g IS NOT NULL GROUP BY ALL)",
        "yr0 AS (SELECT signal_id, phase, y, min(t) AS r FROM s WHERE code = 9 AND y IS NOT NULL GROUP BY ALL)",
        "yr AS (SELECT signal_id, phase, sum(r - y) / 1e6 / count(*) AS yr FROM yr0 GROUP BY ALL)",
        f"b1 AS (SELECT signal_id, phase, (g - {START}) // {Q} AS x_bin, count(*) AS n, sum(e - g) / 1e6 / count(*) AS ag FROM gr GROUP BY ALL)",
        f"b2 AS (SELECT b1.*, CASE WHEN EXISTS (SELECT 1 FROM plans p WHERE p.signal_id = b1.signal_id AND p.begin <= {START} + x_bin * {Q}) THEN CAST(CASE phase WHEN 2 THEN 35 WHEN 4 THEN 25 WHEN 6 THEN 40 WHEN 8 THEN 20 ELSE 0 END AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS split FROM b1)",
    ),
    "cycles_green_detections": sql(
        f"SELECT c.signal_id, c.phase AS phase_number, (g - {START}) // {Q} AS x_bin, (d.t - g) // 2000000 AS y_bin, count(*) AS detections FROM c JOIN dev d ON d.code = 82 AND d.signal_id = c.signal_id AND d.phase = c.phase AND d.t BETWEEN c.g AND c.y GROUP BY ALL",
        f"c AS (SELECT signal_id, phase, t AS g, y FROM (SELECT *, lead(code) OVER ({_PW}) AS following, lead(t) OVER ({_PW}) AS y FROM pev WHERE code IN (1, 8)) WHERE code = 1 AND following = 8)",
    ),
    "report_link_pivot": sql(
        "SELECT a AS from_signal, b AS to_signal, round(avg((nx - t) / 1e6), 6) AS avg_offset, round(stddev_pop((nx - t) / 1e6), 6) AS stddev_offset, count(*) AS sample_count FROM m WHERE (nx - t) / 1e6 <= 300 GROUP BY a, b",
        "l AS (SELECT x.signal_id AS a, y.signal_id AS b FROM sig x JOIN sig y ON y.place = x.place + 1)",
        "m AS (SELECT l.a, l.b, (SELECT min(t) FROM pev d WHERE d.code = 1 AND d.phase = 2 AND d.signal_id = l.b AND d.t >= u.t) AS nx, u.t FROM pev u JOIN l ON l.a = u.signal_id WHERE u.code = 1 AND u.phase = 2)",
    ),
    "report_transit_signal_priority": sql(
        "SELECT signal_id, make_timestamp(bin) AS time_bin, count(*) FILTER (code IN (112, 102)) AS tsp_requests, count(*) FILTER (code = 114) AS tsp_adjustments, count(*) FILTER (code = 113) AS tsp_early_green, sum(d) FILTER (k) / 1e6 / nullif(count(*) FILTER (k), 0) AS avg_green_with_tsp, sum(d) FILTER (NOT k) / 1e6 / nullif(count(*) FILTER (NOT k), 0) AS avg_green_without_tsp FROM u GROUP BY signal_id, bin",
        "p0 AS (SELECT *, lead(code IN (112, 102)) OVER w AS no, lead(t) OVER w AS nt FROM win WHERE code IN (102, 104, 112, 114) WINDOW w AS (PARTITION BY signal_id ORDER BY t, code, param))",
        "p AS (SELECT signal_id, t AS b, coalesce(nt, t + 120000000) AS e FROM p0 WHERE code IN (112, 102) AND (no IS NULL OR NOT no))",
        f"g0 AS (SELECT *, first_value(CASE WHEN code = 8 THEN t END IGNORE NULLS) OVER ({_PW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS y FROM pev WHERE code IN (1, 8) AND phase = 2)",
        "g AS (SELECT signal_id, t, y, EXISTS (SELECT 1 FROM p WHERE p.signal_id = g0.signal_id AND p.b < g0.y AND p.e > g0.t) AS k FROM g0 WHERE code = 1 AND y > t AND y - t <= 300000000)",
        f"u AS (SELECT signal_id, t // {Q} * {Q} AS bin, code, NULL AS d, NULL AS k FROM win WHERE code IN (102, 112, 113, 114) UNION ALL SELECT signal_id, t // {Q} * {Q}, NULL, y - t, k FROM g)",
    ),
    "report_ped_delay": sql(
        "SELECT app.signal_id, app.phase AS phase_number, count(w) AS ped_actuations, coalesce(sum(w - t) / 1e6 / count(w), 0.0) AS avg_delay_seconds, coalesce(max(w - t) / 1e6, 0.0) AS max_delay_seconds FROM app LEFT JOIN m ON m.signal_id = app.signal_id AND m.phase = app.phase GROUP BY ALL",
        "m AS (SELECT d.signal_id, d.phase, d.t, (SELECT min(t) FROM win x WHERE x.code = 21 AND x.signal_id = d.signal_id AND x.param = d.phase AND x.t > d.t) AS w FROM dev d WHERE d.code = 82)",
    ),
    "report_preempt_service": _plan(105, "plan_preempt_count"),
    "report_preempt_service_request": _plan(102, "plan_request_count"),
    "report_preemption": sql(
        "SELECT signal_id, param AS channel, make_timestamp(b) AS start, make_timestamp(t) AS \"end\", (t - b) / 1e6 AS duration_seconds FROM s WHERE code = 104 AND pc = 102",
        "s AS (SELECT *, lag(code) OVER w AS pc, lag(t) OVER w AS b FROM win WHERE code IN (102, 104) WINDOW w AS (PARTITION BY signal_id, param ORDER BY t, code))",
    ),
}
