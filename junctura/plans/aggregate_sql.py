"""SQL twins of the aggregate tables."""

from junctura.plans.arrival_sql import sql
from junctura.plans.cycle_sql import _PW, END, Q

HOUR = 3_600_000_000
HB, QB = f"make_timestamp(t // {HOUR} * {HOUR}) AS bin_start", f"make_timestamp(t // {Q} * {Q}) AS bin_start"
_F = "count(*) FILTER (code = {})"
_CB = (
    f"b0 AS (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER ({_PW} ROWS UNBOUNDED PRECEDING) AS green FROM pev WHERE code IN (1, 4, 5, 6, 8, 9, 10))",
    "cb AS (SELECT signal_id, phase, green, min(t) FILTER (code = 8) AS y, min(t) FILTER (code = 9) AS r, min(t) FILTER (code = 10) AS e, CASE WHEN count(*) FILTER (code = 4) > 0 THEN 'gap_out' WHEN count(*) FILTER (code = 5) > 0 THEN 'max_out' WHEN count(*) FILTER (code = 6) > 0 THEN 'force_off' END AS tt FROM b0 WHERE t - green <= 300000000 GROUP BY ALL)",
    "full_c AS (SELECT *, lead(green) OVER (PARTITION BY signal_id, phase ORDER BY green) AS nx FROM cb WHERE y IS NOT NULL AND r IS NOT NULL)",
    "ca AS (SELECT c.signal_id, c.phase, d.param AS channel, d.t, c.green, CASE WHEN d.t >= c.r THEN 'red' WHEN d.t >= c.y THEN 'yellow' ELSE 'green' END AS st FROM full_c c JOIN dev d ON d.code = 82 AND d.signal_id = c.signal_id AND d.phase = c.phase AND d.t >= c.green AND d.t < coalesce(c.e, c.green + 300000000) AND (c.nx IS NULL OR d.t < c.nx))",
)
_L = "l AS (SELECT signal_id, t, (t - lag(t) OVER (PARTITION BY signal_id ORDER BY t)) / 1e6 AS len FROM pev WHERE code = 1 AND phase = 2)"

SQL = {
    "agg_detector_volume_hourly": sql(f"SELECT signal_id, param AS channel, {HB}, {_F.format(82)} AS volume, {_F.format(81)} AS activations FROM win WHERE code IN (81, 82) GROUP BY ALL"),
    "agg_detector_volume_daily": sql("SELECT signal_id, param AS channel, make_timestamp(t // 86400000000 * 86400000000) AS day, count(*) FILTER (code = 82) AS volume, count(*) FILTER (code = 81) AS activations FROM win WHERE code IN (81, 82) GROUP BY ALL"),
    "agg_detector_occupancy_hourly": sql(
        f"SELECT signal_id, channel, make_timestamp(bin) AS bin_start, CAST(coalesce(sum(o), 0) AS DOUBLE) * 100.0 / {HOUR} AS occupancy_pct, CAST(coalesce(sum(o), 0) AS DOUBLE) / 1e6 AS total_on_seconds, count(a) AS activation_count FROM u GROUP BY signal_id, channel, bin",
        "x0 AS (SELECT signal_id, param AS channel, t, code, coalesce(lag(code) OVER (PARTITION BY signal_id, param ORDER BY t, code), 81) AS w FROM win WHERE code IN (81, 82))",
        f"x1 AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY signal_id, channel ORDER BY t, code), {END}) AS f FROM x0 WHERE code <> w)",
        f"x2 AS (SELECT signal_id, channel, t, f, unnest(range(t // {HOUR}, (f - 1) // {HOUR} + 1)) * {HOUR} AS bin FROM x1 WHERE code = 82 AND f > t)",
        f"u AS (SELECT signal_id, channel, bin, least(f, bin + {HOUR}) - greatest(t, bin) AS o, NULL AS a FROM x2 UNION ALL SELECT signal_id, channel, t // {HOUR} * {HOUR}, NULL, CASE WHEN code = 82 THEN 1 END FROM x0)",
    ),
    "agg_split_failure_hourly": sql(f"SELECT *, CASE WHEN total_cycles > 0 THEN failed_cycles * 100.0 / total_cycles ELSE 0.0 END AS failure_rate_pct FROM (SELECT signal_id, phase, {HB}, {_F.format(1)} AS total_cycles, {_F.format(5)} AS failed_cycles FROM pev WHERE code IN (1, 5) GROUP BY ALL)"),
    "agg_approach_delay_15min": sql(
        f"SELECT signal_id, phase, {QB}, sum(t - g) / 1e6 / count(*) AS avg_delay_seconds, max(t - g) / 1e6 AS max_delay_seconds, count(*) AS total_arrivals FROM s WHERE code = 82 AND g IS NOT NULL GROUP BY ALL",
        "s AS (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY signal_id, phase ORDER BY t, code, param ROWS UNBOUNDED PRECEDING) AS g FROM stm WHERE code IN (1, 82))",
    ),
    "agg_arrival_on_red_hourly": sql(
        f"SELECT *, arrivals_total - arrivals_on_red AS arrivals_on_green, arrivals_on_red * 100.0 / arrivals_total AS red_pct, (arrivals_total - arrivals_on_red) * 100.0 / arrivals_total AS green_pct FROM (SELECT signal_id, phase, {HB}, count(*) AS arrivals_total, CAST(sum(red) AS BIGINT) AS arrivals_on_red FROM s WHERE code = 82 GROUP BY ALL)",
        "s AS (SELECT *, coalesce(last_value(CASE WHEN code = 1 THEN 0 WHEN code IN (8, 9) THEN 1 END IGNORE NULLS) OVER (PARTITION BY signal_id, phase ORDER BY t, code, param ROWS UNBOUNDED PRECEDING), 1) AS red FROM stm WHERE code IN (1, 8, 9, 82))",
    ),
    "agg_coordination_quality_hourly": sql(
        "SELECT signal_id, make_timestamp(bin) AS bin_start, count(*) AS total_cycles, count(*) FILTER (e <= 2) AS within_tolerance, count(*) FILTER (e <= 2) * 100.0 / count(*) AS quality_pct, max(mean) AS avg_cycle_seconds, round(avg(e), 6) AS avg_offset_error FROM m GROUP BY signal_id, bin",
        _L, f"m0 AS (SELECT *, t // {HOUR} * {HOUR} AS bin FROM l WHERE len IS NOT NULL)", "mm AS (SELECT signal_id, bin, round(avg(len), 6) AS mean FROM m0 GROUP BY ALL)", "m AS (SELECT m0.*, mean, abs(len - mean) AS e FROM m0 JOIN mm USING (signal_id, bin))",
    ),
    "agg_phase_termination_hourly": sql(f"SELECT signal_id, phase, {HB}, {_F.format(1)} AS total_cycles, {_F.format(4)} AS gap_outs, {_F.format(5)} AS max_outs, {_F.format(6)} AS force_offs FROM pev WHERE code IN (1, 4, 5, 6) GROUP BY ALL"),
    "agg_cycle_boundary": sql("SELECT signal_id, phase, make_timestamp(green) AS green_start, make_timestamp(y) AS yellow_start, make_timestamp(r) AS red_start, make_timestamp(e) AS cycle_end, (y - green) / 1e6 AS green_duration_seconds, (r - y) / 1e6 AS yellow_duration_seconds, (e - r) / 1e6 AS red_duration_seconds, (e - green) / 1e6 AS cycle_duration_seconds, tt AS termination_type FROM cb", *_CB[:2]),
    "agg_cycle_detector_arrival": sql("SELECT signal_id, phase, channel, make_timestamp(t) AS arrival_time, make_timestamp(green) AS green_start, (t - green) / 1e6 AS time_in_cycle_seconds, st AS phase_state FROM ca", *_CB),
    "agg_cycle_summary_15min": sql(
        f"SELECT *, CASE WHEN total_arrivals > 0 THEN arrivals_on_green * 100.0 / total_arrivals ELSE 0.0 END AS arrival_on_green_pct FROM (SELECT signal_id, phase, make_timestamp(green // {Q} * {Q}) AS bin_start, count(*) AS total_cycles, sum(e - green) / 1e6 / nullif(count(e), 0) AS avg_cycle_length_seconds, sum(y - green) / 1e6 / nullif(count(y), 0) AS avg_green_seconds, CAST(coalesce(sum(a), 0) AS BIGINT) AS total_arrivals, CAST(coalesce(sum(ag), 0) AS BIGINT) AS arrivals_on_green, CAST(coalesce(sum(ay), 0) AS BIGINT) AS arrivals_on_yellow, CAST(coalesce(sum(ar), 0) AS BIGINT) AS arrivals_on_red FROM cb LEFT JOIN h USING (signal_id, phase, green) GROUP BY ALL)",
        *_CB, "h AS (SELECT signal_id, phase, green, count(*) AS a, count(*) FILTER (st = 'green') AS ag, count(*) FILTER (st = 'yellow') AS ay, count(*) FILTER (st = 'red') AS ar FROM ca GROUP BY ALL)",
    ),
    "agg_approach_speed_15min": sql(
        f"SELECT signal_id, approach_id, {QB}, round(quantile_cont(mph, 0.15), 6) AS p15, round(quantile_cont(mph, 0.5), 6) AS p50, round(quantile_cont(mph, 0.85), 6) AS p85, count(*) AS sample_count FROM s GROUP BY ALL",
        "s AS (SELECT 'SIG-00' || sn AS signal_id, 'SIG-00' || sn || '-P' || (2 * (1 + event_id % 2)) AS approach_id, t, CAST(CAST(trunc(value) AS INT) % 70 + 10 AS DOUBLE) AS mph FROM ev0)",
    ),
    "agg_approach_speed_15min_nearest": sql(
        f"SELECT signal_id, approach_id, {QB}, m[greatest(1, CAST(ceil(n * 0.15) AS INT))] AS p15, m[greatest(1, CAST(ceil(n * 0.5) AS INT))] AS p50, m[greatest(1, CAST(ceil(n * 0.85) AS INT))] AS p85, n AS sample_count FROM (SELECT signal_id, approach_id, t // 900000000 * 900000000 AS t, list_sort(list(mph)) AS m, count(*) AS n FROM s GROUP BY ALL)",
        "s AS (SELECT 'SIG-00' || sn AS signal_id, 'SIG-00' || sn || '-P' || (2 * (1 + event_id % 2)) AS approach_id, t, CAST(CAST(trunc(value) AS INT) % 70 + 10 AS DOUBLE) AS mph FROM ev0)",
    ),
    "agg_phase_cycle_15min": sql(
        f"SELECT signal_id, phase, {QB}, coalesce(sum(d) FILTER (code = 1) / 1e6, 0.0) AS green_seconds, coalesce(sum(d) FILTER (code = 8) / 1e6, 0.0) AS yellow_seconds, coalesce(sum(d) FILTER (code = 9) / 1e6, 0.0) AS red_seconds, {_F.format(1)} AS cycle_count FROM s WHERE d IS NOT NULL GROUP BY ALL",
        f"s AS (SELECT *, lead(t) OVER ({_PW}) - t AS d FROM pev WHERE code IN (1, 8, 9))",
    ),
    "agg_phase_left_turn_gap_15min": sql(
        f"SELECT signal_id, phase, {QB}, " + ", ".join(f"count(*) FILTER (g >= {(k - 1) * 1_000_000} AND g < {k * 1_000_000}) AS bin_{k}s" for k in range(1, 11)) + ", count(*) FILTER (g >= 10000000) AS bin_10plus FROM s WHERE g IS NOT NULL GROUP BY ALL",
        "s AS (SELECT *, t - lag(t) OVER (PARTITION BY signal_id, param ORDER BY t) AS g FROM dev WHERE code = 82 AND movement = 'L')",
    ),
    "agg_phase_pedestrian_15min": sql(
        f"SELECT signal_id, phase, {QB}, {_F.format(21)} AS walk_count, {_F.format(45)} AS call_count, coalesce(sum(w - t) FILTER (code = 45) / 1e6, 0.0) AS delay_sum_seconds, count(w) FILTER (code = 45) AS delay_count FROM s GROUP BY ALL",
        "s AS (SELECT a.signal_id, a.param AS phase, a.t, a.code, (SELECT min(t) FROM win b WHERE b.code = 21 AND b.signal_id = a.signal_id AND b.param = a.param AND b.t >= a.t) AS w FROM win a WHERE code IN (21, 45))",
    ),
    "agg_priority_15min": sql(f"SELECT signal_id, param AS phase, {QB}, {_F.format(113)} AS early_green, {_F.format(114)} AS extended_green, {_F.format(112)} AS check_in, {_F.format(115)} AS check_out FROM win WHERE code IN (112, 113, 114, 115) GROUP BY ALL"),
    "agg_yellow_red_activation_15min": sql(
        "SELECT signal_id, phase, make_timestamp(bin) AS bin_start, count(h) FILTER (code = 8) AS yellow_activations, count(h) FILTER (code = 9) AS red_activations, coalesce(sum(d) / 1e6, 0.0) AS red_duration_sum FROM u GROUP BY signal_id, phase, bin",
        f"i AS (SELECT *, lead(t) OVER ({_PW}) AS f FROM pev WHERE code IN (1, 8, 9))",
        f"u AS (SELECT i.signal_id, i.phase, i.t // {Q} * {Q} AS bin, i.code, d.t AS h, NULL AS d FROM i JOIN dev d ON d.code = 82 AND d.signal_id = i.signal_id AND d.phase = i.phase AND d.t > i.t AND d.t < i.f WHERE i.code IN (8, 9) AND i.f IS NOT NULL UNION ALL SELECT signal_id, phase, t // {Q} * {Q}, code, NULL, CASE WHEN code = 9 THEN f - t END FROM i WHERE code IN (8, 9) AND f IS NOT NULL)",
    ),
    "agg_preemption_15min": sql(
        f"SELECT signal_id, param AS preempt_channel, {QB}, {_F.format(102)} AS request_count, {_F.format(105)} AS service_count, sum(e - t) FILTER (code = 102) / 1e6 / nullif(count(e) FILTER (code = 102), 0) AS mean_delay_seconds FROM s GROUP BY ALL",
        "s AS (SELECT a.*, (SELECT min(t) FROM win b WHERE b.code = 105 AND b.signal_id = a.signal_id AND b.param = a.param AND b.t >= a.t) AS e FROM win a WHERE code IN (102, 105))",
    ),
    "agg_signal_event_count_15min": sql(f"SELECT signal_id, {QB}, count(*) AS event_count FROM win GROUP BY ALL"),
    "agg_extract_signal_plans": sql("SELECT signal_id, make_timestamp(begin) AS effective_from, make_timestamp(finish) AS effective_to, plan_number FROM plans"),
}
