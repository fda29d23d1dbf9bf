"""SQL twins of the analytics and the left-turn reports."""

from junctura.plans.arrival_sql import sql
from junctura.plans.cycle_sql import _PW, END, START, Q

H = 12.0
_D = "d AS (SELECT signal_id, param AS channel, t, code FROM win WHERE code IN (81, 82))"
_DRIFT = (
    "l AS (SELECT signal_id, (t - lag(t) OVER (PARTITION BY signal_id ORDER BY t)) / 1e6 AS len FROM pev WHERE code = 1 AND phase = 2)",
    "m AS (SELECT signal_id, round(avg(len), 6) AS mean FROM l WHERE len IS NOT NULL GROUP BY ALL)",
    "dr AS (SELECT l.signal_id, len, mean, abs(len - mean) AS drift FROM l JOIN m USING (signal_id) WHERE len IS NOT NULL)",
)
_SKIP = ("gr AS (SELECT signal_id, phase, count(*) AS n FROM pev WHERE code = 1 GROUP BY ALL)", "sk AS (SELECT *, max(n) OVER (PARTITION BY signal_id) AS e, (max(n) OVER (PARTITION BY signal_id) - n) * 100.0 / max(n) OVER (PARTITION BY signal_id) AS r FROM gr)")
_GRADE = "CASE WHEN {0} >= 90 THEN 'Excellent' WHEN {0} >= 75 THEN 'Good' WHEN {0} >= 50 THEN 'Fair' ELSE 'Poor' END"
_FACE = "face(phase, opp) AS (VALUES (2, 6), (6, 2), (4, 8), (8, 4))"
_HOUR = 3_600_000_000

SQL = {
    "analytics_detectors_stuck": sql(
        f"SELECT signal_id, channel, make_timestamp(o) AS last_on, ({END} - o) / 1e6 AS stuck_seconds, n AS event_count FROM x WHERE (f IS NULL OR o > f) AND {END} - o >= 1800000000",
        _D, "x AS (SELECT signal_id, channel, max(t) FILTER (code = 82) AS o, max(t) FILTER (code = 81) AS f, count(*) FILTER (code = 82) AS n FROM d GROUP BY ALL)",
    ),
    "analytics_detectors_gaps": sql(
        "SELECT signal_id, channel, count(*) AS event_count, sum(g) / 1e6 / count(g) AS avg_gap_seconds, min(g) / 1e6 AS min_gap_seconds, max(g) / 1e6 AS max_gap_seconds FROM x GROUP BY ALL HAVING count(*) >= 2",
        _D, "x AS (SELECT *, t - lag(t) OVER (PARTITION BY signal_id, channel ORDER BY t) AS g FROM d WHERE code = 82)",
    ),
    "analytics_detectors_occupancy": sql(
        f"SELECT signal_id, channel, make_timestamp(b) AS bin_start, make_timestamp(b + {Q}) AS bin_end, coalesce(CAST(sum(greatest(0, least(f, b + {Q}) - greatest(t, b))) FILTER (t IS NOT NULL) AS DOUBLE), 0.0) * 100.0 / {Q} AS occupancy_pct FROM g LEFT JOIN y USING (signal_id, channel) GROUP BY ALL",
        _D, "x0 AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY signal_id, channel ORDER BY t, code), 81) AS w FROM d)",
        f"x1 AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY signal_id, channel ORDER BY t, code), {END}) AS f FROM x0 WHERE code <> w)",
        "y AS (SELECT * FROM x1 WHERE code = 82)", f"g AS (SELECT * FROM (SELECT DISTINCT signal_id, channel FROM d), (SELECT unnest(range({START}, {END}, {Q})) AS b))",
    ),
    "analytics_phases_skipped": sql("SELECT signal_id, phase, e AS expected_cycles, n AS actual_cycles, r AS skip_rate_pct FROM sk", *_SKIP),
    "analytics_phases_split_monitor": sql(
        "SELECT c.signal_id, c.phase, n AS cycle_count, coalesce(g, 0.0) AS avg_green_seconds, coalesce(y, 0.0) AS avg_yellow_seconds, CASE WHEN e > 0 THEN a * 100.0 / e ELSE 0.0 END AS gap_out_pct, CASE WHEN e > 0 THEN b * 100.0 / e ELSE 0.0 END AS max_out_pct, CASE WHEN e > 0 THEN f * 100.0 / e ELSE 0.0 END AS force_off_pct FROM c LEFT JOIN gg USING (signal_id, phase) LEFT JOIN yy USING (signal_id, phase)",
        f"s AS (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN code = 8 THEN t END IGNORE NULLS) OVER w AS y FROM pev WHERE code IN (1, 4, 5, 6, 8, 9) WINDOW w AS ({_PW} ROWS UNBOUNDED PRECEDING))",
        "g1 AS (SELECT signal_id, phase, g, min(t) AS e FROM s WHERE code = 8 AND g IS NOT NULL GROUP BY ALL)", "gg AS (SELECT signal_id, phase, sum(e - g) / 1e6 / count(*) AS g FROM g1 GROUP BY signal_id, phase)",
        "y1 AS (SELECT signal_id, phase, y, min(t) AS e FROM s WHERE code = 9 AND y IS NOT NULL GROUP BY ALL)", "yy AS (SELECT signal_id, phase, sum(e - y) / 1e6 / count(*) AS y FROM y1 GROUP BY signal_id, phase)",
        "c AS (SELECT signal_id, phase, count(*) FILTER (code = 1) AS n, count(*) FILTER (code = 4) AS a, count(*) FILTER (code = 5) AS b, count(*) FILTER (code = 6) AS f, count(*) FILTER (code IN (4, 5, 6)) AS e FROM s GROUP BY ALL HAVING count(*) FILTER (code = 1) > 0)",
    ),
    "analytics_phases_terminations": sql("SELECT signal_id, phase, count(*) FILTER (code = 1) AS total_cycles, count(*) FILTER (code = 4) AS gap_outs, count(*) FILTER (code = 5) AS max_outs, count(*) FILTER (code = 6) AS force_offs FROM pev WHERE code IN (1, 4, 5, 6) GROUP BY ALL"),
    "analytics_coordination_offset_drift": sql("SELECT signal_id, max(mean) AS expected_cycle_seconds, count(*) AS cycle_count, round(avg(drift), 6) AS avg_drift_seconds, round(max(drift), 6) AS max_drift_seconds, round(stddev_pop(drift), 6) AS drift_stddev FROM dr GROUP BY ALL", *_DRIFT),
    "analytics_coordination_patterns": sql("SELECT signal_id, make_timestamp(t) AS event_time, coalesce(lag(param) OVER w, 0) AS from_pattern, param AS to_pattern, (lead(t) OVER w - t) / 1e6 AS duration_seconds FROM win WHERE code = 131 WINDOW w AS (PARTITION BY signal_id ORDER BY t, code, param)"),
    "analytics_coordination_quality": sql("SELECT signal_id, count(*) AS total_cycles, count(*) FILTER (drift <= 2) AS cycles_within_tolerance, count(*) FILTER (drift <= 2) * 100.0 / count(*) AS quality_pct, max(mean) AS avg_cycle_seconds, round(avg(drift), 6) AS avg_offset_error FROM dr GROUP BY ALL", *_DRIFT),
    "analytics_preemptions_summary": sql(
        f"SELECT signal_id, CAST(sum(n) AS BIGINT) AS total_preemptions, CAST(sum(d) AS DOUBLE) / 1e6 / CAST(sum(n) AS DOUBLE) AS avg_duration_seconds, max(m) / 1e6 AS max_duration_seconds, CAST(sum(d) AS DOUBLE) / 1e6 AS total_preempt_time_seconds, string_agg(param || '=' || n, ',' ORDER BY param) AS by_preempt_number, CAST(sum(d) AS DOUBLE) * 100.0 / {END - START} AS pct_time_preempted FROM p GROUP BY signal_id",
        "s AS (SELECT *, lag(code) OVER w AS pc, lag(t) OVER w AS b FROM win WHERE code IN (102, 104) WINDOW w AS (PARTITION BY signal_id, param ORDER BY t, code))",
        "p AS (SELECT signal_id, param, count(*) AS n, sum(t - b) AS d, max(t - b) AS m FROM s WHERE code = 104 AND pc = 102 GROUP BY ALL)",
    ),
    "analytics_preemptions_recovery": sql(
        "SELECT signal_id, make_timestamp(b) AS preempt_end_time, make_timestamp(t) AS recovery_complete_time, (t - b) / 1e6 AS recovery_seconds FROM s WHERE code = 1 AND pc = 104",
        "s AS (SELECT *, lag(code) OVER w AS pc, lag(t) OVER w AS b FROM win WHERE code = 104 OR (code = 1 AND param = 2) WINDOW w AS (PARTITION BY signal_id ORDER BY t, code, param))",
    ),
    "analytics_health_detector": sql(
        f"SELECT *, {_GRADE.format('score')} AS grade, CASE WHEN score >= 50 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM (SELECT *, greatest(0, 100 + stuck_penalty + chatter_penalty + activity_penalty + balance_penalty) AS score FROM p)",
        _D, "x AS (SELECT signal_id, channel, count(*) FILTER (code = 82) AS o, count(*) FILTER (code = 81) AS f, max(t) FILTER (code = 82) AS lo, max(t) FILTER (code = 81) AS lf FROM d GROUP BY ALL)",
        f"p AS (SELECT signal_id, channel, CASE WHEN lo IS NOT NULL AND lf IS NULL THEN -30 WHEN lo > lf AND {END} - lo > 1800000000 THEN -30 ELSE 0 END AS stuck_penalty, CASE WHEN o / {H} > 2000 THEN -20 WHEN o / {H} > 1000 THEN -10 ELSE 0 END AS chatter_penalty, CASE WHEN o < {H} THEN -15 ELSE 0 END AS activity_penalty, CASE WHEN o > 0 AND f = 0 THEN -20 WHEN o > 0 AND (o * 1.0 / f > 1.5 OR o * 1.0 / f < 0.67) THEN -10 ELSE 0 END AS balance_penalty FROM x)",
    ),
    "analytics_health_signal": sql(
        f"SELECT *, {_GRADE.format('overall_score')} AS overall_grade FROM (SELECT *, detector_health * CAST(0.35 AS DOUBLE) + phase_health * CAST(0.25 AS DOUBLE) + coordination_health * CAST(0.2 AS DOUBLE) + communication_health * CAST(0.2 AS DOUBLE) AS overall_score FROM h)",
        _D, *_SKIP, *_DRIFT,
        "x AS (SELECT signal_id, channel, count(*) FILTER (code = 82) AS o, count(*) FILTER (code = 81) AS f FROM d GROUP BY ALL)",
        f"dh AS (SELECT signal_id, greatest(0, 100 - sum(CASE WHEN o > 0 AND f = 0 THEN 15 ELSE 0 END + CASE WHEN o / {H} > 2000 THEN 10 ELSE 0 END)) AS s FROM x GROUP BY ALL)",
        "ph AS (SELECT signal_id, greatest(0, 100 - 10 * count(*) FILTER (r > 10)) AS s FROM sk GROUP BY ALL)",
        "ch AS (SELECT signal_id, CASE WHEN count(*) FILTER (drift > 5) * 1.0 / count(*) > 0.2 THEN 80 WHEN count(*) FILTER (drift > 5) * 1.0 / count(*) > 0.1 THEN 90 ELSE 100 END AS s FROM dr GROUP BY ALL)",
        f"mh AS (SELECT signal_id, CASE WHEN count(*) / {H} < 10 THEN 50 ELSE 100 END AS s FROM win GROUP BY ALL)",
        "h AS (SELECT mh.signal_id, CAST(coalesce(dh.s, 100) AS BIGINT) AS detector_health, CAST(coalesce(ph.s, 100) AS BIGINT) AS phase_health, CAST(coalesce(ch.s, 100) AS BIGINT) AS coordination_health, CAST(mh.s AS BIGINT) AS communication_health FROM mh LEFT JOIN dh USING (signal_id) LEFT JOIN ph USING (signal_id) LEFT JOIN ch USING (signal_id))",
    ),
    "report_left_turn_gap": sql(
        "SELECT c.signal_id, c.phase AS phase_number, make_timestamp(c.green) AS cycle_start, (c.e - c.green) / 1e6 AS green_duration, c.total AS total_gaps, c.suff AS sufficient_gaps, c.marg AS marginal_gaps, c.ins AS insufficient_gaps, c.av AS avg_gap_duration, c.mx AS max_gap_duration, c.ped AS ped_calls_in_cycle, "
        "CAST(12 AS DOUBLE) AS dq_analysis_period_hours, sn.hits AS dq_total_detector_hits, sn.hits / 12.0 AS dq_detector_hits_per_hour, sm.n AS dq_total_cycles, sn.hits / 12.0 >= 10 AS dq_sufficient_detector_data, sm.n >= 5 AS dq_sufficient_cycles, sn.hits / 12.0 >= 10 AND sm.n >= 5 AS dq_is_valid, sn.calls AS ped_total_calls, sm.ped AS ped_calls_during_green, sm.wp AS ped_cycles_with_ped, sm.wp * 100.0 / sm.n AS ped_pct_cycles_with_ped, "
        "make_timestamp(pk.hour) AS peak_hour, pk.n AS peak_cycles, pk.total AS peak_total_gaps, pk.suff AS peak_sufficient_gaps, pk.marg AS peak_marginal_gaps, pk.ins AS peak_insufficient_gaps, CASE WHEN pk.total > 0 THEN pk.suff * 100.0 / pk.total ELSE 0.0 END AS peak_sufficient_pct FROM c JOIN sm USING (signal_id, phase) JOIN sn USING (signal_id, phase) JOIN pk USING (signal_id, phase)",
        "r0 AS (SELECT * FROM stm WHERE code IN (1, 8, 81, 82) UNION ALL SELECT signal_id, param, t, code, -1, NULL FROM win WHERE code = 45)",
        "r1 AS (SELECT *, sum(CASE WHEN code = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id, phase ORDER BY t, code, param ROWS UNBOUNDED PRECEDING) AS cycle FROM r0)",
        "r2 AS (SELECT *, min(CASE WHEN code = 1 THEN t END) OVER v AS green, CASE WHEN cycle > 0 THEN max(CASE WHEN code = 8 THEN t END) OVER v END AS e FROM r1 WINDOW v AS (PARTITION BY signal_id, phase, cycle))",
        "i0 AS (SELECT *, sum(CASE WHEN code = 82 THEN 1 ELSE -1 END) OVER (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param ROWS UNBOUNDED PRECEDING) AS s FROM r2 WHERE code IN (81, 82) AND cycle > 0 AND t <= e)",
        "i1 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param ROWS UNBOUNDED PRECEDING)) AS k FROM i0)",
        "i2 AS (SELECT *, CASE WHEN lag(code) OVER w = 81 AND lag(k) OVER w = 0 THEN (t - lag(t) OVER w) / 1e6 END AS gap FROM i1 WINDOW w AS (PARTITION BY signal_id, phase, cycle ORDER BY t, code, param))",
        "ga AS (SELECT signal_id, phase, cycle, count(*) AS total, count(*) FILTER (gap >= 4.1) AS suff, count(*) FILTER (gap >= 4.1 - 1.5 AND gap < 4.1) AS marg, count(*) FILTER (gap < 4.1 - 1.5) AS ins, round(avg(gap), 6) AS av, max(gap) AS mx FROM i2 WHERE code = 82 AND gap > 0 GROUP BY ALL)",
        "b AS (SELECT signal_id, phase, cycle, min(green) AS green, max(e) AS e, count(*) FILTER (code = 45 AND t <= e) AS ped, count(*) FILTER (code = 82) AS hits, count(*) FILTER (code = 45) AS calls FROM r2 GROUP BY signal_id, phase, cycle)",
        "c AS (SELECT b.signal_id, b.phase, b.cycle, b.green, b.e, b.ped, coalesce(total, 0) AS total, coalesce(suff, 0) AS suff, coalesce(marg, 0) AS marg, coalesce(ins, 0) AS ins, coalesce(av, 0.0) AS av, coalesce(mx, 0.0) AS mx FROM b LEFT JOIN ga USING (signal_id, phase, cycle) WHERE b.e IS NOT NULL)",
        "sm AS (SELECT signal_id, phase, count(*) AS n, CAST(sum(ped) AS BIGINT) AS ped, count(*) FILTER (ped > 0) AS wp FROM c GROUP BY ALL)",
        "sn AS (SELECT signal_id, phase, CAST(sum(CASE WHEN cycle > 0 THEN hits ELSE 0 END) AS BIGINT) AS hits, CAST(sum(calls) AS BIGINT) AS calls FROM b GROUP BY ALL)",
        f"ph0 AS (SELECT signal_id, phase, green // {_HOUR} * {_HOUR} AS hour, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, CAST(sum(suff) AS BIGINT) AS suff, CAST(sum(marg) AS BIGINT) AS marg, CAST(sum(ins) AS BIGINT) AS ins FROM c GROUP BY ALL)",
        "pk AS (SELECT * FROM ph0 QUALIFY row_number() OVER (PARTITION BY signal_id, phase ORDER BY total DESC, hour) = 1)",
    ),
    "report_left_turn_volume": sql(
        "SELECT b.signal_id, b.approach_id, make_timestamp(b.bin) AS bin_start, b.lt AS left_turn_volume_bin, b.opp AS opposing_through_volume_bin, s.direction, s.od AS opposing_direction, tt.lt AS left_turn_volume, tt.opp AS opposing_through_volume, s.lanes AS opposing_lanes, "
        "CAST(tt.lt AS DOUBLE) * tt.opp AS cross_product_value, CAST(tt.lt AS DOUBLE) * tt.opp > CASE WHEN s.lanes > 1 THEN 100000 ELSE 50000 END AS cross_product_review, bd AS calculated_volume_boundary, CAST(CASE WHEN s.lanes > 1 THEN 7974 ELSE 9519 END AS DOUBLE) AS decision_boundary_threshold, bd > CASE WHEN s.lanes > 1 THEN 7974.0 ELSE 9519.0 END AS decision_boundaries_review, "
        "make_timestamp(am.bin) AS am_peak_hour, am.v AS am_peak_left_turn_volume, make_timestamp(pm.bin) AS pm_peak_hour, pm.v AS pm_peak_left_turn_volume, 'permissive' AS approach_type FROM b JOIN s USING (signal_id, approach_id) JOIN tt USING (signal_id, approach_id) LEFT JOIN am USING (signal_id, approach_id) LEFT JOIN pm USING (signal_id, approach_id)",
        _FACE,
        "s AS (SELECT a.signal_id, a.approach_id, a.phase, f.opp AS op, a.direction, o.direction AS od, (SELECT count(*) FROM det WHERE det.signal_id = a.signal_id AND det.phase = f.opp AND movement = 'T') AS lanes FROM app a JOIN face f USING (phase) JOIN app o ON o.signal_id = a.signal_id AND o.phase = f.opp)",
        f"h AS (SELECT *, t // {Q} * {Q} AS bin FROM dev WHERE code = 82)",
        "b AS (SELECT s.signal_id, s.approach_id, bin, count(*) FILTER (h.phase = s.phase AND movement = 'L') AS lt, count(*) FILTER (h.phase = s.op AND movement = 'T') AS opp FROM h JOIN s ON s.signal_id = h.signal_id AND ((h.phase = s.phase AND movement = 'L') OR (h.phase = s.op AND movement = 'T')) GROUP BY ALL)",
        "tt AS (SELECT q.*, s.lanes, CASE WHEN lanes > 1 THEN 2.0 * lt * pow(opp, 0.642) ELSE 1.0 * lt * pow(opp, 0.706) END AS bd FROM (SELECT signal_id, approach_id, CAST(sum(lt) AS BIGINT) AS lt, CAST(sum(opp) AS BIGINT) AS opp FROM b GROUP BY ALL) q JOIN s USING (signal_id, approach_id))",
        f"w AS (SELECT *, (bin % {24 * _HOUR}) // {_HOUR} AS hr FROM b)",
        f"am0 AS (SELECT signal_id, approach_id, bin, CAST(sum(lt) OVER (PARTITION BY signal_id, approach_id ORDER BY bin RANGE BETWEEN CURRENT ROW AND {_HOUR - 1} FOLLOWING) AS BIGINT) AS v FROM w WHERE hr >= 6 AND hr < 9)",
        "am AS (SELECT * FROM am0 QUALIFY row_number() OVER (PARTITION BY signal_id, approach_id ORDER BY v DESC, bin) = 1)",
        f"pm0 AS (SELECT signal_id, approach_id, bin, CAST(sum(lt) OVER (PARTITION BY signal_id, approach_id ORDER BY bin RANGE BETWEEN CURRENT ROW AND {_HOUR - 1} FOLLOWING) AS BIGINT) AS v FROM w WHERE hr >= 15 AND hr < 18)",
        "pm AS (SELECT * FROM pm0 QUALIFY row_number() OVER (PARTITION BY signal_id, approach_id ORDER BY v DESC, bin) = 1)",
    ),
    "report_left_turn_gap_data_check": sql(
        "SELECT signal_id, approach_id, coalesce(ap >= 5, false) OR coalesce(pp >= 5, false) AS left_turn_volume_ok, coalesce(agp <= 0.5 AND pgp <= 0.5, false) AS gap_out_ok, coalesce(apd <= 0.25 AND ppd <= 0.25, false) AS ped_cycle_ok, nh AS insufficient_detector_event_count, nc AS insufficient_cycle_aggregation, nt AS insufficient_phase_termination, np AS insufficient_ped_aggregations, nl OR nh AS insufficient_split_fail_aggregations, nc OR nh AS insufficient_left_turn_gap_aggregations, ap AS am_peak_left_turn_volume, pp AS pm_peak_left_turn_volume, agp AS am_gap_out_pct, pgp AS pm_gap_out_pct, apd AS am_ped_pct, ppd AS pm_ped_pct, "
        "(coalesce(ap >= 5, false) OR coalesce(pp >= 5, false)) AND coalesce(agp <= 0.5 AND pgp <= 0.5, false) AND coalesce(apd <= 0.25 AND ppd <= 0.25, false) AND NOT (nh OR nc OR nt OR np OR nl) AS overall_ready FROM z",
        _FACE,
        f"ev AS (SELECT *, CASE WHEN (t % {24 * _HOUR}) // {_HOUR} IN (6, 7, 8) THEN 'am' WHEN (t % {24 * _HOUR}) // {_HOUR} IN (9, 10, 11) THEN 'pm' END AS part FROM win WHERE isodow(make_timestamp(t)) <= 5)",
        f"lb AS (SELECT d.signal_id, d.approach_id, part, ev.t // {Q} * {Q} AS bin, count(*) AS n FROM ev JOIN det d ON d.signal_id = ev.signal_id AND d.channel = ev.param AND d.movement = 'L' WHERE ev.code = 82 AND part IS NOT NULL GROUP BY ALL)",
        f"lw AS (SELECT *, count(*) OVER dd AS al, sum(n) OVER dd AS ds, sum(n) OVER r AS s4, count(*) OVER r AS n4 FROM lb WINDOW dd AS (PARTITION BY signal_id, approach_id, part, bin // {24 * _HOUR}), r AS (PARTITION BY signal_id, approach_id, part, bin // {24 * _HOUR} ORDER BY bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))",
        "lp AS (SELECT signal_id, approach_id, part, CAST(sum(n) AS BIGINT) AS hits, CAST(max(CASE WHEN al < 4 THEN ds * 4 // al WHEN n4 = 4 THEN s4 END) AS BIGINT) AS peak FROM lw GROUP BY ALL)",
        "pe AS (SELECT a.signal_id, a.approach_id, part, ev.t, ev.code, ev.param = f.opp AS th, ev.param = a.phase AS lf, max(CASE WHEN ev.param = f.opp AND code = 1 THEN ev.t END) OVER (PARTITION BY a.signal_id, a.approach_id, part ORDER BY ev.t, code ROWS UNBOUNDED PRECEDING) AS cy FROM ev JOIN app a ON a.signal_id = ev.signal_id JOIN face f ON f.phase = a.phase WHERE ev.code IN (1, 4, 5, 6, 45) AND part IS NOT NULL AND (ev.param = f.opp OR ev.param = a.phase))",
        "st AS (SELECT signal_id, approach_id, part, count(*) FILTER (th AND code = 1) AS c, count(*) FILTER (th AND code IN (4, 5, 6)) AS tm, count(*) FILTER (th AND code = 4) AS g, count(*) FILTER (NOT th AND lf AND code = 1) AS l, count(*) FILTER (NOT th AND lf AND code = 45) AS p, count(DISTINCT cy) FILTER (NOT th AND lf AND code = 45) AS wp FROM pe GROUP BY ALL)",
        "j AS (SELECT app.signal_id, app.approach_id, a.c AS ac, p.c AS pc, a.tm AS atm, p.tm AS ptm, a.g AS ag, p.g AS pg, a.l AS al, p.l AS pl, a.p AS apc, p.p AS ppc, a.wp AS aw, p.wp AS pw, la.hits AS ah, lq.hits AS phh, la.peak AS ap, lq.peak AS pp FROM app LEFT JOIN st a ON a.signal_id = app.signal_id AND a.approach_id = app.approach_id AND a.part = 'am' LEFT JOIN st p ON p.signal_id = app.signal_id AND p.approach_id = app.approach_id AND p.part = 'pm' LEFT JOIN lp la ON la.signal_id = app.signal_id AND la.approach_id = app.approach_id AND la.part = 'am' LEFT JOIN lp lq ON lq.signal_id = app.signal_id AND lq.approach_id = app.approach_id AND lq.part = 'pm')",
        "z AS (SELECT signal_id, approach_id, ap, pp, coalesce(ah, 0) = 0 OR coalesce(phh, 0) = 0 AS nh, coalesce(ac, 0) = 0 OR coalesce(pc, 0) = 0 AS nc, coalesce(atm, 0) = 0 OR coalesce(ptm, 0) = 0 AS nt, NOT (coalesce(ac, 0) = 0 OR coalesce(pc, 0) = 0) AND coalesce(apc, 0) = 0 AND coalesce(ppc, 0) = 0 AS np, coalesce(al, 0) = 0 OR coalesce(pl, 0) = 0 AS nl, CASE WHEN ac > 0 THEN ag * 1.0 / ac END AS agp, CASE WHEN pc > 0 THEN pg * 1.0 / pc END AS pgp, CASE WHEN ac > 0 THEN aw * 1.0 / ac END AS apd, CASE WHEN pc > 0 THEN pw * 1.0 / pc END AS ppd FROM j)",
    ),
}
