"""SQL twins of the quality, configuration and event-lake queries."""

from junctura.operators.quality import KINDS, RANGES
from junctura.plans.arrival_sql import sql
from junctura.plans.cycle_sql import END, START, Q

HOUR = 3_600_000_000
_KIND = ", ".join(f"({c}, {RANGES[k][0]}, {RANGES[k][1]})" for c, k in KINDS.items())
_V = f"kinds(code, lo, hi) AS (VALUES {_KIND})"
_TERM = (
    f"h AS (SELECT signal_id, phase, t // {HOUR} * {HOUR} AS hour, count(*) FILTER (code = 4) AS gap, count(*) FILTER (code = 5) AS mx, count(*) FILTER (code = 6) AS fo, count(*) FILTER (code IN (4, 5, 6)) AS total FROM pev WHERE code IN (1, 4, 5, 6) GROUP BY ALL)",
    "b AS (SELECT signal_id, phase, " + ", ".join(f"round(avg(CASE WHEN total = 0 THEN 0.0 ELSE {c} * 1.0 / total END), 6) AS {n}_mean, round(stddev_pop(CASE WHEN total = 0 THEN 0.0 ELSE {c} * 1.0 / total END), 6) AS {n}_sd" for n, c in (("gap", "gap"), ("max", "mx"), ("force", "fo"))) + " FROM h GROUP BY ALL)",
    f"r AS (SELECT signal_id, phase, CAST(sum(gap) AS DOUBLE) AS gap, CAST(sum(mx) AS DOUBLE) AS mx, CAST(sum(fo) AS DOUBLE) AS fo, CAST(sum(total) AS DOUBLE) AS total FROM h WHERE hour >= {END - HOUR} GROUP BY ALL)",
    "m AS (SELECT signal_id, phase, " + ", ".join(f"CASE WHEN total = 0 THEN 0.0 ELSE {c} / total END AS {n}_ratio" for n, c in (("gap", "gap"), ("max", "mx"), ("force", "fo"))) + " FROM r)",
)


def _last_hour(where: str, key: str, having: str) -> str:
    return sql(f"SELECT signal_id, {key} count(*) AS n FROM cel WHERE t BETWEEN {END - HOUR} AND {END} {where} GROUP BY ALL HAVING {having}")


SQL = {
    "quality_validation_summary": sql(
        "SELECT code, CASE WHEN param < 0 OR lo IS NULL OR NOT (param BETWEEN lo AND hi) THEN 'invalid' ELSE 'clean' END AS status, count(*) AS n FROM x LEFT JOIN kinds USING (code) GROUP BY ALL",
        _V, "x AS (SELECT CASE WHEN param = 8 THEN code + 40 ELSE code END AS code, param FROM win)",
    ),
    "quality_latest_status": sql(
        "SELECT signal_id, CASE WHEN bad THEN 'invalid' WHEN param > 6 THEN 'suspect' ELSE 'clean' END AS merged, count(*) AS n FROM x GROUP BY ALL",
        _V, "x AS (SELECT w.*, (param < 0 OR lo IS NULL OR NOT (param BETWEEN lo AND hi)) AS bad FROM win w LEFT JOIN kinds USING (code))",
    ),
    "watchdog_silent_signal": sql(f"SELECT signal_id, make_timestamp(max(t)) AS last_event FROM cel GROUP BY ALL HAVING max(t) < {END + 2 * HOUR}"),
    "watchdog_missing_data_window": sql(f"SELECT signal_id, make_timestamp(max(t)) AS last_event FROM cel GROUP BY ALL HAVING max(t) < {END + HOUR // 2}"),
    "watchdog_suppressed_alerts": sql(f"SELECT signal_id, make_timestamp(max(t)) AS last_event FROM cel WHERE signal_id <> 'SIG-001' GROUP BY ALL HAVING max(t) < {END + HOUR // 2}"),
    "watchdog_stuck_detector": _last_hour("AND code = 82", "param AS channel,", "count(*) > 8"),
    "watchdog_low_event_count": _last_hour("", "", "count(*) < 175"),
    "watchdog_stuck_ped": sql(f"SELECT signal_id, param AS phase, count(*) AS n FROM cel WHERE t BETWEEN {END - 2 * HOUR} AND {END} AND code = 45 GROUP BY ALL HAVING count(*) > 2.4"),
    "watchdog_low_hit_count": _last_hour(f"AND code = 82 AND signal_id IN (SELECT signal_id FROM cel WHERE code = 1 AND t BETWEEN {END - HOUR} AND {END})", "param AS channel,", "count(*) < 5"),
    "watchdog_phase_termination_anomaly": sql("SELECT * FROM m JOIN b USING (signal_id, phase) WHERE " + " OR ".join(f"({n}_sd > 0 AND abs({n}_ratio - {n}_mean) > 1.0 * {n}_sd)" for n in ("gap", "max", "force")), *_TERM),
    "config_approaches_as_of": sql("SELECT approach_id, signal_id, phase, CASE phase WHEN 2 THEN 35 WHEN 4 THEN 45 ELSE 30 END AS mph FROM app WHERE phase <> 6"),
    "config_signal_tree_flat": sql("SELECT signal_id, approach_id, direction, count(*) AS n_detectors, string_agg(channel, ',' ORDER BY channel) AS channels FROM det GROUP BY ALL"),
    "config_channels_for_phase": sql("SELECT signal_id, phase, string_agg(channel, ',' ORDER BY channel) AS channels FROM det GROUP BY ALL"),
    "lake_events_query": sql("SELECT signal_id, make_timestamp(t) AS event_time, code AS event_code, param AS event_param FROM win WHERE signal_id = 'SIG-001' AND code IN (1, 8, 9) AND param = 2 ORDER BY t, code, param LIMIT 10000"),
    "lake_clock_correction": sql(f"SELECT signal_id, make_timestamp(u // {Q} * {Q}) AS bin_start, count(*) AS n FROM (SELECT DISTINCT signal_id, CASE WHEN signal_id = 'SIG-002' AND t BETWEEN {START + HOUR} AND {START + 2 * HOUR} THEN t + 90000000 ELSE t END AS u, code, param FROM win) GROUP BY ALL"),
}
