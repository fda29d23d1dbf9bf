"""SQL twins of the reads of stored cycle tables."""

from junctura.plans.aggregate_sql import HOUR, SQL as AGGREGATE
from junctura.plans.cycle_sql import END, START, Q


def _at(hours: int) -> str:
    return f"make_timestamp({START + hours * HOUR})"


def _read(table: str, column: str, more: str = "") -> str:
    return f"SELECT * FROM ({AGGREGATE[table]}) x WHERE {column} >= {_at(1)} AND {column} < {_at(5)} {more}"


_INSIDE = f">= make_timestamp({START}) AND {{0}} < make_timestamp({END})"

SQL = {
    "cycles_cycle_boundary": _read("agg_cycle_boundary", "green_start"),
    "cycles_cycle_arrival": _read("agg_cycle_detector_arrival", "arrival_time", "AND channel IN (1, 5)"),
    "cycles_cycle_summary": _read("agg_cycle_summary_15min", "bin_start"),
    "cycles_purdue_diagram": f"SELECT signal_id, phase AS phase_number, green_start, yellow_start, red_start, cycle_end, green_duration_seconds AS green_duration, yellow_duration_seconds AS yellow_duration, red_duration_seconds AS red_duration, cycle_duration_seconds AS cycle_duration, termination_type FROM ({AGGREGATE['agg_cycle_boundary']}) x WHERE green_start {_INSIDE.format('green_start')}",
    "cycles_arrivals_on_green": f"SELECT signal_id, phase AS phase_number, CAST(sum(total_arrivals) AS BIGINT) AS total_arrivals, CAST(sum(arrivals_on_green) AS BIGINT) AS arrivals_on_green, CASE WHEN sum(total_arrivals) > 0 THEN CAST(sum(arrivals_on_green) AS DOUBLE) * 100.0 / CAST(sum(total_arrivals) AS DOUBLE) ELSE 0.0 END AS aog_percentage FROM ({AGGREGATE['agg_cycle_summary_15min']}) x WHERE bin_start {_INSIDE.format('bin_start')} GROUP BY ALL",
    "cycles_phase_termination": f"SELECT signal_id, phase AS phase_number, make_timestamp(epoch_us(green_start) // {Q} * {Q}) AS bin_start, count(*) FILTER (termination_type = 'gap_out') AS gap_out_count, count(*) FILTER (termination_type = 'max_out') AS max_out_count, count(*) FILTER (termination_type = 'force_off') AS force_off_count, count(*) AS total_cycles FROM ({AGGREGATE['agg_cycle_boundary']}) x WHERE green_start {_INSIDE.format('green_start')} GROUP BY ALL",
}
