"""Named queries over a data folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from junctura.operators import aggregates, analytics, arrivals, config, corridor, cycles, leftturn, listings, preemption, quality, scans, volumes
from junctura.plans import aggregate_sql, analytics_sql, arrival_sql, cycle_sql, listing_sql, quality_sql, scan_sql
from junctura.session import shipping
from junctura.sources import lake
from junctura.sources.derived import Tables

Query = Callable[[SparkSession, str], DataFrame]

REPORTS = (
    volumes.approach_volume, volumes.turning_movement_counts, volumes.bike_volume, volumes.approach_speed, volumes.timing_and_actuations, volumes.ramp_metering,
    arrivals.approach_delay, arrivals.arrival_on_red, arrivals.arrivals_on_green, arrivals.yellow_red_actuations, arrivals.red_light_monitor, arrivals.wait_time, arrivals.split_failure,
    cycles.purdue_diagram, cycles.split_monitor, cycles.phase_termination, cycles.phase_skips, cycles.time_space_diagram, cycles.time_space_diagram_average,
    cycles.green_time_utilization, cycles.link_pivot, cycles.transit_signal_priority, cycles.ped_delay, corridor.time_space_average_week,
    preemption.preempt_service, preemption.preempt_service_request, preemption.preemption, preemption.preempt_detail,
    leftturn.left_turn_gap, leftturn.left_turn_volume_report, leftturn.left_turn_gap_data_check_report,
)


def _over_tables(operator: Callable) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return operator(Tables(spark, folder))

    return shipping(query)


def queries() -> dict[str, Query]:
    found = {f"report_{r.__name__.removesuffix('_report')}": r for r in REPORTS} | {f"analytics_{a.__name__}": a for a in analytics.ALL} | {f"agg_{a.__name__}": a for a in aggregates.ALL}
    found |= {f"watchdog_{c.__name__}": c for c in (*quality.CHECKS, quality.suppressed_alerts)}
    found |= {"quality_validation_summary": quality.validation_summary, "quality_latest_status": quality.latest_status}
    found |= {f"config_{c.__name__}": c for c in (config.approaches_as_of, config.signal_tree_flat, config.channels_for_phase)}
    found |= {f"config_{c.__name__.removesuffix('_query')}": c for c in listings.ALL}
    found |= {f"cycles_{c.__name__}": c for c in (*scans.ALL, cycles.green_detections)}
    found |= {f"lake_{c.__name__}": c for c in (lake.events_query, lake.clock_correction)}
    return {name: _over_tables(operator) for name, operator in found.items()}


def oracle_sql() -> dict[str, str]:
    return arrival_sql.SQL | cycle_sql.SQL | analytics_sql.SQL | aggregate_sql.SQL | quality_sql.SQL | scan_sql.SQL | listing_sql.SQL
