"""Reports by name: their list, the schema of their parameters, validated runs and exports."""

from __future__ import annotations

import inspect
import types
import typing

from pyspark.sql import DataFrame

from junctura.operators import arrivals, corridor, cycles, leftturn, preemption, stored, volumes
from junctura.sources.derived import Tables
from junctura.sources.lake import export

REPORTS = {
    "approach-delay": arrivals.approach_delay, "approach-speed": volumes.approach_speed, "approach-volume": volumes.approach_volume, "arrival-on-red": arrivals.arrival_on_red,
    "arrivals-on-green": arrivals.arrivals_on_green, "bike-volume": volumes.bike_volume, "green-time-utilization": cycles.green_time_utilization, "left-turn-gap": leftturn.left_turn_gap,
    "left-turn-gap-data-check": leftturn.left_turn_gap_data_check, "left-turn-volume": leftturn.left_turn_volume, "link-pivot": cycles.link_pivot, "ped-delay": cycles.ped_delay,
    "phase-termination": cycles.phase_termination, "phase-skips": cycles.phase_skips, "preempt-detail": preemption.preempt_detail, "preempt-service": preemption.preempt_service,
    "preempt-service-request": preemption.preempt_service_request, "preemption": preemption.preemption, "purdue-diagram": cycles.purdue_diagram, "ramp-metering": volumes.ramp_metering,
    "red-light-monitor": arrivals.red_light_monitor, "split-failure": arrivals.split_failure, "split-monitor": cycles.split_monitor, "time-space-diagram": cycles.time_space_diagram,
    "time-space-diagram-average": cycles.time_space_diagram_average, "time-space-diagram-average-days": corridor.time_space_average_days, "timing-and-actuations": volumes.timing_and_actuations, "transit-signal-priority": cycles.transit_signal_priority,
    "turning-movement-counts": volumes.turning_movement_counts, "wait-time": arrivals.wait_time, "yellow-red-actuations": arrivals.yellow_red_actuations,
}

#: Those that take stored rows first, where the tables have a store of them.
STORED = {"arrivals-on-green": stored.arrivals_on_green, "purdue-diagram": stored.purdue_diagram}

_JSON = {int: "integer", float: "number", bool: "boolean", str: "string", tuple: "array", dict: "object"}


def listing() -> list[dict[str, str]]:
    return [{"name": name, "description": inspect.getdoc(report) or name.replace("-", " ")} for name, report in sorted(REPORTS.items())]


def _parameters(name: str) -> dict[str, inspect.Parameter]:
    if name not in REPORTS:
        raise KeyError(f"no report {name!r}; there are {', '.join(sorted(REPORTS))}")
    return {k: p for k, p in inspect.signature(REPORTS[name], eval_str=True).parameters.items() if k != "tables"}


def _kinds(annotation) -> tuple[type, ...]:
    if isinstance(annotation, types.UnionType):
        return tuple(k for part in typing.get_args(annotation) for k in _kinds(part))
    return (typing.get_origin(annotation) or annotation,)


def schema(name: str) -> dict:
    """JSON schema of a report's parameters."""
    fields = {}
    for key, p in _parameters(name).items():
        names = [_JSON[k] for k in _kinds(p.annotation) if k in _JSON]
        fields[key] = {"type": names[0] if len(names) == 1 else names, "default": p.default}
    return {"title": name, "type": "object", "properties": fields, "additionalProperties": False}


def run(tables: Tables, name: str, parameters: dict | None = None, signals: tuple[str, ...] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A report with checked parameters over a window (that of ``tables``, if not given), for all signals or for some; both reach the scan."""
    known, values = _parameters(name), {}
    for key, value in (parameters or {}).items():
        if key not in known:
            raise ValueError(f"{name} has no parameter {key!r}")
        kinds = _kinds(known[key].annotation)
        if tuple in kinds and isinstance(value, list):
            value = tuple(value)
        if float in kinds and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kinds) or isinstance(value, bool) and bool not in kinds:
            raise ValueError(f"{key} of {name} must be {' or '.join(k.__name__ for k in kinds)}")
        values[key] = value
    chosen = tables.over(start, end, signals or ())
    store = getattr(tables, "store", "")
    return STORED[name](chosen, store, **values) if store and name in STORED else REPORTS[name](chosen, **values)


def run_and_export(tables: Tables, name: str, path: str, kind: str = "csv", parameters: dict | None = None, **window) -> None:
    """The export of `run`, with the same signals, start and end."""
    export(run(tables, name, parameters, **window), path, kind)
