"""Left-turn studies: gaps, volumes and whether data suffice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, along, bin_of, cycle, last, previous, seconds, settled, share, timestamp
from junctura.functions.vocabulary import FORCE_OFF, GAP_OUT, GREEN, MAX_OUT, OFF, ON, PED_CALL, YELLOW
from junctura.operators.arrivals import split_failure
from junctura.sources.derived import Tables

PHASE = ["signal_id", "phase"]
HOUR = 60 * MINUTE
#: Critical gaps in seconds by opposing lanes, and the width of the marginal band.
CRITICAL_GAP_FEW, CRITICAL_GAP_MANY, MANY_LANES, MARGINAL_BAND = 4.1, 5.3, 3, 1.5
LEAST_HITS_PER_HOUR, LEAST_CYCLES = 10, 5
#: Fixed values: (type, several lanes) -> exponent, scale, threshold of the decision boundary.
BOUNDARIES = {
    ("permissive", False): (0.706, 1.0, 9519.0), ("permissive", True): (0.642, 2.0, 7974.0),
    ("permissive_protected", False): (0.500, 1.0, 4638.0), ("permissive_protected", True): (0.404, 2.0, 3782.0),
    ("protected", False): (0.425, 1.0, 3693.0), ("protected", True): (0.404, 2.0, 3782.0),
}
#: Phases that face each other.
OPPOSING = {1: 2, 2: 1, 3: 4, 4: 3, 5: 6, 6: 5, 7: 8, 8: 7}


def _gap_rows(tables: Tables) -> DataFrame:
    """The rows of the phases' greens, yellows, pedestrian calls and detectors with their cycle, its last yellow (end) and, where one closes, a gap (seconds).

    A gap opens when an OFF leaves no detector on and closes with the next ON, inside [green, end]. The number of detectors
    on never falls below 0; that clamped count is the running sum less its lowest value so far, so it
    stays a window expression. One scan and one shuffle serve all of it.
    """
    code, t = F.col("code"), F.col("t")
    rows = tables.stream((GREEN, YELLOW, PED_CALL), (ON, OFF)).withColumn("cycle", cycle(code == GREEN, along(PHASE)))
    rows = rows.withColumn("end", F.when(F.col("cycle") > 0, F.max(F.when(code == YELLOW, t)).over(Window.partitionBy(*PHASE, "cycle"))))
    c = along([*PHASE, "cycle"])
    inside = code.isin(ON, OFF) & (t <= F.col("end"))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    step = F.when(~F.col("inside"), 0).when(code == ON, 1).otherwise(-1)
    rows = rows.withColumn("sum", F.sum(step).over(c.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("on", F.col("sum") - F.least(F.lit(0), F.min("sum").over(c.rowsBetween(Window.unboundedPreceding, 0))))
    before = previous(F.when(F.col("inside"), F.struct("t", "code", "on")), c)
    opened = F.when((before["code"] == OFF) & (before["on"] == 0), before["t"])
    rows = rows.withColumn("opened", opened)
    return rows.withColumn("gap", F.when(F.col("inside") & (code == ON) & (t > F.col("opened")), seconds(t - F.col("opened")))).select(*PHASE, "t", "code", "cycle", "end", "gap")


def gaps(tables: Tables) -> DataFrame:
    """signal_id, phase, cycle, gap (seconds) of the opposing stream inside green."""
    return _gap_rows(tables).where("gap is not null").select(*PHASE, "cycle", "gap")


def left_turn_gap(tables: Tables, opposing_lanes: int | None = None, left_turn_phase: int | None = None, green_threshold: float = 0.79, red_threshold: float = 0.79) -> DataFrame:
    """Gaps of every green by size, with data quality, pedestrian, peak-hour and left-turn summaries on each row."""
    lanes = F.lit(opposing_lanes) if opposing_lanes is not None else F.coalesce("lanes", F.lit(0))
    through = tables.detectors.where("movement = 'T'").groupBy(*PHASE).agg(F.count("*").alias("lanes"))
    critical = F.when(lanes < MANY_LANES, CRITICAL_GAP_FEW).otherwise(CRITICAL_GAP_MANY)
    rows = _gap_rows(tables).join(through, PHASE, "left").withColumn("critical", critical)
    n = lambda cond: F.count(F.when(cond, 1))
    g, crit, call = F.col("gap"), F.col("critical"), F.col("code") == PED_CALL
    base = rows.groupBy(*PHASE, "cycle").agg(
        F.min(F.when(F.col("code") == GREEN, F.col("t"))).alias("green"), F.max("end").alias("end"), n(call & (F.col("t") <= F.col("end"))).alias("ped"), n(F.col("code") == ON).alias("hits"), n(call).alias("calls"),
        F.count("gap").alias("total"), n(g >= crit).alias("sufficient"), n((g >= crit - MARGINAL_BAND) & (g < crit)).alias("marginal"), n(g < crit - MARGINAL_BAND).alias("insufficient"), settled(F.avg("gap")).alias("avg"), F.max("gap").alias("max"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    phase = Window.partitionBy(*PHASE)
    base = base.withColumn("dq_total_detector_hits", F.sum(F.when(F.col("cycle") > 0, F.col("hits")).otherwise(0)).over(phase)).withColumn("ped_total_calls", F.sum("calls").over(phase))
    cycles = base.where("end is not null").select(*PHASE, "green", "end", "ped", "dq_total_detector_hits", "ped_total_calls", *(zero(c).alias(c) for c in ("total", "sufficient", "marginal", "insufficient")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg", "max")))
    hours = tables.hours
    by_phase, by_hour = Window.partitionBy(*PHASE), Window.partitionBy(*PHASE, "hour")
    sizes = ("total", "sufficient", "marginal", "insufficient")
    out = cycles.withColumn("hour", bin_of(F.col("green"), HOUR)).withColumn("peak_cycles", F.count("*").over(by_hour))
    for c in sizes:
        out = out.withColumn(f"peak_{c}_gaps", F.sum(c).over(by_hour))
    # The peak hour is the one with the most gaps, the first of equals; its figures go on every row.
    best = F.max(F.struct("peak_total_gaps", (-F.col("hour")).alias("minus"), "peak_cycles", *(f"peak_{c}_gaps" for c in sizes[1:]))).over(by_phase)
    out = out.withColumn("best", best).select(*PHASE, "green", "end", "ped", *sizes, "avg", "max", "dq_total_detector_hits", "ped_total_calls", (-F.col("best.minus")).alias("hour"), "best.peak_cycles", *(f"best.peak_{c}_gaps" for c in sizes))
    out = out.withColumn("dq_total_cycles", F.count("*").over(by_phase)).withColumn("ped_calls_during_green", F.sum("ped").over(by_phase)).withColumn("ped_cycles_with_ped", F.sum(F.when(F.col("ped") > 0, 1).otherwise(0)).over(by_phase))
    rate = F.col("dq_total_detector_hits") / F.lit(hours)
    out = out.select(
        "signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("green")).alias("cycle_start"), seconds(F.col("end") - F.col("green")).alias("green_duration"),
        F.col("total").alias("total_gaps"), F.col("sufficient").alias("sufficient_gaps"), F.col("marginal").alias("marginal_gaps"), F.col("insufficient").alias("insufficient_gaps"),
        F.col("avg").alias("avg_gap_duration"), F.col("max").alias("max_gap_duration"), F.col("ped").alias("ped_calls_in_cycle"),
        F.lit(hours).alias("dq_analysis_period_hours"), "dq_total_detector_hits", rate.alias("dq_detector_hits_per_hour"), "dq_total_cycles", (rate >= LEAST_HITS_PER_HOUR).alias("dq_sufficient_detector_data"),
        (F.col("dq_total_cycles") >= LEAST_CYCLES).alias("dq_sufficient_cycles"), ((rate >= LEAST_HITS_PER_HOUR) & (F.col("dq_total_cycles") >= LEAST_CYCLES)).alias("dq_is_valid"),
        "ped_total_calls", "ped_calls_during_green", "ped_cycles_with_ped", share(F.col("ped_cycles_with_ped"), F.col("dq_total_cycles")).alias("ped_pct_cycles_with_ped"),
        timestamp(F.col("hour")).alias("peak_hour"), "peak_cycles", "peak_total_gaps", "peak_sufficient_gaps", "peak_marginal_gaps", "peak_insufficient_gaps", share(F.col("peak_sufficient_gaps"), F.col("peak_total_gaps")).alias("peak_sufficient_pct"),
    )
    if left_turn_phase is None:
        return out
    failures = split_failure(tables, green_threshold=green_threshold, red_threshold=red_threshold).where(F.col("phase_number") == left_turn_phase)
    lt = failures.groupBy("signal_id").agg(F.lit(left_turn_phase).alias("lt_phase"), F.count("*").alias("lt_split_total_cycles"), n(F.col("is_split_failure")).alias("lt_split_failures"))
    return out.join(lt.withColumn("lt_split_failure_pct", share(F.col("lt_split_failures"), F.col("lt_split_total_cycles"))), "signal_id", "left")


def in_hours(t: Column, first: float, final: float) -> Column:
    """Whether the time of day lies in [first, final] hours, both ends included; first > final wraps over midnight."""
    second = t % (24 * HOUR)
    a, b = second >= int(first * HOUR), second <= int(final * HOUR)
    return (a & b) if first <= final else (a | b)


def weekday(t: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(timestamp(t))


def left_turn_volume(tables: Tables, approach_type: str = "permissive", days: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6), first: float = 0.0, final: float = 24.0, opposing: dict[int, int] = OPPOSING, am: tuple[int, int] = (6, 9), pm: tuple[int, int] = (15, 18)) -> DataFrame:
    """Left-turn and opposing through volumes of each approach by quarter hour, with the review figures on each row."""
    as_map = lambda pairs: F.create_map(*(F.lit(v) for pair in pairs for v in pair))
    facing, faced = as_map(opposing.items()), as_map((b, a) for a, b in opposing.items())
    left, through = F.col("movement") == "L", F.col("movement").isin("T", "TR", "TL")
    hits = tables.arrivals().where(weekday(F.col("t")).isin(*days) & in_hours(F.col("t"), first, final) & (left | through))
    # A left turn counts for its own phase, a through movement for the phase that it faces.
    hits = hits.select("signal_id", F.when(left, F.col("phase")).otherwise(F.try_element_at(faced, F.col("phase"))).alias("phase"), left.alias("left"), bin_of(F.col("t"), 15 * MINUTE).alias("bin"))
    bins = hits.groupBy("signal_id", "phase", "bin").agg(F.count(F.when(F.col("left"), 1)).alias("lt"), F.count(F.when(~F.col("left"), 1)).alias("opp"))
    lanes = tables.detectors.groupBy("signal_id", F.col("phase").alias("_opp")).agg(F.count(F.when(through, 1)).alias("lanes"))
    opp = tables.approaches.select("signal_id", F.col("phase").alias("_opp"), F.col("direction").alias("opp_direction"))
    sides = tables.approaches.withColumn("_opp", F.try_element_at(facing, F.col("phase"))).where("_opp is not null").join(opp, ["signal_id", "_opp"], "left").join(lanes, ["signal_id", "_opp"], "left")
    sides = sides.select("signal_id", "approach_id", "phase", "direction", F.coalesce("opp_direction", F.lit("Unknown")).alias("opposing_direction"), F.coalesce("lanes", F.lit(0)).alias("opposing_lanes"))
    slide = Window.partitionBy(*PHASE, "part").orderBy("bin").rangeBetween(0, HOUR - 1)
    hour = F.floor(F.col("bin") % (24 * HOUR) / HOUR)
    part = F.when((hour >= am[0]) & (hour < am[1]), "am").when((hour >= pm[0]) & (hour < pm[1]), "pm")
    whole = Window.partitionBy(*PHASE)
    bins = bins.withColumn("part", part).withColumn("volume", F.sum("lt").over(slide)).withColumn("left_turn_volume", F.sum("lt").over(whole)).withColumn("opposing_through_volume", F.sum("opp").over(whole))
    for p in ("am", "pm"):
        bins = bins.withColumn(p, F.max(F.when(F.col("part") == p, F.struct("volume", (-F.col("bin")).alias("minus")))).over(whole))
    many = F.col("opposing_lanes") > 1
    one, two = BOUNDARIES[approach_type, False], BOUNDARIES[approach_type, True]
    pick = lambda k: F.when(many, two[k]).otherwise(one[k])
    product = F.col("left_turn_volume").cast("double") * F.col("opposing_through_volume")
    boundary = pick(1) * F.col("left_turn_volume") * F.pow(F.col("opposing_through_volume").cast("double"), pick(0))
    out = bins.join(sides, PHASE).withColumn("boundary", boundary)
    return out.select(
        "signal_id", "approach_id", timestamp(F.col("bin")).alias("bin_start"), F.col("lt").alias("left_turn_volume_bin"), F.col("opp").alias("opposing_through_volume_bin"), "direction", "opposing_direction",
        "left_turn_volume", "opposing_through_volume", "opposing_lanes", product.alias("cross_product_value"), (product > F.when(many, 100_000).otherwise(50_000)).alias("cross_product_review"),
        F.col("boundary").alias("calculated_volume_boundary"), pick(2).alias("decision_boundary_threshold"), (F.col("boundary") > pick(2)).alias("decision_boundaries_review"),
        *(c for p in ("am", "pm") for c in (timestamp(-F.col(p)["minus"]).alias(f"{p}_peak_hour"), F.col(p)["volume"].alias(f"{p}_peak_left_turn_volume"))), F.lit(approach_type).alias("approach_type"),
    )


def left_turn_gap_data_check(tables: Tables, days: tuple[int, ...] = (0, 1, 2, 3, 4), least_volume: int = 60, most_gap_out: float = 0.5, most_ped: float = 0.25, am: tuple[int, int] = (6, 9), pm: tuple[int, int] = (15, 19), opposing: dict[int, int] = OPPOSING) -> DataFrame:
    """Whether an approach has the data that a gap study needs, by its morning and evening windows."""
    t = F.col("t")
    hour = F.floor(t % (24 * HOUR) / HOUR)
    part = F.when((hour >= am[0]) & (hour < am[1]), "am").when((hour >= pm[0]) & (hour < pm[1]), "pm")
    keep = lambda df: df.where(weekday(t).isin(*days)).withColumn("part", part).where("part is not null")
    facing = tables.spark.createDataFrame(list(opposing.items()), "phase int, through int")
    sides = tables.approaches.join(facing, "phase").select("signal_id", "approach_id", "phase", "through", "ped_phase")
    key = ["signal_id", "approach_id"]
    hits = keep(tables.arrivals().where("movement = 'L'"))
    bins = hits.groupBy(*key, "part", bin_of(t, 15 * MINUTE).alias("bin")).agg(F.count("*").alias("n"))
    day = Window.partitionBy(*key, "part", F.floor(F.col("bin") / (24 * HOUR)))
    run = day.orderBy("bin").rowsBetween(0, 3)
    sized = bins.withColumn("all", F.count("*").over(day)).withColumn("sum4", F.sum("n").over(run)).withColumn("n4", F.count("*").over(run)).withColumn("day_sum", F.sum("n").over(day))
    volume = F.when(F.col("all") < 4, F.floor(F.col("day_sum") * 4 / F.col("all"))).when(F.col("n4") == 4, F.col("sum4"))
    left = sized.groupBy(*key, "part").agg(F.sum("n").alias("hits"), F.max(volume).alias("peak"))
    phase = keep(tables.phase_events(GREEN, GAP_OUT, MAX_OUT, FORCE_OFF, PED_CALL))
    # Each approach meets only the events of its own phases: their roles are the build side, keyed by signal and phase.
    roles = sides.withColumn("own", F.col("phase")).withColumn("phase", F.explode(F.array_distinct(F.array("through", "own", "ped_phase"))))
    is_ = lambda role, name: (F.col("phase") == F.col(role)).alias(name)
    roles = roles.select(*PHASE, "approach_id", is_("through", "is_through"), is_("own", "is_left"), is_("ped_phase", "is_ped"))
    rows = phase.join(roles, PHASE).select(*key, "part", "t", "code", F.lit(0).alias("param"), "is_through", "is_left", "is_ped")
    through_green = F.col("is_through") & (F.col("code") == GREEN)
    call = ~F.col("is_through") & F.col("is_ped") & (F.col("code") == PED_CALL)
    rows = rows.withColumn("cycle", last(F.when(through_green, t), along([*key, "part"])))
    n = lambda cond: F.count(F.when(cond, 1))
    stats = rows.groupBy(*key, "part").agg(
        n(through_green).alias("cycles"), n(F.col("is_through") & F.col("code").isin(GAP_OUT, MAX_OUT, FORCE_OFF)).alias("terminations"), n(F.col("is_through") & (F.col("code") == GAP_OUT)).alias("gap_outs"),
        n(~F.col("is_through") & F.col("is_left") & (F.col("code") == GREEN)).alias("lt_cycles"), n(call).alias("ped_calls"), F.count_distinct(F.when(call, F.col("cycle"))).alias("with_ped"),
    )
    both = stats.join(left, [*key, "part"], "full")
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}")
    names = ("cycles", "terminations", "gap_outs", "lt_cycles", "ped_calls", "with_ped", "hits", "peak")
    wide = sides.select(*key).join(both.groupBy(*key).agg(*(pick(p, c) for p in ("am", "pm") for c in names)), key, "left")
    count = lambda p, c: F.coalesce(F.col(f"{p}_{c}"), F.lit(0))
    none = lambda c: (count("am", c) == 0) | (count("pm", c) == 0)
    rate = lambda p, c: F.when(count(p, "cycles") > 0, count(p, c) / count(p, "cycles"))
    ok = lambda c, most: F.coalesce((rate("am", c) <= most) & (rate("pm", c) <= most), F.lit(False))
    enough = F.coalesce(F.col("am_peak") >= least_volume, F.lit(False)) | F.coalesce(F.col("pm_peak") >= least_volume, F.lit(False))
    flags = {
        "insufficient_detector_event_count": none("hits"), "insufficient_cycle_aggregation": none("cycles"), "insufficient_phase_termination": none("terminations"),
        "insufficient_ped_aggregations": ~none("cycles") & (count("am", "ped_calls") == 0) & (count("pm", "ped_calls") == 0),
        "insufficient_split_fail_aggregations": none("lt_cycles") | none("hits"), "insufficient_left_turn_gap_aggregations": none("cycles") | none("hits"),
    }
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag |= f
    return wide.select(
        *key, enough.alias("left_turn_volume_ok"), ok("gap_outs", most_gap_out).alias("gap_out_ok"), ok("with_ped", most_ped).alias("ped_cycle_ok"), *(c.alias(k) for k, c in flags.items()),
        F.col("am_peak").alias("am_peak_left_turn_volume"), F.col("pm_peak").alias("pm_peak_left_turn_volume"), rate("am", "gap_outs").alias("am_gap_out_pct"), rate("pm", "gap_outs").alias("pm_gap_out_pct"),
        rate("am", "with_ped").alias("am_ped_pct"), rate("pm", "with_ped").alias("pm_ped_pct"), (enough & ok("gap_outs", most_gap_out) & ok("with_ped", most_ped) & ~any_flag).alias("overall_ready"),
    )


def left_turn_volume_report(tables: Tables) -> DataFrame:
    """The report over the derived tables, whose facing phases are 2-6 and 4-8."""
    return left_turn_volume(tables, opposing={2: 6, 6: 2, 4: 8, 8: 4})


def left_turn_gap_data_check_report(tables: Tables) -> DataFrame:
    """The report over the derived tables, whose half day ends at noon: windows 6 to 9 and 9 to 12."""
    return left_turn_gap_data_check(tables, least_volume=5, pm=(9, 12), opposing={2: 6, 6: 2, 4: 8, 8: 4})
