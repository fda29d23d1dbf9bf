"""Cycles and terminations of phases, and progress along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, SECOND, along, asof_backward, bin_of_hour, cycle, following, last, previous, seconds, settled, share, timestamp
from junctura.functions.vocabulary import FORCE_OFF, GAP_OUT, GREEN, MAX_OUT, ON, PHASE_END, RED, YELLOW
from junctura.sources.derived import Tables

PHASE = ["signal_id", "phase"]
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def _phase_rows(tables: Tables, *codes: int) -> DataFrame:
    return tables.phase_events(*codes).withColumn("param", F.lit(0))


def purdue_diagram(tables: Tables) -> DataFrame:
    """Of each green the first yellow, red and phase end before the next green; the last cycle is open."""
    w = along(PHASE)
    rows = _phase_rows(tables, GREEN, GAP_OUT, MAX_OUT, FORCE_OFF, YELLOW, RED, PHASE_END).withColumn("cycle", cycle(F.col("code") == GREEN, w)).where("cycle > 0")
    first = lambda c: F.min(F.when(F.col("code") == c, F.col("t")))
    by = F.when(first(GAP_OUT).isNotNull(), "gap_out").when(first(MAX_OUT).isNotNull(), "max_out").when(first(FORCE_OFF).isNotNull(), "force_off")
    out = rows.groupBy(*PHASE, "cycle").agg(first(GREEN).alias("green"), first(YELLOW).alias("yellow"), first(RED).alias("red"), first(PHASE_END).alias("end"), by.alias("termination_type"))
    gap = lambda a, b: seconds(F.col(b) - F.col(a))
    return out.select(
        "signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("green")).alias("green_start"), timestamp(F.col("yellow")).alias("yellow_start"), timestamp(F.col("red")).alias("red_start"), timestamp(F.col("end")).alias("cycle_end"),
        gap("green", "yellow").alias("green_duration"), gap("yellow", "red").alias("yellow_duration"), gap("red", "end").alias("red_duration"), gap("green", "end").alias("cycle_duration"), "termination_type",
    )


def split_monitor(tables: Tables) -> DataFrame:
    """Average green, yellow and total of the cycles closed by a red, with shares of terminations."""
    w = along(PHASE)
    codes = (GREEN, GAP_OUT, MAX_OUT, FORCE_OFF, YELLOW, RED)
    since = F.when(F.col("code") == GREEN, 0).when(F.col("code").isin(GAP_OUT, MAX_OUT, FORCE_OFF), F.col("code"))
    rows = _phase_rows(tables, *codes).withColumn("green", last(F.when(F.col("code") == GREEN, F.col("t")), w)).withColumn("yellow", last(F.when(F.col("code") == YELLOW, F.col("t")), w)).withColumn("ended_by", last(since, w))
    closed = rows.where((F.col("code") == RED) & F.col("green").isNotNull())
    has_yellow = F.col("yellow").isNotNull() & (F.col("yellow") >= F.col("green"))
    green, yellow, total = F.when(has_yellow, F.col("yellow") - F.col("green")), F.when(has_yellow, F.col("t") - F.col("yellow")), F.col("t") - F.col("green")
    mean = lambda c: F.coalesce(seconds(F.sum(c)) / F.count(c), F.lit(0.0))
    by = lambda c: F.count(F.when(F.col("ended_by") == c, 1)) * 100.0 / F.count("*")
    out = closed.groupBy(*PHASE).agg(F.count("*").alias("cycles"), mean(green).alias("green_time"), mean(yellow).alias("yellow_time"), mean(total).alias("total_split"), by(FORCE_OFF).alias("force_off_pct"), by(GAP_OUT).alias("gap_out_pct"), by(MAX_OUT).alias("max_out_pct"))
    return out.withColumnRenamed("phase", "phase_number").withColumn("red_clearance_time", F.greatest(F.col("total_split") - F.col("green_time") - F.col("yellow_time"), F.lit(0.0)))


def phase_termination(tables: Tables, minutes: int = 15) -> DataFrame:
    of = lambda c: F.count(F.when(F.col("code") == c, 1))
    rows = tables.phase_events(GREEN, GAP_OUT, MAX_OUT, FORCE_OFF).groupBy(*PHASE, bin_of_hour(F.col("t"), minutes).alias("bin"))
    out = rows.agg(of(GAP_OUT).alias("gap_out_count"), of(MAX_OUT).alias("max_out_count"), of(FORCE_OFF).alias("force_off_count"), of(GREEN).alias("total_cycles"))
    return out.select("signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("bin")).alias("bin_start"), "gap_out_count", "max_out_count", "force_off_count", "total_cycles")


#: One green of a ring cycle as a step of its state: the phases seen, as bits.
_BIT = "shiftleft(1L, {})"
_STEP = "if(s & {b} = 0, s | {b}, {b})"
#: The first place (from 1) where a phase comes again, 0 if none does.
_REPEAT = "array_position(transform(phases, (p, i) -> array_position(phases, p) <= i), true)"


def phase_skips(tables: Tables, minutes: int = 15, chunk_minutes: int = 60) -> DataFrame:
    """Skips by phase and bin (phases 0 to 63).

    A green of a phase that already had one in this ring cycle ends the cycle; every phase known so far
    that had none is then skipped. The phases seen depend on all greens before, but only until a cycle
    ends: from there on they follow from the greens alone. So for each chunk of a signal's time it is enough to know at which of its first
    greens a cycle can end (each phase's first one, up to the first that comes again) and what it then leaves behind. These short
    tables are composed in order for each signal, and every chunk is walked once more from what it finds. All of it are
    expressions; a signal's rows are spread over its chunks.
    """
    greens = tables.phase_events(GREEN).select("signal_id", F.floor(F.col("t") / (chunk_minutes * MINUTE)).alias("chunk"), F.struct("t", "phase").alias("green"))
    chunks = greens.groupBy("signal_id", "chunk").agg(F.array_sort(F.collect_list("green")).alias("greens"))
    chunks = chunks.withColumn("phases", F.expr("transform(greens, g -> g.phase)"))
    bit = _BIT.format("p")
    leaves = f"aggregate(slice(phases, j, size(phases)), 0L, (s, p) -> {_STEP.format(b=bit)})"
    table = chunks.withColumn("again", F.expr(_REPEAT)).select(
        "signal_id",
        F.struct(
            "chunk", F.expr(f"aggregate(phases, 0L, (s, p) -> s | {bit})").alias("mask"), (F.col("again") > 0).alias("ends"),
            F.expr(f"transform(sequence(1, cast(if(again > 0, again, size(phases)) as int)), j -> named_struct('bit', {_BIT.format('phases[j - 1]')}, 'leaves', {leaves}))").alias("heads"),
        ).alias("c"),
    )
    # A cycle ends at the first head whose phase was seen, or where the chunk repeats a phase; else the chunk's phases join those seen.
    hit = "filter(c.heads, h -> h.bit & a.seen != 0)"
    after = f"if(size({hit}) > 0, {hit}[0].leaves, if(c.ends, element_at(c.heads, -1).leaves, a.seen | c.mask))"
    empty = "cast(array() as array<struct<chunk:bigint,seen:bigint,known:bigint>>)"
    step = f"named_struct('seen', {after}, 'known', a.known | c.mask, 'out', concat(a.out, array(named_struct('chunk', c.chunk, 'seen', a.seen, 'known', a.known))))"
    order = table.groupBy("signal_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    found = order.select("signal_id", F.expr(f"inline(aggregate(cs, named_struct('seen', 0L, 'known', 0L, 'out', {empty}), (a, c) -> {step}, a -> a.out))"))

    b = _BIT.format("g.phase")
    none = "cast(array() as array<struct<t:bigint,mask:bigint>>)"
    end = f"named_struct('seen', {b}, 'known', a.known | {b}, 'out', concat(a.out, array(named_struct('t', g.t, 'mask', (a.known | {b}) & ~a.seen))))"
    walk = f"aggregate(greens, named_struct('seen', seen, 'known', known, 'out', {none}), (a, g) -> if(a.seen & {b} = 0, named_struct('seen', a.seen | {b}, 'known', a.known | {b}, 'out', a.out), {end}), a -> a.out)"
    ends = chunks.drop("phases").join(found, ["signal_id", "chunk"]).select("signal_id", F.expr(f"inline({walk})")).where("mask != 0")
    skips = ends.select("signal_id", "t", F.expr("explode(filter(sequence(0, 63), p -> mask & shiftleft(1L, p) != 0))").alias("phase_number"))
    return skips.groupBy("signal_id", "phase_number", timestamp(bin_of_hour(F.col("t"), minutes)).alias("bin_start")).agg(F.count("*").alias("skip_count"))


def time_space_diagram(tables: Tables, phase: int = 2) -> DataFrame:
    """Consecutive green, yellow and red events of the coordinated phase as intervals; the open last one is left out."""
    rows = _phase_rows(tables, GREEN, YELLOW, RED).where(F.col("phase") == phase).withColumn("finish", F.lead("t").over(along(PHASE))).where("finish is not null")
    state = F.when(F.col("code") == GREEN, "green").when(F.col("code") == YELLOW, "yellow").otherwise("red")
    return rows.select("signal_id", timestamp(F.col("t")).alias("start"), timestamp(F.col("finish")).alias("end"), state.alias("state"))


def complete_cycles(tables: Tables, phase: int = 2) -> DataFrame:
    """Green, yellow and red microseconds of cycles with all three above 0, bounded by the next green."""
    w = along(PHASE)
    rows = _phase_rows(tables, GREEN, YELLOW, RED).where(F.col("phase") == phase).withColumn("cycle", cycle(F.col("code") == GREEN, w)).where("cycle > 0")
    first = lambda c: F.min(F.when(F.col("code") == c, F.col("t")))
    out = rows.groupBy(*PHASE, "cycle").agg(first(GREEN).alias("start"), first(YELLOW).alias("y"), first(RED).alias("r"))
    out = out.withColumn("next", F.lead("start").over(along(PHASE, ("cycle",))))
    return out.select(*PHASE, "start", (F.col("y") - F.col("start")).alias("green"), (F.col("r") - F.col("y")).alias("yellow"), (F.col("next") - F.col("r")).alias("red")).where("green > 0 and yellow > 0 and red > 0")


def time_space_diagram_average(tables: Tables, phase: int = 2, hours: tuple[float, float] = (1.0, 2.0), speed: float = 30.0, spacing_feet: float = 1000.0) -> DataFrame:
    """Cycles of the median green, laid out from a plan's offset over one time-of-day window.

    The median is the middle element by green. The reference point offset - (green + yellow - split)
    is stepped back by whole cycles to the window's start, and cycles are repeated until two minutes
    past its end.
    """
    begin, end = (tables.start + int(h * 3600) * SECOND for h in hours)
    rows = complete_cycles(tables, phase)
    w = along(PHASE, ("green", "start"))
    placed = rows.withColumn("place", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(w.rowsBetween(*WHOLE)))
    middle = placed.where(F.col("place") == F.floor(F.col("n") / 2)).select("signal_id", "green", "yellow", "red")
    plan = asof_backward(middle.withColumn("t", F.lit(begin)), tables.plans.withColumnRenamed("begin", "t"), ["signal_id"], ["offset_seconds", "splits", "plan_number"]).where("plan_number is not null")
    split = F.coalesce(F.try_element_at("splits", F.lit(phase)), F.lit(0))
    length = F.col("green") + F.col("yellow") + F.col("red")
    ref = F.lit(begin) + F.col("offset_seconds") * SECOND - (F.col("green") + F.col("yellow") - split * SECOND)
    laid = plan.withColumn("length", length).withColumn("ref", ref.cast("long")).withColumn("ref", F.col("ref") - F.ceil((F.col("ref") - begin) / F.col("length")) * F.col("length"))
    steps = F.sequence(F.lit(0).cast("long"), F.ceil((F.lit(end + 2 * MINUTE) - F.col("ref")) / F.col("length")).cast("long") - 1)
    laid = laid.withColumn("k", F.explode(steps)).withColumn("at", F.col("ref") + F.col("k") * F.col("length"))
    met = laid.join(tables.route.select("signal_id", "place"), "signal_id")
    return met.select(
        "signal_id", "plan_number", F.col("k").alias("cycle_index"), timestamp(F.col("at")).alias("green_start"), timestamp(F.col("at") + F.col("green")).alias("yellow_start"),
        timestamp(F.col("at") + F.col("green") + F.col("yellow")).alias("red_start"), timestamp(F.col("at") + F.col("length")).alias("cycle_end"),
        seconds(F.col("length")).alias("cycle_seconds"), (F.col("place") * spacing_feet).alias("distance_feet"), (F.col("place") * spacing_feet / (speed * 1.467)).alias("travel_seconds"),
    )


def green_time_utilization(tables: Tables, x_minutes: int = 15) -> DataFrame:
    """Average green by bin from the window's start, against the split programmed at the bin's start less average yellow to red."""
    w = along(PHASE)
    rows = _phase_rows(tables, GREEN, YELLOW, RED)
    # A cycle is a green with the yellow that comes before another green; yellows in between pair once.
    rows = rows.withColumn("green", last(F.when(F.col("code") == GREEN, F.col("t")), w)).withColumn("yellow", last(F.when(F.col("code") == YELLOW, F.col("t")), w))
    greens = rows.where((F.col("code") == YELLOW) & F.col("green").isNotNull()).groupBy(*PHASE, "green").agg(F.min("t").alias("end"))
    yr = rows.where((F.col("code") == RED) & F.col("yellow").isNotNull()).groupBy(*PHASE, "yellow").agg(F.min("t").alias("red"))
    yr = yr.groupBy(*PHASE).agg((seconds(F.sum(F.col("red") - F.col("yellow"))) / F.count("*")).alias("yr"))
    width = x_minutes * MINUTE
    binned = greens.withColumn("x_bin", F.floor((F.col("green") - tables.start) / width)).groupBy(*PHASE, "x_bin").agg(F.count("*").alias("cycle_count"), (seconds(F.sum(F.col("end") - F.col("green"))) / F.count("*")).alias("avg_green_seconds"))
    timed = binned.withColumn("t", (tables.start + F.col("x_bin") * width).cast("long"))
    plan = asof_backward(timed, tables.plans.withColumnRenamed("begin", "t"), ["signal_id"], ["splits"])
    split = F.coalesce(F.try_element_at("splits", F.col("phase")), F.lit(0)).cast("double")
    out = plan.join(yr, PHASE, "left").withColumn("split", split).withColumn("room", F.col("split") - F.coalesce("yr", F.lit(0.0)))
    return out.select("signal_id", F.col("phase").alias("phase_number"), "x_bin", timestamp(F.col("t")).alias("bin_start"), "cycle_count", "avg_green_seconds", F.col("split").alias("programmed_split_seconds"), share(F.col("avg_green_seconds"), F.greatest(F.col("room"), F.lit(0.0))).alias("utilization_pct"))


def green_detections(tables: Tables, x_minutes: int = 15, y_seconds: int = 2) -> DataFrame:
    """Arrivals between a green and the yellow that ends it, both included, by bin of the green and seconds since it.

    A green that another one follows counts for nothing, as in `green_time_utilization`.
    """
    w, code, t = along(PHASE), F.col("code"), F.col("t")
    phase_code = F.when(code.isin(GREEN, YELLOW), code)
    rows = tables.stream((GREEN, YELLOW)).withColumn("before", previous(phase_code, w)).withColumn("after", following(phase_code, PHASE))
    rows = rows.withColumn("green", last(F.when(code == GREEN, t), w)).withColumn("ended", last(F.when((code == YELLOW) & (F.col("before") == GREEN), t), w))
    open_green = (F.col("before") == GREEN) & (F.col("after") == YELLOW)
    hits = rows.where((code == ON) & (open_green | ((F.col("before") == YELLOW) & (t == F.col("ended")))))
    x, y = F.floor((F.col("green") - tables.start) / (x_minutes * MINUTE)), F.floor((t - F.col("green")) / (y_seconds * SECOND))
    return hits.groupBy("signal_id", F.col("phase").alias("phase_number"), x.alias("x_bin"), y.alias("y_bin")).agg(F.count("*").alias("detections"))


def link_pivot(tables: Tables, longest: float = 300.0) -> DataFrame:
    """Of each green of a signal along the route, the time to the next signal's first green at or after it.

    Each link's two streams of greens go through one window, so no range join is needed.
    """
    route = tables.route.withColumn("to_signal", F.lead("signal_id").over(Window.orderBy("place")))  # a route is a short list
    links = route.where("to_signal is not null").select(F.col("signal_id").alias("from_signal"), "to_signal", "phase")
    greens = tables.phase_events(GREEN).select("signal_id", "phase", "t")
    up = greens.join(links, (greens.signal_id == links.from_signal) & (greens.phase == links.phase)).select("from_signal", "to_signal", "t", F.lit(0).alias("code"), F.lit(0).alias("param"))
    down = greens.join(links, (greens.signal_id == links.to_signal) & (greens.phase == links.phase)).select("from_signal", "to_signal", "t", F.lit(1).alias("code"), F.lit(0).alias("param"))
    met = up.unionByName(down).withColumn("next", following(F.when(F.col("code") == 1, F.col("t")), ["from_signal", "to_signal"]))
    gap = seconds(F.col("next") - F.col("t"))
    kept = met.where((F.col("code") == 0) & (gap <= longest)).withColumn("gap", gap)
    return kept.groupBy("from_signal", "to_signal").agg(settled(F.avg("gap")).alias("avg_offset"), settled(F.stddev_pop("gap")).alias("stddev_offset"), F.count("*").alias("sample_count"))


def transit_signal_priority(tables: Tables, phase: int = 2, minutes: int = 15, longest: float = 300.0) -> DataFrame:
    """Priority counts by bin and average greens that do or do not overlap a priority period.

    A period runs from the latest check-in (112 or 102) to the first 114 or 104 after it, a last open one
    for two minutes. Periods do not overlap each other, so a green needs only the first period that ends after its start.
    """
    events = tables.between(102, 104, 112, 113, 114)
    w = along(["signal_id"])
    kind = F.when(F.col("code").isin(112, 102), 1).when(F.col("code").isin(114, 104), 0)
    marks = events.where(kind.isNotNull()).withColumn("open", kind == 1)
    after = F.lead("t").over(w)
    periods = marks.withColumn("next_open", F.lead("open").over(w)).withColumn("next_t", after).where(F.col("open") & (F.col("next_open").isNull() | ~F.col("next_open"))).select("signal_id", F.col("t").alias("begin"), F.coalesce("next_t", F.col("t") + 2 * MINUTE).alias("finish"))
    phase_rows = _phase_rows(tables, GREEN, YELLOW).where(F.col("phase") == phase)
    greens = phase_rows.withColumn("yellow", following(F.when(F.col("code") == YELLOW, F.col("t")), PHASE)).where((F.col("code") == GREEN) & (F.col("yellow") > F.col("t")) & (F.col("yellow") - F.col("t") <= int(longest * SECOND)))
    one = greens.select("signal_id", F.col("t").alias("at"), F.lit(1).alias("side"), F.col("t").alias("green"), "yellow", F.lit(None).cast("long").alias("begin"))
    two = periods.select("signal_id", F.col("finish").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("green"), F.lit(None).cast("long").alias("yellow"), "begin")
    met = one.unionByName(two).withColumn("first", following(F.col("begin"), ["signal_id"], ("at", "side"))).where("side = 1")
    rows = met.select("signal_id", bin_of_hour(F.col("green"), minutes).alias("bin"), (F.col("yellow") - F.col("green")).alias("d"), F.coalesce(F.col("first") < F.col("yellow"), F.lit(False)).alias("with_tsp"))
    counts = events.where(F.col("code").isin(102, 112, 113, 114)).select("signal_id", bin_of_hour(F.col("t"), minutes).alias("bin"), "code")
    both = counts.unionByName(rows, allowMissingColumns=True)
    n = lambda *c: F.count(F.when(F.col("code").isin(*c), 1))
    mean = lambda flag: F.when(F.count(F.when(F.col("with_tsp") == flag, 1)) > 0, seconds(F.sum(F.when(F.col("with_tsp") == flag, F.col("d")))) / F.greatest(F.count(F.when(F.col("with_tsp") == flag, 1)), F.lit(1)))
    out = both.groupBy("signal_id", "bin").agg(n(112, 102).alias("tsp_requests"), n(114).alias("tsp_adjustments"), n(113).alias("tsp_early_green"), mean(True).alias("avg_green_with_tsp"), mean(False).alias("avg_green_without_tsp"))
    return out.select("signal_id", timestamp(F.col("bin")).alias("time_bin"), "tsp_requests", "tsp_adjustments", "tsp_early_green", "avg_green_with_tsp", "avg_green_without_tsp")


def ped_delay(tables: Tables) -> DataFrame:
    """Every press on a pedestrian channel waits for the next walk of its phase; phases without presses have zeros."""
    walks = tables.phase_events(21).select("signal_id", "phase", "t", "code", F.lit(0).alias("param"))
    presses = tables.arrivals(ON).select("signal_id", F.col("ped_phase").alias("phase"), "t", "code", F.col("channel").alias("param"))
    met = walks.unionByName(presses).withColumn("walk", following(F.when(F.col("code") == 21, F.col("t")), PHASE)).where((F.col("code") == ON) & F.col("walk").isNotNull())
    wait = F.col("walk") - F.col("t")
    stats = met.groupBy(*PHASE).agg(F.count("*").alias("n"), (seconds(F.sum(wait)) / F.count("*")).alias("a"), seconds(F.max(wait)).alias("m"))
    phases = tables.approaches.select("signal_id", F.col("ped_phase").alias("phase")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return phases.join(stats, PHASE, "left").select("signal_id", F.col("phase").alias("phase_number"), F.coalesce("n", F.lit(0)).alias("ped_actuations"), zero("a").alias("avg_delay_seconds"), zero("m").alias("max_delay_seconds"))

