"""Event codes of the controller log (fixed values) and the names made from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

GREEN, GAP_OUT, MAX_OUT, FORCE_OFF, GREEN_END, YELLOW, RED, PHASE_END = 1, 4, 5, 6, 7, 8, 9, 10
WALK, PED_CLEARANCE, DONT_WALK, PED_CALL = 21, 22, 23, 45
OFF, ON = 81, 82
PREEMPT_CALL, PREEMPT_OFF, PREEMPT_ENTRY = 102, 104, 105
TSP_CHECK_IN, TSP_EARLY_GREEN, TSP_EXTENDED, TSP_CHECK_OUT = 112, 113, 114, 115
PATTERN, CYCLE_LENGTH, OFFSET, FIRST_SPLIT, LAST_SPLIT = 131, 132, 133, 134, 149

#: Event names.
NAMES = {
    1: "Phase Green", 4: "Gap Out", 5: "Max Out", 6: "Force Off", 7: "Green Termination", 8: "Yellow Clearance",
    9: "Red Clearance", 10: "Phase End", 21: "Ped Walk", 22: "Ped Clearance", 23: "Don't Walk", 45: "Ped Call",
    81: "Detector Off", 82: "Detector On", 102: "Preempt Call Input On", 104: "Preempt Call Input Off",
    105: "Preempt Entry Started", 112: "TSP Check In", 113: "TSP Early Green", 114: "TSP Extended Green", 115: "TSP Check Out",
}
DIRECTIONS = {1: "NB", 2: "SB", 3: "EB", 4: "WB"}


def named(code: Column, names: dict[int, str] = NAMES) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    return F.coalesce(F.try_element_at(known, code), F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))
