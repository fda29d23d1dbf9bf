"""Listings on small tables with results known by hand."""

from datetime import datetime

import pytest

from junctura.operators import listings
from junctura.sources.derived import START, Tables

T = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    made = Tables(spark, "")
    made.sites = spark.createDataFrame([("A", "First", "N", "C1", "J1", True), ("B", "Second", "N", "C2", "J1", False), ("C", "Third", "S", "C1", None, True)], "signal_id string, primary_street string, region_id string, corridor_id string, jurisdiction_id string, enabled boolean")
    changes = [(k, "A", T.replace(hour=k // 2), "u", "UPDATE", '{"mph": 30, "note": null}', '{"mph": %d}' % (30 + k % 2)) for k in range(12)]
    changes += [(90, "B", T, None, "INSERT", None, '{"mph": 25, "note": "x"}'), (91, "B", T, "u", "DELETE", '{"mph": 25}', None), (92, "gone", T, "u", "INSERT", None, "{}")]
    made.site_audit = spark.createDataFrame(changes, "audit_id long, signal_id string, changed_at timestamp_ntz, changed_by string, operation string, old_values string, new_values string")
    made.checkpoints = spark.createDataFrame(
        [("controller", "A", "ftp_pull", T.replace(hour=11, minute=30), 10, 0), ("controller", "A", "http_pull", T.replace(hour=10), 5, 0), ("sensor", "A", "ftp_pull", T.replace(hour=13), 1, 0), ("controller", "B", "ftp_pull", None, 0, 0), ("controller", "C", "ftp_pull", None, 0, 3)],
        "device_type string, device_id string, method string, last_event_timestamp timestamp_ntz, events_ingested long, consecutive_errors long",
    )
    return made


@pytest.mark.parametrize(("where", "want"), [
    ({}, "AC"), ({"enabled_only": False}, "ABC"), ({"region_id": "N"}, "A"), ({"region_id": "N", "enabled_only": False}, "AB"),
    ({"corridor_id": "C1", "jurisdiction_id": "J1"}, "A"), ({"jurisdiction_id": "none"}, ""), ({"region_id": ""}, ""),
])
def test_signal_list(tables, where, want):
    assert sorted(r.signal_id for r in listings.signal_list(tables, **where).collect()) == list(want)


def test_pages_of_one_history(tables):
    ids = lambda *page: [r.audit_id for r in listings.audit_page(tables, "A", *page).collect()]
    assert ids() == [*range(11, -1, -1)] and ids(0, 3) == [11, 10, 9] and ids(10, 5) == [1, 0] and ids(12, 5) == []
    assert not listings.audit_page(tables, "gone").collect() and not listings.audit_page(tables, "none").collect()


def test_pages_of_all_histories(tables):
    pages = listings.audit_pages(tables, 1, 2)
    assert sorted((r.signal_id, r.place, r.audit_id) for r in pages.collect()) == [("A", 2, 10), ("A", 3, 9), ("B", 2, 90)]
    assert {r.signal_id for r in listings.audit_pages(tables, 0, 1, corridor_id="C2").collect()} == {"B"}
    assert "WindowGroupLimit" in pages._jdf.queryExecution().executedPlan().toString()  # each task keeps a page


def test_changed_fields(tables):
    rows = listings.changed_fields(tables.site_audit, "mph int, note string").collect()
    assert sorted((r.audit_id, r.field, r.old, r.new) for r in rows if r.audit_id >= 90) == [(90, "mph", None, "25"), (90, "note", None, "x"), (91, "mph", "25", None)]
    assert sorted((r.audit_id, r.old, r.new) for r in rows if r.audit_id < 90) == [(k, "30", "31") for k in range(1, 12, 2)]


def test_checkpoints(tables):
    keys = lambda **where: sorted((r.device_type, r.device_id, r.method) for r in listings.checkpoint_list(tables, **where).collect())
    assert len(keys()) == 5 and keys(device_type="controller", device_id="A") == [("controller", "A", "ftp_pull"), ("controller", "A", "http_pull")]
    assert keys(method="http_pull") == [("controller", "A", "http_pull")]
    health = {(r.device_id, r.device_type, r.method): r.state for r in listings.checkpoint_health(tables, START + 12 * 3_600_000_000).collect()}
    assert health == {("A", "controller", "ftp_pull"): "ok", ("A", "controller", "http_pull"): "stale", ("A", "sensor", "ftp_pull"): "ahead", ("B", "controller", "ftp_pull"): "stale", ("C", "controller", "ftp_pull"): "erring"}
