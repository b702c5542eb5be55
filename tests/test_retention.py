"""Redaction, retention and purge of all tables at once, and a change that stops half-way."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retention

SCHEMAS = {
    "contacts": "agency_id long, contact_id long, name string, email string, phone string, address string, notes string, last_contact_at timestamp, source_created_at timestamp, created_at timestamp, redacted_at timestamp",
    "interactions": "agency_id long, contact_id long, at timestamp, summary string, agent_name string",
    "import_rows": "agency_id long, row_id long, contact_id long, created_at timestamp, raw string, changes string, raw_cleared_at timestamp",
    "opportunities": "agency_id long, opportunity_id long, contact_id long, note string",
    "activities": "opportunity_id long, note string",
    "alerts": "opportunity_id long, message string",
    "audit": "agency_id long, action string, actor string, detail string",
    "sellers": "seller_id long, name string, phone string, last_seen timestamp, redacted_at timestamp",
    "listings": "listing_id long, seller_id long, status string, removed_at timestamp, redacted_at timestamp",
    "snapshots": "listing_id long, captured_at timestamp, seller_name string, seller_phone string, raw string",
}
KEYS = {"contacts": ["contact_id"], "interactions": ["contact_id"], "import_rows": ["row_id"], "opportunities": ["opportunity_id"], "activities": ["opportunity_id"], "alerts": ["opportunity_id"], "audit": ["agency_id"], "sellers": ["seller_id"], "listings": ["listing_id"], "snapshots": ["listing_id"]}
NOW = lambda: F.lit("2026-10-05 10:00:00").cast("timestamp")


@pytest.fixture()
def tables(spark):
    from datetime import datetime as d

    old, new = d(2020, 1, 1), d(2026, 10, 1)
    rows = {
        "contacts": [(1, 1, "Jan", "j@x.y", "+32", "Kerkstraat", "n", old, None, old, None), (1, 2, "An", "a@x.y", None, None, None, old, None, old, None), (2, 3, "Bo", None, None, None, None, None, None, new, None)],
        "interactions": [(1, 1, old, "said", "agent"), (1, 2, new, "said", "agent")],
        "import_rows": [(1, 10, 1, new, "raw", "ch", None), (2, 11, 3, old, "raw", "ch", None), (2, 12, 3, new, "raw", "ch", None)],
        "opportunities": [(1, 100, 1, "call Jan"), (1, 101, 2, "call An"), (2, 102, 3, "call Bo")],
        "activities": [(100, "Jan"), (101, "An"), (102, "Bo")],
        "alerts": [(100, "Jan!"), (102, "Bo!")],
        "audit": [(1, "LOGIN", "u1", "d"), (2, "LOGIN", "u2", "d")],
        "sellers": [(5, "Piet", "+32", old, None), (6, "Mia", "+33", new, None)],
        "listings": [(50, 5, "REMOVED", old, None), (51, 6, "ACTIVE", None, None)],
        "snapshots": [(50, old, "Piet", "+32", "{}"), (51, old, "Mia", "+33", "{}"), (51, new, "Mia", "+33", "{}")],
    }
    return {n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in SCHEMAS}


def by(df, key, *fields):
    return {tuple(r[k] for k in key.split()): tuple(r[f] for f in fields) for r in df.collect()}


def test_retention_clears_what_is_old(tables):
    t = retention.retain(tables, NOW())
    assert by(t["contacts"], "contact_id", "name", "phone") == {(1,): (None, None), (2,): ("An", None), (3,): ("Bo", None)}
    assert by(t["interactions"], "contact_id", "summary") == {(1,): (None,), (2,): ("said",)}
    assert by(t["import_rows"], "row_id", "raw") == {(10,): (None,), (11,): (None,), (12,): ("raw",)}
    assert by(t["opportunities"], "opportunity_id", "note") == {(100,): (None,), (101,): ("call An",), (102,): ("call Bo",)}
    assert by(t["activities"], "opportunity_id", "note")[(100,)] == (None,) and by(t["alerts"], "opportunity_id", "message") == {(100,): (retention.ERASED,), (102,): ("Bo!",)}
    assert by(t["sellers"], "seller_id", "name") == {(5,): (None,), (6,): ("Mia",)} and by(t["listings"], "listing_id", "status") == {(51,): ("ACTIVE",)}
    assert sorted(map(tuple, t["snapshots"].select("listing_id", "seller_phone", "raw").collect()), key=str) == [(51, "+33", "{}"), (51, None, None)]
    assert {n: df.columns for n, df in t.items()} == {n: df.columns for n, df in tables.items()}


def test_seller_on_request_and_days_of_zero(spark, tables):
    t = retention.redact_sellers(tables, spark.createDataFrame([(6,)], "seller_id long"), NOW())
    assert by(t["sellers"], "seller_id", "name")[(6,)] == (None,) and by(t["snapshots"], "listing_id captured_at", "seller_name", "raw").items() and {r.seller_name for r in t["snapshots"].where("listing_id = 51").collect()} == {None}
    assert by(t["listings"], "listing_id", "redacted_at")[(50,)] == (None,)
    kept = retention.retain(tables, NOW(), dict.fromkeys(retention.DAYS, 0))
    assert all(kept[n] is tables[n] for n in tables)


def test_all_tables_change_or_none(spark, tables, tmp_path, monkeypatch):
    kept = retention.Kept(spark, str(tmp_path / "kept"), KEYS, parts=4)
    assert kept.tables() == {}
    kept.change(tables)
    content = lambda: {n: sorted(map(str, df.collect())) for n, df in kept.tables().items()}
    before = content()
    assert before == {n: sorted(map(str, df.collect())) for n, df in tables.items()}
    gone = spark.createDataFrame([(2,)], "agency_id long")
    swap = retention.Kept.swap

    def stop(self, number, listed):
        raise RuntimeError("stopped half-way")

    monkeypatch.setattr(retention.Kept, "swap", stop)
    with pytest.raises(RuntimeError):
        kept.change(lambda t: retention.purge(t, gone))
    assert content() == before
    monkeypatch.setattr(retention.Kept, "swap", swap)
    written = kept.change(lambda t: retention.purge(t, gone))
    after = content()
    assert written["sellers"] == written["listings"] == [] and len(written["contacts"]) == 1  # other parts aren't written
    assert len(after["contacts"]) == 2 and len(after["alerts"]) == 1 and len(after["activities"]) == 2 and len(after["audit"]) == 2
    assert {r.agency_id: r.actor for r in kept.tables()["audit"].collect()} == {1: "u1", 2: None}
    assert kept.change(lambda t: t) == dict.fromkeys(tables, [])
    with pytest.raises(RuntimeError):
        kept.swap(kept.listed()[0], {})
