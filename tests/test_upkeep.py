"""What imports, alerts and sellers leave behind, by hand."""

from pyspark.sql import functions as F

from tidemark.operators import insight, opportunities, resolution, upkeep

NOW = "2026-01-10 00:00:00"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_snapshots_and_staged_rows_are_added_once(spark, tmp_path):
    day = lambda d, *v: spark.createDataFrame([(1, f"2026-01-{d:02d} 08:00:00", x) for x in v], "listing_id long, at string, price long").select("listing_id", F.col("at").cast("timestamp").alias("observed_at"), "price")
    path = str(tmp_path / "snapshots")
    for batch in (day(1, 5), day(2, 6), day(1, 5, 7), day(1, 5, 7)):
        upkeep.write_snapshots(batch, path)
    assert rows(spark.read.parquet(path), "price") == [(5,), (6,), (7,)]
    stage = str(tmp_path / "stage")
    for batch in ([("a", 1, "x"), ("a", 1, "x")], [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("b", 1, "z")]):
        upkeep.stage_rows(spark.createDataFrame(batch, "import_id string, row_number int, raw string"), stage)
    assert rows(spark.read.parquet(stage), "import_id", "row_number", "raw") == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]


def test_outbox_reserves_once_and_tries_failures_again(spark):
    selected = spark.createDataFrame([(1, 1, "c"), (1, 1, "c"), (1, 2, None), (1, 3, "c"), (1, 4, "c")], "rule_id long, opportunity_id long, chat_id string")
    alerts = spark.createDataFrame([(1, 3, "FAILED", None), (1, 4, "SENT", None), (9, 9, "PENDING", None)], "rule_id long, opportunity_id long, status string, at timestamp")
    delivered = spark.createDataFrame([(1, 1, True), (1, 3, False), (1, 4, False)], "rule_id long, opportunity_id long, ok boolean")
    got = rows(upkeep.outbox(selected, alerts, F.lit(NOW).cast("timestamp"), delivered), "rule_id", "opportunity_id", "status")
    assert got == [(1, 1, "SENT"), (1, 2, "SUPPRESSED_DRY_RUN"), (1, 3, "FAILED"), (1, 4, "SENT"), (9, 9, "PENDING")]


def test_import_outcome_and_interactions(spark):
    staged = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True)], "row_id long, usable boolean")
    matches = spark.createDataFrame([(2, None), (3, 30), (4, 40)], "row_id long, contact_id long")
    changes = spark.createDataFrame([(30,), (30,)], "contact_id long")
    assert rows(upkeep.import_outcome(staged, matches, changes), "row_id", "outcome") == [(1, "REJECTED"), (2, "CREATED"), (3, "UPDATED"), (4, "UNCHANGED")]
    ts = lambda c: F.col(c).cast("timestamp").alias(c)
    contacts = spark.createDataFrame([(1, NOW), (2, None)], "contact_id long, last_contact_at string").select("contact_id", ts("last_contact_at"))
    calls = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2025-01-01 00:00:00"), (2, "2025-03-01 00:00:00")], "contact_id long, at string").select("contact_id", ts("at"))
    got = {r.contact_id: str(r.last_contact_at) for r in upkeep.add_interactions(contacts, calls).collect()}
    assert got == {1: NOW, 2: "2025-03-01 00:00:00"}


def test_sellers_are_found_by_phone_then_by_a_name_that_no_phone_contradicts(spark):
    sellers = spark.createDataFrame([("s1", "+321", "jan"), ("s2", None, "an"), ("s3", "+323", "an"), ("s0", "+321", "zoe")], "seller_id string, phone string, name string")
    seen = spark.createDataFrame([(1, "+321", "x"), (2, None, "an"), (3, "+329", "an"), (4, "+329", "jan"), (5, None, None)], "row_id long, phone string, name string")
    got = {r.row_id: (r.seller_id, r.is_new) for r in resolution.resolve_sellers(seen, sellers).collect()}
    assert got[1] == ("s0", False) and got[2] == ("s2", False) and got[3] == ("s2", False) and got[4][1] and got[5][1]
    links = resolution.agency_links(spark.createDataFrame([("a", "Immo Centrum BVBA", "professional"), ("b", "Nieuw Huis NV", "professional"), ("c", "Immo Centrum", "private"), ("d", "X", "professional")], "seller_id string, name string, seller_type string"), spark.createDataFrame([(7, "immo centrum")], "market_agency_id long, name_key string").select(F.col("market_agency_id").cast("string").alias("market_agency_id"), "name_key"))
    assert {r.seller_id: r.is_new for r in links.collect()} == {"a": False, "b": True}


def test_opportunities_expire(spark):
    now = F.lit(NOW).cast("timestamp")
    o = spark.createDataFrame([(1, "NEW", "2026-01-09 00:00:00"), (2, "NEW", "2026-01-11 00:00:00"), (3, "WON", "2026-01-01 00:00:00"), (4, "NEW", None)], "opportunity_id long, status string, e string").select("opportunity_id", "status", F.col("e").cast("timestamp").alias("expires_at"))
    assert {r.opportunity_id: r.status for r in opportunities.expire(o, now).collect()} == {1: "DISMISSED", 2: "NEW", 3: "WON", 4: "NEW"}
    newest = insight.latest(o, [F.desc("opportunity_id")], 2)
    assert sorted(r.opportunity_id for r in newest.collect()) == [3, 4]


def test_reasons_as_rows_and_lines(spark):
    kind = "opportunity_id long, reasons array<struct<code: string, dimension: string, points: int>>"
    scored = spark.createDataFrame([(1, [("a", "intent", 45), ("b", "timing", 30), ("c", "intent", 5)]), (2, []), (3, None)], kind)
    assert rows(opportunities.reason_rows(scored, 2), "opportunity_id", "rank", "code", "points") == [(1, 0, "a", 45), (1, 1, "b", 30)]
    lines = scored.select(opportunities.reason_lines(F.col("reasons"), {"a": "Particulier"}, 2).alias("lines")).collect()
    assert [r.lines for r in lines] == [["Particulier", "b"], [], None]


def test_runs_are_bounded(spark):
    run = spark.createDataFrame([(["w"] * 60, "e" * 900), (None, None)], "warnings array<string>, error string")
    assert [(len(r.warnings or []), len(r.error or "")) for r in insight.bounded(run).collect()] == [(50, 500), (0, 0)]
