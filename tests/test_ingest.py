"""The streamed market against one batch over everything, whatever the order in which rows come."""

import os
import random

from pyspark.sql import functions as F

from tidemark.operators.lifecycle import EVENT, lifecycle_events
from tidemark.streaming import ingest

SCHEMA = "source string, property_id long, listing_id long, at string, price long, seller_type string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("source", "property_id", "listing_id", F.col("at").cast("timestamp").alias("observed_at"), "price", "seller_type")


def made(seed, n=260):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        listing = r.randrange(14)
        rows.append((f"s{listing % 3}", None if listing == 13 else listing // 2, listing, f"2026-01-{r.randint(*((1, 8), (9, 28), (1, 8), (15, 28))[listing % 4]):02d} 00:00:00", r.choice([100_000, 90_000, 95_000, None]), r.choice(["private", "professional", "unknown"])))
    return rows + rows[:20]  # repeats


def events(df):
    return sorted(map(str, df.select(*EVENT).collect()))


def take(spark, folder, batches):
    market = ingest.Market(spark, folder, buckets=5)
    for k, rows in enumerate(batches):
        market.take(table(spark, rows), k)
    return market


def test_any_batching_gives_what_one_batch_gives(spark, tmp_path):
    rows = made(seed := 2)
    filled = [(s, listing if p is None else p, listing, *rest) for s, p, listing, *rest in rows]
    want = events(lifecycle_events(table(spark, filled)))
    assert {"LISTING_REMOVED", "RELISTED", "PRICE_DROP", "AGENCY_TO_PRIVATE"} <= {w.split("type='")[1].split("'")[0] for w in want}
    random.Random(seed).shuffle(rows)  # late rows, late runs and equal times
    market = take(spark, str(tmp_path / "m"), [rows[:150], [], rows[150:155], rows[155:]])
    assert events(market.events()) == want


def test_a_drop_that_comes_twice_on_one_day_counts_once_and_late_rows_change_history(spark, tmp_path):
    row = lambda day, price: ("s", 1, 1, f"2026-01-{day:02d} 00:00:00", price, "private")
    market = take(spark, str(tmp_path / "m"), [[row(5, 100_000)], [row(5, 90_000)], [row(5, 100_000), row(5, 90_000)], [row(3, 80_000)]])
    keys = sorted(r.dedupe_key for r in market.events().collect())
    assert keys == ["1:FSBO_DETECTED", "1:NEW_LISTING", "1:PRICE_INCREASE:80000:90000:2026-01-05", "1:PRICE_INCREASE:90000:100000:2026-01-05"]
    assert [r.occurred_at.day for r in market.events().where("type = 'NEW_LISTING'").collect()] == [3]


def test_removed_after_three_runs_and_relisted(spark, tmp_path):
    seen = lambda day, *listings: [("s", p, i, f"2026-01-{day:02d} 00:00:00", price, "private") for p, i, price in listings]
    other = (9, 90, 1)
    market = take(spark, str(tmp_path / "m"), [seen(1, (1, 10, 300_000), other), seen(2, other), seen(3, other), seen(4, other), [], seen(20, (1, 11, 280_000), other)])
    got = {r.type: r for r in market.events().where("property_id = 1 and type in ('LISTING_REMOVED', 'RELISTED')").collect()}
    assert (got["LISTING_REMOVED"].occurred_at.day, got["LISTING_REMOVED"].days_on_market) == (4, 3)
    assert (got["RELISTED"].dedupe_key, got["RELISTED"].old_price, got["RELISTED"].new_price) == ("11:RELISTED:10", 300_000, 280_000)


def test_rejects_have_a_reason_and_the_rest_goes_on(spark, tmp_path):
    rows = [("s", 1, 1, "2026-01-01 00:00:00", 5, "private"), ("s", 1, None, "2026-01-01 00:00:00", 5, "private"), ("s", 1, 2, None, 5, "private"), ("s", 1, 3, "2026-01-01 00:00:00", -5, None), ("s", 1, 4, "2026-01-01 00:00:00", 5, "robot"), (None, None, 5, "2026-01-01 00:00:00", None, None)]
    market = take(spark, str(tmp_path / "m"), [rows])
    assert sorted(r.reason for r in market.rejects().collect()) == ["no listing id", "no time", "price is not positive", "unknown seller type"]
    assert sorted(r.listing_id for r in market.events().where("type = 'NEW_LISTING'").collect()) == [1, 5]


def test_a_batch_that_fails_half_way_is_repeated(spark, tmp_path, monkeypatch):
    rows = made(3)
    parts = [rows[:100], rows[100:200], rows[200:]]
    folder, schema = str(tmp_path / "m"), table(spark, rows).schema
    failed = []
    commit = ingest.Market.commit

    def fail_once(self, batch):
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost")
        commit(self, batch)

    monkeypatch.setattr(ingest.Market, "commit", fail_once)
    for k, part in enumerate(parts):
        table(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        for attempt in range(2):
            query = ingest.start_ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), folder, str(tmp_path / "check"), buckets=5)
            try:
                query.awaitTermination(300)
                break
            except Exception:
                assert k == 1 and attempt == 0
                before = ingest.Market(spark, folder, 5).events()
                assert events(before) == events(lifecycle_events(table(spark, [(s, i if p is None else p, i, *x) for s, p, i, *x in parts[0]])))
    want = lifecycle_events(table(spark, [(s, i if p is None else p, i, *x) for s, p, i, *x in rows]))
    assert failed and events(ingest.Market(spark, folder, 5).events()) == events(want)


def test_a_small_batch_writes_little(spark, tmp_path):
    many = [(f"s{i % 5}", i // 2, i, f"2026-01-{d:02d} 00:00:00", 100_000 + d, "private") for i in range(3000) for d in (1, 2)]
    take(spark, str(tmp_path / "m"), [many, [("s0", 0, 0, "2026-01-02 00:00:00", 50_000, "private")]])

    def size(batch):
        return sum(os.path.getsize(os.path.join(d, f)) for t in ("observations", "events", "runs", "touched") for d, _, files in os.walk(tmp_path / "m" / t / f"batch={batch}") for f in files if f.endswith(".parquet"))

    assert size(1) * 5 < size(0)
