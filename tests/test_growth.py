"""What is shuffled, and in how many tasks work is done, on tables that a large one's faults show in."""

from pyspark.sql import functions as F

from tidemark.operators import lifecycle, market, normalization, resolution


def nodes(plan):
    """All operators of an executed plan, stages of adaptive execution opened."""
    name, inner = plan.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        inner = [plan.executedPlan()]
    elif "QueryStage" in name:
        inner = [plan.plan()]
    else:
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(n for p in inner for n in nodes(p))]


def shuffled_rows(df):
    df.collect()
    return sum(n.metrics().apply("shuffleRecordsWritten").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange" and n.metrics().contains("shuffleRecordsWritten"))


def test_crm_matches_pairs_grow_with_evidence_not_with_signals(spark):
    key = F.col("id")
    none = F.lit(None).cast("string")
    market = spark.range(600).select(key.alias("market_id"), F.concat(F.lit("a"), key % 3).alias("match_key"), F.lit("+321").alias("phone"), none.alias("email"), none.alias("name"), F.lit("9000").alias("postal_code"))
    contacts = spark.range(60).select(key.alias("contact_id"), (key % 2).alias("agency_id"), F.concat(F.lit("a"), key % 3).alias("address_key"), F.array().cast("array<string>").alias("owned_keys"), F.lit("+321").alias("phone"), none.alias("email"), none.alias("name"), F.lit("9000").alias("postal_code"))
    df = resolution.crm_matches(market, contacts)
    got = {(r["market_id"], r["agency_id"], r["contact_id"], r["confidence"]) for r in df.collect()}
    assert got == {(m, a, next(c for c in range(60) if c % 2 == a and c % 3 == m % 3), 0.9) for m in range(600) for a in range(2)}
    assert shuffled_rows(df) < 5000  # pairs of signals and contacts would be 36,000 at least


def test_property_candidates_shuffle_arrays_not_pairs(spark):
    key = F.col("id")
    none = F.lit(None).cast("string")
    listings = spark.range(400).select(key.alias("listing_id"), none.alias("match_key"), F.lit("9000").alias("postal_code"), F.lit("house").alias("property_type"), F.lit("+321").alias("phone"))
    properties = spark.range(200).select(key.alias("property_id"), none.alias("match_key"), F.lit("9000").alias("postal_code"), F.when(key >= 190, "house").otherwise("land").alias("property_type"), F.array(F.lit("+321")).alias("phones"))
    df = resolution.property_candidates(listings, properties)
    want = {(listing, p, 2) for listing in range(400) for p in range(190, 200)} | {(listing, p, 3) for listing in range(400) for p in range(15)}
    assert {tuple(r) for r in df.collect()} == want
    assert shuffled_rows(df) < 6000  # pairs would be 24,000


def test_normalisation_of_one_file_is_dealt_over_tasks(spark, tmp_path):
    fields = ("title", "description", "price", "currency", "listing_type", "property_type", "address", "postal_code", "city", "province", "bedrooms", "surface", "seller_name", "seller_phone", "seller_type_hint")
    raw = spark.range(200).select(F.col("id").alias("listing_id"), *(F.lit(None).cast("string").alias(f) for f in fields)).withColumn("title", F.lit("Huis te koop"))
    raw.coalesce(1).write.parquet(str(tmp_path / "raw"))
    out = normalization.normalize_listings(spark.read.parquet(str(tmp_path / "raw"))).select("listing_id", "property_type", F.spark_partition_id().alias("task"))
    rows = out.collect()
    assert sorted((r[0], r[1]) for r in rows) == [(i, "house") for i in range(200)]
    assert len({r["task"] for r in rows}) > spark.sparkContext.defaultParallelism


def observed(spark):
    """300 listings of 150 properties, seen 20 times each with gaps."""
    i = F.col("id")
    at = F.add_months(F.lit("2020-01-01").cast("date"), (F.floor(i / 300) * 2 + F.when(i / 300 >= 10, 7).otherwise(0)).cast("int")).cast("timestamp")
    return spark.range(6000).select((i % 4).alias("source"), F.floor(i % 300 / 2).alias("property_id"), (i % 300).alias("listing_id"), at.alias("observed_at"), (100_000 + i * 7919 % 50_000).alias("price"), F.element_at(F.array(*map(F.lit, ("private", "professional", "unknown"))), (i % 7 % 3 + 1).cast("int")).alias("seller_type"))


def test_lifecycle_shuffles_observations_once(spark, tmp_path):
    observed(spark).write.parquet(str(tmp_path / "seen"))
    df = lifecycle.lifecycle_events(spark.read.parquet(str(tmp_path / "seen")))
    assert shuffled_rows(df) < 2 * 6000 + 5000


def test_lives_are_the_state_and_the_greatest_keys(spark):
    rows = observed(spark)
    one = market.lives(lifecycle.seen_with_runs(rows), ("price", "seller_type", "drop_count"), tie=lifecycle.TIE, more=lifecycle.life_kinds(), elsewhere={"RELISTED": F.col("next.listing_id")})
    got = {tuple(r) for r in one.select(F.explode("events").alias("e")).select("e.*").collect()}
    want = lifecycle.lifecycle_events(rows).groupBy("listing_id", "type").agg(F.max("dedupe_key").alias("dedupe_key"))
    assert got == {(r["listing_id"], r["type"], r["dedupe_key"]) for r in want.collect()}
    state = market.listing_state(rows, tie=lifecycle.TIE).select("listing_id", "price", "seller_type", "drop_count")
    assert {tuple(r) for r in one.select(*state.columns).collect()} == {tuple(r) for r in state.collect()}
