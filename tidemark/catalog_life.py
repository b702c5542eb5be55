"""Queries over a listing's life: all its events, removal and relisting among them, and what they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import EVENTS_SQL, ORACLE, days_sql, query
from tidemark.catalog_flow import people, place_of, territory_table
from tidemark.operators import flow, lifecycle, market
from tidemark.operators.upkeep import settled
from tidemark.plans import analogue as A

#: Sources look once a month: a listing's observations of a month are one run's.
MONTHS_SQL = f"""{A.OBSERVATIONS_SQL}, o AS (SELECT DISTINCT listing_id % 4 AS source, listing_id // 3 AS property_id, listing_id, date_trunc('month', observed_at)::TIMESTAMP AS observed_at, price, seller_type FROM obs),
    runs AS (SELECT source, observed_at AS run_at, row_number() OVER (PARTITION BY source ORDER BY observed_at) AS i, count(*) OVER (PARTITION BY source) AS last FROM (SELECT DISTINCT source, observed_at FROM o)),
    h AS (SELECT o.*, runs.i, runs.last, row_number() OVER w AS n, lag(price) OVER w AS old_price, lag(seller_type) OVER w AS old_type, lag(observed_at) OVER w AS prev, min(observed_at) OVER w AS first_seen, lead(i) OVER w AS next_i FROM o JOIN runs ON runs.source = o.source AND run_at = observed_at WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, price, seller_type)), """
LIFE_SQL = (
    MONTHS_SQL
    + EVENTS_SQL[EVENTS_SQL.index("f AS (") :].replace("observed_at, l_orderkey, l_linenumber", "observed_at, price, seller_type")
    + f""", born AS (SELECT listing_id, property_id, min(observed_at) AS b FROM o GROUP BY 1, 2),
    rem AS (SELECT x.*, r.run_at AS gone_at FROM (SELECT *, coalesce(next_i, last + 1) - i - 1 AS gap FROM g) x JOIN runs r ON r.source = x.source AND r.i = x.i + 3 WHERE gap >= 3 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY n) = 1),
    nw AS (SELECT listing_id, property_id, observed_at AS t, price AS np, seller_type, drops, lag(listing_id) OVER (PARTITION BY property_id ORDER BY observed_at, listing_id) AS before_id FROM g WHERE n = 1),
    pv AS (SELECT nw.*, g.observed_at AS u, g.price AS op, g.i AS pi, g.source AS ps FROM nw JOIN g ON g.listing_id = before_id AND g.observed_at < t QUALIFY row_number() OVER (PARTITION BY nw.listing_id ORDER BY g.n DESC) = 1),
    rel AS (SELECT pv.*, coalesce(CASE WHEN d.run_at < t THEN d.run_at END, u) AS since FROM pv JOIN runs m ON m.source = ps AND m.i = pi + 1 AND m.run_at < t LEFT JOIN runs d ON d.source = ps AND d.i = pi + 3),
    life AS (SELECT dedupe_key, property_id, listing_id, type, occurred_at, old_price, new_price, CASE WHEN type LIKE 'STALE%' THEN {days_sql('b', 'occurred_at')} END AS days_on_market, drops, seller_type FROM ev JOIN born USING (listing_id) WHERE r = 1
      UNION ALL SELECT listing_id || ':LISTING_REMOVED', property_id, listing_id, 'LISTING_REMOVED', gone_at, NULL, NULL, {days_sql('first_seen', 'gone_at')}, drops, seller_type FROM rem
      UNION ALL SELECT listing_id || ':RELISTED:' || before_id, property_id, listing_id, 'RELISTED', t, op, np, NULL, drops, seller_type FROM rel WHERE {days_sql('since', 't')} <= 365)"""
)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("listing_id")
    return A.observations(spark, sf_dir).select((key % 4).alias("source"), F.floor(key / 3).alias("property_id"), "listing_id", F.date_trunc("month", "observed_at").alias("observed_at"), "price", "seller_type")


@query(
    f"""WITH {LIFE_SQL} SELECT dedupe_key, property_id, listing_id, type, occurred_at, old_price, new_price, CASE WHEN type LIKE 'PRICE%' THEN old_price - new_price END AS absolute_drop,
    CASE WHEN type LIKE 'PRICE%' THEN sign(old_price - new_price) * ((abs(old_price - new_price) * 20000 + old_price) // (2 * old_price)) / 100.0 END AS percentage_drop, days_on_market, drops AS drop_count, seller_type FROM life"""
)
def listing_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every listing, removal after three missed runs and relisting of its property included."""
    return lifecycle.lifecycle_events(monthly(spark, sf_dir))


@query(f"WITH {LIFE_SQL} SELECT property_id, 1 + count(*) FILTER (type = 'RELISTED') AS cycles, count(*) FILTER (type = 'LISTING_REMOVED') AS removals, count(*) AS n_events FROM life GROUP BY 1")
def property_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.count_if(F.col("type") == kind)
    return lifecycle.lifecycle_events(monthly(spark, sf_dir)).groupBy("property_id").agg((1 + of("RELISTED")).alias("cycles"), of("LISTING_REMOVED").alias("removals"), F.count("*").alias("n_events"))


#: The flow's SQL over monthly runs: relisting is read from the events, and its opportunities are made.
RELIST_SQL = ORACLE["opportunity_flow"]
for old, new in (
    (f"WITH {EVENTS_SQL}, ", f"WITH {LIFE_SQL}, "),
    ("listing_id // 2 AS property_id", "property_id"),
    ("listing_id % 11 = 0 AS relisted", "listing_id IN (SELECT listing_id FROM life WHERE type = 'RELISTED') AS relisted"),
    ("ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC", "ORDER BY observed_at DESC, price DESC, seller_type DESC"),
    ("THEN 'PRIVATE_PRICE_DROP' END AS kind FROM ev JOIN st USING (listing_id) WHERE r = 1", "THEN 'PRIVATE_PRICE_DROP' WHEN ev.type = 'RELISTED' THEN 'PRIVATE_RELIST' END AS kind FROM life ev JOIN st USING (listing_id)"),
    ("WHEN 'AGENCY_TO_PRIVATE' THEN 30", "WHEN 'AGENCY_TO_PRIVATE' THEN 30 WHEN 'PRIVATE_RELIST' THEN 30"),
    ("(1 + (drops > 0)::INTEGER + (age >= 30)::INTEGER + relisted::INTEGER + crm::INTEGER + owner::INTEGER)::INTEGER AS n_signals", "concat_ws(',', 'seller_type:' || floor(conf * 1000 + 0.5)::INTEGER, CASE WHEN drops > 0 THEN 'price_drops:' || floor(least(1, drops / 3.0::DOUBLE) * 1000 + 0.5)::INTEGER END, CASE WHEN age >= 30 THEN 'days_on_market:' || floor(least(1, age / 120.0::DOUBLE) * 1000 + 0.5)::INTEGER END, CASE WHEN relisted THEN 'relisted:1000' END, CASE WHEN crm THEN 'crm_match:' || floor(cc * 1000 + 0.5)::INTEGER END, CASE WHEN owner THEN 'known_owner:1000' END) AS signals"),
):
    assert old in RELIST_SQL
    RELIST_SQL = RELIST_SQL.replace(old, new)


@query(RELIST_SQL)
def relist_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From observations by run to one opportunity per agency and property, relisted private sales among them."""
    rows, key, none = monthly(spark, sf_dir), F.col("listing_id"), F.lit(None).cast("string")
    kept = ("property_id", "seller_type", "price", "drop_count", "first_seen")
    one = settled(market.lives(lifecycle.seen_with_runs(rows), kept, tie=lifecycle.TIE, more=lifecycle.life_kinds(), elsewhere={"RELISTED": F.col("next.listing_id")}))
    events = one.select(F.explode("events").alias("e")).select("e.*")
    again = events.where("type = 'RELISTED'").select("listing_id", F.lit(True).alias("again")).distinct()
    state = one.drop("events").join(again, "listing_id", "left")
    listings = state.withColumns({"seller_confidence": F.when(key % 5 == 0, 0.8).otherwise(0.9), "seller_name": none, "phone": F.when(key % 4 == 0, F.concat(F.lit("+32"), key)), "email": none, "match_key": F.concat(F.lit("own:"), key), "is_relisted": F.coalesce("again", F.lit(False)), **place_of(key)}).drop("again")
    contacts, interactions = people(spark, sf_dir)
    out = flow.opportunities_of_events(events, settled(listings), territory_table(spark, sf_dir), settled(contacts), interactions, A.now(), with_reasons=False)
    signals = F.array_join(F.transform("signals", lambda s: F.concat(s["code"], F.lit(":"), F.floor(s["strength"] * 1000 + 0.5).cast("int"))), ",")
    return out.select("agency_id", "dedupe_key", "type", "score", "origin", "contact_id", "event_key", signals.alias("signals"), "expires_at")
