"""Listings over time: state, change events, absence, relisting, and their territories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import day_key, days_between

MIN_CHANGE_PERCENT, STALE_DAYS, REMOVED_AFTER, RELIST_WINDOW = 0.5, (30, 60, 90), 3, 365


def history(observations: DataFrame, key: str = "listing_id", at: str = "observed_at", tie: tuple[str, ...] = ()) -> DataFrame:
    """Each observation with the listing's state before it: previous price and seller type, first
    price, first sight, drops so far, and whether the content changed. One shuffle by listing."""
    w = Window.partitionBy(key).orderBy(at, *tie)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drop = (F.col("price") > 0) & (F.col("old_price") > 0) & (F.col("price") < F.col("old_price")) & (change_percent() >= MIN_CHANGE_PERCENT)
    out = observations.withColumns({"n": F.row_number().over(w), "old_price": F.lag("price").over(w), "old_seller_type": F.lag("seller_type").over(w), "previous_at": F.lag(at).over(w), "first_price": F.first("price").over(so_far), "first_seen": F.min(at).over(so_far)})
    out = out.withColumn("is_drop", F.coalesce(drop, F.lit(False)))
    return out.withColumns({"drop_count": F.sum(F.col("is_drop").cast("int")).over(so_far), "changed": F.col("old_price").isNull() | (F.col("old_price") != F.col("price")) | (F.col("old_seller_type") != F.col("seller_type"))})


def change_percent() -> Column:
    return F.abs(F.col("price") - F.col("old_price")) / F.col("old_price") * 100


def listing_state(observations: DataFrame, key: str = "listing_id", at: str = "observed_at", tie: tuple[str, ...] = ()) -> DataFrame:
    """The last observation of each listing with first price and sight, and its drops."""
    h = history(observations, key, at, tie)
    last = h.groupBy(key).agg(F.max_by(F.struct(*(c for c in h.columns if c != key)), F.struct(at, *tie)).alias("s"))
    return last.select(key, "s.*").select(*h.columns)


def event_kinds(key: str = "listing_id", at: str = "observed_at") -> list[tuple[str, Column, Column]]:
    """(type, condition, dedupe_key) of what an observation with history can be."""
    kind = lambda name, cond, tail="": (name, cond, F.concat(F.col(key).cast("string"), F.lit(f":{name}"), tail if isinstance(tail, Column) else F.lit(tail)))
    both = (F.col("price") > 0) & (F.col("old_price") > 0) & (change_percent() >= MIN_CHANGE_PERCENT)
    moved = F.concat(F.lit(":"), F.col("old_price").cast("string"), F.lit(":"), F.col("price").cast("string"), F.lit(":"), day_key(F.col(at)))
    today = F.concat(F.lit(":"), day_key(F.col(at)))
    age, before = days_between(F.col("first_seen"), F.col(at)), F.coalesce(days_between(F.col("first_seen"), F.col("previous_at")), F.lit(-1))
    return [
        kind("NEW_LISTING", F.col("n") == 1), kind("FSBO_DETECTED", (F.col("n") == 1) & (F.col("seller_type") == "private")),
        kind("PRICE_DROP", both & (F.col("price") < F.col("old_price")), moved), kind("PRICE_INCREASE", both & (F.col("price") > F.col("old_price")), moved),
        kind("AGENCY_TO_PRIVATE", (F.col("old_seller_type") == "professional") & (F.col("seller_type") == "private"), today),
        kind("PRIVATE_TO_AGENCY", (F.col("old_seller_type") == "private") & (F.col("seller_type") == "professional"), today),
        *(kind(f"STALE_{d}", (F.col("n") > 1) & (age >= d) & (before < d)) for d in STALE_DAYS),
    ]


def detect_events(h: DataFrame, key: str = "listing_id", at: str = "observed_at", carry: tuple[str, ...] = (), more: tuple[tuple[str, Column, Column], ...] = ()) -> DataFrame:
    """(dedupe_key, listing, type, occurred_at, old and new price, drop, percent) of observations with history.

    Sub-threshold changes move the baseline without an event. A threshold of days fires on the
    first observation that has reached it. Events with the same key count once. ``carry``: further
    columns of the observations to keep; ``more``: further kinds of events.
    """
    found = [F.when(cond, F.struct(F.lit(name).alias("type"), dedupe_key.alias("dedupe_key"))) for name, cond, dedupe_key in (*event_kinds(key, at), *more)]
    rows = h.withColumn("e", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())))
    price_event = F.col("e.type").isin("PRICE_DROP", "PRICE_INCREASE")
    out = rows.select(
        F.col("e.dedupe_key").alias("dedupe_key"), key, F.col("e.type").alias("type"), F.col(at).alias("occurred_at"), F.when(price_event, F.col("old_price")).alias("old_price"), F.when(price_event, F.col("price")).alias("new_price"),
        F.when(price_event, F.col("old_price") - F.col("price")).alias("absolute_drop"), F.when(price_event, F.round((F.col("old_price") - F.col("price")).cast("decimal(20,6)") / F.col("old_price") * 100, 2).cast("double")).alias("percentage_drop"), "drop_count", "seller_type", *carry,
    )
    # The key holds the listing, so this needs no shuffle beyond the history's.
    first = Window.partitionBy(key, "dedupe_key").orderBy("occurred_at", F.col("new_price").asc_nulls_first())
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def lives(h: DataFrame, kept: tuple[str, ...], key: str = "listing_id", at: str = "observed_at", tie: tuple[str, ...] = (), more: tuple[tuple[str, Column, Column], ...] = (), elsewhere: dict[str, Column] | None = None) -> DataFrame:
    """One row per listing: ``kept`` columns of its last observation, and events: (listing, type, dedupe_key), of each type the greatest key.

    From the history as it lies, in one pass and without a row for each event. ``more``: further kinds of
    events; ``elsewhere``: of a kind, the listing whose event it is, where it's another one.
    """
    of = lambda name: (elsewhere or {}).get(name, F.col(key))
    kinds = (*event_kinds(key, at), *more)
    found = [F.max(F.when(cond, F.struct(dedupe_key.alias("dedupe_key"), of(name).alias("owner")))).alias(f"_{name}") for name, cond, dedupe_key in kinds]
    one = h.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(at, *tie)).alias("s"), *found)
    events = F.array_compact(F.array(*(F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col(f"_{name}.owner").alias(key), F.lit(name).alias("type"), F.col(f"_{name}.dedupe_key").alias("dedupe_key"))) for name, _, _ in kinds)))
    return one.select(key, "s.*", events.alias("events"))


def missed_runs(seen: DataFrame, runs: DataFrame, key: str = "listing_id", run: str = "run") -> DataFrame:
    """(listing, run, missed): runs missed in a row since the listing was last seen, from its first sight on.

    ``runs`` is the small table of run numbers. Only the spans without the listing are made, from
    each sight to the next one.
    """
    numbered = runs.select(F.col(run).alias("run")).withColumn("i", F.row_number().over(Window.orderBy("run")))  # one row per run, not per listing
    hits = seen.select(key, F.col(run).alias("run")).distinct().join(numbered, "run")
    beyond = F.coalesce(F.lead("i").over(Window.partitionBy(key).orderBy("i")), F.col("last") + 1)
    spans = hits.crossJoin(F.broadcast(numbered.agg(F.max("i").alias("last")))).withColumn("next", beyond)
    grid = spans.select(key, "i", F.explode(F.sequence(F.col("i"), F.col("next") - 1)).alias("j"))
    return grid.select(key, F.col("j").alias("i"), (F.col("j") - F.col("i")).cast("long").alias("missed")).join(numbered, "i").select(key, "run", "missed")


def absence(seen: DataFrame, runs: DataFrame, threshold: int = REMOVED_AFTER, key: str = "listing_id", run: str = "run") -> tuple[DataFrame, DataFrame]:
    """(states, removals) after the last run.

    states: key, missed, status ACTIVE, MISSING or REMOVED. removals: key, run and dedupe_key of the
    first time that a listing was missed ``threshold`` times in a row. From gaps alone, no grid.
    """
    numbered = runs.select(F.col(run).alias("run")).withColumn("i", F.row_number().over(Window.orderBy("run")))  # one row per run
    last = numbered.agg(F.max("i").alias("last"))
    hits = seen.select(key, F.col(run).alias("run")).distinct().join(numbered, "run").crossJoin(F.broadcast(last))
    gaps = hits.withColumn("gap", F.coalesce(F.lead("i").over(Window.partitionBy(key).orderBy("i")), F.col("last") + 1) - F.col("i") - 1)
    missed = F.max_by("gap", "i")
    states = gaps.groupBy(key).agg(missed.alias("missed")).withColumn("status", F.when(F.col("missed") == 0, "ACTIVE").when(F.col("missed") < threshold, "MISSING").otherwise("REMOVED"))
    gone = gaps.where(F.col("gap") >= threshold).groupBy(key).agg((F.min("i") + threshold).alias("i"))
    removals = gone.join(numbered, "i").select(key, "run", F.concat(F.col(key).cast("string"), F.lit(":LISTING_REMOVED")).alias("dedupe_key"))
    return states, removals


def predecessors(listings: DataFrame, window_days: int = RELIST_WINDOW) -> DataFrame:
    """(listing_id, previous_id, gap_days, dedupe_key): of each new listing the property's last gone one.

    listings: listing_id, property_id, first_seen, last_seen, removed_at, status, previous_id. Only
    MISSING or REMOVED ones that nothing has relisted yet can be a predecessor, the latest removed
    (none removed first) and then the last seen one; the gap counts from removal, or last sight.
    Each property's gone listings are reduced to the latest before the join.
    """
    taken = listings.where("previous_id is not null").select(F.col("previous_id").alias("listing_id")).distinct()
    gone = listings.where(F.col("status").isin("MISSING", "REMOVED")).join(taken, "listing_id", "left_anti")
    order = F.struct(F.col("removed_at").isNull(), "removed_at", "last_seen", "listing_id")
    latest = gone.groupBy("property_id").agg(F.max_by(F.struct("listing_id", F.coalesce("removed_at", "last_seen").alias("at")), order).alias("g"))
    fresh = listings.where("status = 'ACTIVE' and previous_id is null").join(latest, "property_id")
    gap = days_between(F.col("g.at"), F.col("first_seen"))
    out = fresh.where(F.col("g.at") <= F.col("first_seen")).select("listing_id", F.col("g.listing_id").alias("previous_id"), gap.alias("gap_days"))
    return out.where(F.col("gap_days") <= window_days).withColumn("dedupe_key", F.concat(F.col("listing_id").cast("string"), F.lit(":RELISTED:"), F.col("previous_id").cast("string")))


def listing_cycles(events: DataFrame, listings: DataFrame) -> DataFrame:
    """(property_id, cycles): one, and one more for each relisting event of the property's listings."""
    return listings.select("listing_id", "property_id").join(events.select("listing_id", "type"), "listing_id", "left").groupBy("property_id").agg((1 + F.count_if(F.col("type") == "RELISTED")).alias("cycles"))


def seller_counts(listings: DataFrame, order: list[str]) -> DataFrame:
    """Adds active_before: the active listings of the same seller among the rows before, in this order."""
    before = Window.partitionBy("seller_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return listings.withColumn("active_before", F.coalesce(F.sum(F.col("active").cast("long")).over(before), F.lit(0)))


def relisted(listings: DataFrame, window_days: int = RELIST_WINDOW) -> DataFrame:
    """(listing, previous listing, gap_days, dedupe_key): the property's listing before it, gone within the window.

    listings: listing_id, property_id, first_seen, gone_at.
    """
    w = Window.partitionBy("property_id").orderBy("first_seen", "listing_id")
    linked = listings.withColumns({"previous_id": F.lag("listing_id").over(w), "previous_gone": F.lag("gone_at").over(w)}).where("previous_id is not null and previous_gone <= first_seen")
    gap = days_between(F.col("previous_gone"), F.col("first_seen"))
    key = F.concat(F.col("listing_id").cast("string"), F.lit(":RELISTED:"), F.col("previous_id").cast("string"))
    return linked.withColumn("gap_days", gap).where(F.col("gap_days") <= window_days).select("listing_id", "previous_id", "gap_days", key.alias("dedupe_key"))


def best_territory(places: DataFrame, territories: DataFrame) -> DataFrame:
    """(place, agency, territory, kind, rank): of each agency the closest active territory.

    territories: territory_id, agency_id, active and the arrays postal_codes, municipalities and
    provinces. Membership is an equi-join on exploded keys, the smaller side found by Spark.
    """
    keys = [("postal_code", "postal_codes", "postal", 3), ("municipality", "municipalities", "city", 2), ("province", "provinces", "province", 1)]
    listed = lambda kind, column, rank: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(rank).alias("rank")))
    active = territories.where("active")
    wide = active.select("territory_id", "agency_id", F.explode(F.concat(*(listed(kind, column, rank) for kind, column, _, rank in keys))).alias("k")).select("territory_id", "agency_id", "k.*")
    long = places.select("place_id", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(field).alias("value")) for kind, _, field, _ in keys))).alias("k")).select("place_id", "k.*").where("value is not null")
    best = Window.partitionBy("place_id", "agency_id").orderBy(F.desc("rank"), "territory_id")
    return long.join(wide, ["kind", "value"]).withColumn("n", F.row_number().over(best)).where("n = 1").select("place_id", "agency_id", "territory_id", "kind", "rank")
