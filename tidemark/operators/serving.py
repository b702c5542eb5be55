"""Reads and upkeep: work-list, counts, market overview, alerts, contact merge, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between

OPEN = ("NEW", "ASSIGNED", "TO_CONTACT", "CONTACTED", "APPOINTMENT", "NEGOTIATION", "SNOOZED")
#: PostgreSQL's order: descending puts nulls first.
SORTS = {"score": ("score", "created_at"), "newest": ("created_at",), "price": ("price", "score"), "relationship": ("relationship", "score")}


def is_open(now: Column) -> Column:
    return F.col("status").isin(*OPEN) & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now))


def work_list(opportunities: DataFrame, now: Column, *, status: str = "OPEN", kind: str | None = None, origin: str | None = None, least_score: int | None = None, max_age_days: int | None = None, price: tuple[float | None, float | None] = (None, None), sort: str = "score", page: int = 1, size: int | None = 25, assignee: int | str | None = None, crm_only: bool = False, city: str | None = None, **equal: str | None) -> DataFrame:
    """A page of opportunities; a column of the sort that is null comes first, ties by opportunity_id.

    ``size`` None returns all that pass. Every condition is a plain filter that reaches the scan. assignee: assignee_id;
    crm_only: those with a contact; city: in any case; ``equal``: postal_code, property_type, seller_type, source.
    """
    rows = opportunities.where(is_open(now)) if status == "OPEN" else opportunities if status == "ALL" else opportunities.where(F.col("status") == status)
    for column, value in (("type", kind), ("origin", origin), ("assignee_id", assignee), *equal.items()):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if least_score is None else rows.where(F.col("score") >= least_score)
    rows = rows if max_age_days is None else rows.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(max_age_days)))
    rows = rows.where("contact_id is not null") if crm_only else rows
    rows = rows if city is None else rows.where(F.lower("city") == city.lower())
    low, high = price
    rows = rows if low is None else rows.where(F.col("price") >= low)
    rows = rows if high is None else rows.where(F.col("price") <= high)
    ordered = rows.orderBy(*(F.col(c).desc_nulls_first() for c in SORTS[sort]), "opportunity_id")
    return ordered if size is None else ordered.offset((page - 1) * size).limit(size)


def top_per_parent(children: DataFrame, parent: str, order: list[Column], n: int) -> DataFrame:
    return children.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= n)


def funnel(opportunities: DataFrame) -> DataFrame:
    """Conditional counts and ratios of each agency in one pass."""
    n = lambda cond: F.count_if(cond)
    won, lost, gone = (F.col("status") == s for s in ("WON", "LOST", "DISMISSED"))
    rows = opportunities.groupBy("agency_id").agg(F.count("*").alias("total"), n(F.col("status") != "NEW").alias("handled"), n(won).alias("won"), n(lost).alias("lost"), n(gone).alias("dismissed"), n(won & (F.col("origin") == "CROSS")).alias("cross_won"))
    decided = F.col("won") + F.col("lost") + F.col("dismissed")
    return rows.withColumn("conversion", F.when(decided == 0, 0.0).otherwise(F.round(F.col("won") * 100 / decided, 4))).withColumn("cross_share", F.when(F.col("won") == 0, 0.0).otherwise(F.round(F.col("cross_won") * 100 / F.col("won"), 4)))


def market_overview(listings: DataFrame, by: list[str], now: Column | None = None) -> DataFrame:
    """Active and private listings, share, median price (over 0) and first city of each group; with ``now`` the median of the days since first sight too.

    Medians are exact: a group's task holds a count for each different price and number of days, not the rows.
    """
    price = F.when(F.col("price") > 0, F.col("price"))
    days = {} if now is None else {"d": F.median(days_between(F.col("first_seen"), now))}
    rows = listings.groupBy(*by).agg(*(v.alias(k) for k, v in days.items()), F.count("*").alias("active"), F.count_if(F.col("seller_type") == "private").alias("private"), F.median(price).alias("m"), F.min_by("city", F.struct("first_seen", "listing_id")).alias("city"))
    return rows.select(*by, "active", "private", F.round(F.col("private") * 100 / F.col("active"), 4).alias("private_share"), F.floor(F.col("m") + 0.5).cast("long").alias("median_price"), "city", *(F.coalesce(k, F.lit(0.0)).alias("median_days") for k in days))


def rules_now(rules: DataFrame, hour: int, fallback_chat: str | None = None) -> DataFrame:
    """The rules that may send at this hour, with their chat: outside quiet hours, which may span midnight, and with a chat of the rule, agency or at all.

    rules: quiet_start, quiet_end (null or equal: never quiet), chat_id, agency_chat_id and others.
    """
    start, end, h = F.col("quiet_start"), F.col("quiet_end"), F.lit(hour)
    quiet = F.when(start < end, (h >= start) & (h < end)).when(start > end, (h >= start) | (h < end)).otherwise(False)
    chat = F.coalesce("chat_id", "agency_chat_id", F.lit(fallback_chat).cast("string"))
    return rows_with(rules.where(~quiet).withColumn("chat_id", chat), "chat_id")


def rows_with(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "")


def select_alerts(rules: DataFrame, opportunities: DataFrame, sent: DataFrame) -> DataFrame:
    """(rule_id, opportunity_id, rank): what each rule may still send today, highest scores first.

    rules: rule_id, agency_id, least_score, daily_cap, types (empty: all), and require_crm where there
    is one (then only opportunities with a contact). sent: rule_id, opportunity_id, today. Nothing is sent
    twice; today's count is taken off the cap.
    """
    used = sent.where("today").groupBy("rule_id").agg(F.count("*").alias("used"))
    left = rules.join(used, "rule_id", "left").withColumn("left", F.col("daily_cap") - F.coalesce("used", F.lit(0)))
    fit = left.join(opportunities, "agency_id").where((F.col("score") >= F.col("least_score")) & ((F.size("types") == 0) | F.array_contains("types", F.col("type"))))
    if "require_crm" in rules.columns:
        fit = fit.where(~F.coalesce("require_crm", F.lit(False)) | F.col("contact_id").isNotNull())
    fresh = fit.join(sent.select("rule_id", "opportunity_id"), ["rule_id", "opportunity_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("score"), "opportunity_id"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= F.col("left")).select("rule_id", "opportunity_id", "score", "rank")


def merge_contacts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Contacts after an import: what isn't empty overwrites, UNKNOWN never does, created_at only fills a
    gap, last_contact_at only moves forward; ``changes`` lists the fields that differ."""
    b = batch.select("contact_id", *(F.col(c).alias(f"n_{c}") for c in ("name", "email", "contact_type", "created_at", "last_contact_at")))
    j = state.join(b, "contact_id", "full")
    filled = lambda c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(c))
    new = {
        "name": filled("name"), "email": filled("email"), "contact_type": F.coalesce(F.nullif(F.col("n_contact_type"), F.lit("UNKNOWN")), F.col("contact_type"), F.lit("UNKNOWN")),
        "created_at": F.coalesce("created_at", "n_created_at"), "last_contact_at": F.greatest("last_contact_at", "n_last_contact_at"),
    }
    changes = F.array_join(F.array_compact(F.array(*(F.when(~v.eqNullSafe(F.col(c)), c) for c, v in new.items()))), ",")
    return j.select("contact_id", *(v.alias(c) for c, v in new.items()), changes.alias("changes"))


def redact_silent(contacts: DataFrame, interactions: DataFrame, cutoff: Column, fields: tuple[str, ...] = ("name", "email")) -> DataFrame:
    """Fields nulled of contacts without an interaction since the cutoff and last heard of before it."""
    recent = interactions.where(F.col("at") >= cutoff).select("contact_id").distinct().withColumn("_recent", F.lit(True))
    j = contacts.join(recent, "contact_id", "left")
    silent = F.col("_recent").isNull() & F.coalesce(F.coalesce("last_contact_at", "created_at") < cutoff, F.lit(False))
    return j.withColumns({f: F.when(~silent, F.col(f)) for f in fields}).withColumn("redacted", silent).drop("_recent")
