"""Counts, breakdowns and searches over opportunities, contacts, properties and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.serving import is_open


def by_type(opportunities: DataFrame) -> DataFrame:
    """(agency_id, type, total, contacted, won) of opportunities with contacted_at and status."""
    return opportunities.groupBy("agency_id", "type").agg(F.count("*").alias("total"), F.count("contacted_at").alias("contacted"), F.count_if(F.col("status") == "WON").alias("won"))


def by_agent(opportunities: DataFrame, users: DataFrame, unknown: str = "onbekend") -> DataFrame:
    """The same by assigned user, with the user's name, or else e-mail; unassigned ones don't count."""
    rows = opportunities.where("user_id is not null").groupBy("agency_id", "user_id").agg(F.count("*").alias("assigned"), F.count("contacted_at").alias("contacted"), F.count_if(F.col("status") == "WON").alias("won"))
    return rows.join(users.select("user_id", F.coalesce("name", "email").alias("known")), "user_id", "left").select("agency_id", "user_id", F.coalesce("known", F.lit(unknown)).alias("name"), "assigned", "contacted", "won")


def stages(opportunities: DataFrame, activities: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """How many opportunities of each agency stand at a stage or have passed it.

    ``activities`` (opportunity_id, to_status) are rolled up to one row of flags before the join.
    """
    passed = activities.where(F.col("to_status").isin(*names)).groupBy("opportunity_id").agg(*(F.bool_or(F.col("to_status") == s).alias(f"_{s}") for s in names))
    rows = opportunities.select("opportunity_id", "agency_id", "status").join(passed, "opportunity_id", "left")
    return rows.groupBy("agency_id").agg(*(F.count_if((F.col("status") == s) | F.coalesce(F.col(f"_{s}"), F.lit(False))).alias(s.lower()) for s in names))


def opportunity_counts(opportunities: DataFrame, now: Column, hours: int) -> DataFrame:
    """Of each agency, in one pass: all, open, recent and unassigned ones, by origin."""
    recent = F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    return opportunities.groupBy("agency_id", "origin").agg(F.count("*").alias("total"), F.count_if(is_open(now)).alias("open"), F.count_if(recent).alias("recent"), F.count_if(is_open(now) & recent).alias("open_recent"))


def contact_tiles(contacts: DataFrame, relations: DataFrame) -> DataFrame:
    """total, dormant, with_phone, valuation_leads and linked of each agency; redacted contacts don't count."""
    live = contacts.where("not redacted").groupBy("agency_id").agg(F.count("*").alias("total"), F.count_if("dormant").alias("dormant"), F.count("phone").alias("with_phone"), F.count_if(F.col("contact_type") == "VALUATION_LEAD").alias("valuation_leads"))
    linked = relations.where("property_id is not null").groupBy("agency_id").agg(F.count("*").alias("linked"))
    return live.join(linked, "agency_id", "full").na.fill(0)


def digest(opportunities: DataFrame, hot: int = 70) -> DataFrame:
    """What a day's message of each agency says: total, hot ones, those with a contact, types by count, the best one."""
    per_type = opportunities.groupBy("agency_id", "type").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= hot).alias("hot"), F.count("contact_id").alias("known"), F.max_by("opportunity_id", F.struct("score", -F.col("opportunity_id"))).alias("best"), F.max(F.struct("score", -F.col("opportunity_id"))).alias("top"))
    types = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))), lambda t: F.concat(F.abs(t["n"]).cast("string"), F.lit("x "), t["type"]))  # as many as there are types
    return per_type.groupBy("agency_id").agg(F.sum("n").alias("total"), F.sum("hot").alias("hot"), F.sum("known").alias("known"), F.array_join(types, ", ").alias("types"), F.max_by("best", "top").alias("best"))


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Rows of each child table by parent; each child is grouped before the join, so nothing multiplies."""
    out = parents.select(key)
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.na.fill(0)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def served_agencies(agencies: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Active agencies without a subscription, or with an active one that hasn't ended."""
    s = subscriptions.select("agency_id", F.col("status").alias("_status"), F.col("ends_at").alias("_ends"), F.lit(True).alias("_has"))
    return agencies.join(s, "agency_id", "left").where(F.col("active") & (F.col("_has").isNull() | ((F.col("_status") == "ACTIVE") & (F.col("_ends").isNull() | (F.col("_ends") > now))))).select(*agencies.columns)


def holds(text: Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


def search_properties(properties: DataFrame, territories: DataFrame, query: str | None = None) -> DataFrame:
    """(agency_id, property) of the agency's active territories; without postal codes there are none.

    The query is looked for in address, street and city, and as the start of the postal code.
    """
    codes = territories.where("active").select("agency_id", F.explode("postal_codes").alias("postal_code")).distinct()
    rows = properties
    if query and (q := query.strip()):
        rows = rows.where(holds(F.col("address"), q) | holds(F.col("street"), q) | holds(F.col("city"), q) | F.coalesce(F.col("postal_code").startswith(q), F.lit(False)))
    return rows.join(codes, "postal_code")


def search_contacts(contacts: DataFrame, query: str | None = None, kind: str | None = None, status: str | None = None, dormant_only: bool = False) -> DataFrame:
    """Contacts by type, status, dormancy and a text in name, e-mail, city or phone (the phone as written)."""
    rows = contacts if kind is None else contacts.where(F.col("contact_type") == kind)
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows.where("dormant") if dormant_only else rows
    if query and (q := query.strip()):
        rows = rows.where(holds(F.col("name"), q) | holds(F.col("email"), q) | holds(F.col("city"), q) | F.coalesce(F.contains(F.col("phone"), F.lit(q)), F.lit(False)))
    return rows


def due_sources(sources: DataFrame, allowed: list[str] | DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Allowed, enabled, unlocked sources past cooldown and poll interval, those that waited longest first.

    sources: key, enabled, cooldown_until, locked_until, last_run_at, poll_seconds. None of them is due without an allow-list,
    which is a list or a table with a column ``key``.
    """
    past = lambda c: F.col(c).isNull() | (F.col(c) <= now)
    waited = F.col("last_run_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_run_at") >= F.col("poll_seconds"))
    named = sources.join(allowed.select("key").distinct(), "key", "left_semi") if isinstance(allowed, DataFrame) else sources.where(F.col("key").isin(*allowed))
    rows = named.where(F.col("enabled") & past("cooldown_until") & past("locked_until") & waited).orderBy(F.col("last_run_at").asc_nulls_first(), "key")
    return rows if limit is None else rows.limit(limit)


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table, without a full sort."""
    return rows.orderBy(*order).limit(n)


def with_parents(opportunities: DataFrame, properties: DataFrame, contacts: DataFrame, reasons: int = 6) -> DataFrame:
    """A list's rows with property and contact, where there are any, and the first reasons."""
    p = properties.select("property_id", F.struct(*(c for c in properties.columns if c != "property_id")).alias("property"))
    k = contacts.select("contact_id", F.struct(*(c for c in contacts.columns if c != "contact_id")).alias("contact"))
    return opportunities.join(p, "property_id", "left").join(k, "contact_id", "left").withColumn("reasons", F.slice("reasons", 1, reasons))


def page_histogram(page: DataFrame, column: str) -> DataFrame:
    """(column, n) over a page of a list, the most frequent first, ties by value."""
    return page.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def having(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The parents that have a child; a parent with many isn't repeated."""
    return parents.join(children.select(key), key, "left_semi")


def richest(children: DataFrame, parent: str) -> DataFrame:
    """(parent, n): the one with the most children, the lowest of several. Only each task's best reaches the last one."""
    return children.dropna(subset=[parent]).groupBy(parent).agg(F.count("*").alias("n")).orderBy(F.desc("n"), parent).limit(1)


def alerts_since(alerts: DataFrame, since: Column) -> DataFrame:
    """(agency_id, n): the alerts of each agency from a time on; agencies without one have 0."""
    return alerts.groupBy("agency_id").agg(F.count_if(F.col("at") >= since).alias("n"))


def bounded(runs: DataFrame, warnings: int = 50, error: int = 500) -> DataFrame:
    """Runs as they are stored: so many warnings, and so many characters of the error, at most."""
    return runs.withColumns({"warnings": F.slice("warnings", 1, warnings), "error": F.substring("error", 1, error)})
