"""Opportunities: rules, five-dimension score, merge with state, dormant contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import months_between

WEIGHTS = {"intent": 0.40, "relationship": 0.22, "timing": 0.15, "territory": 0.11, "confidence": 0.12}
CROSS_BONUS, HIGH_VALUE, VERSION = 12, 600_000, "v1"
REFRESHABLE = ("NEW", "ASSIGNED", "TO_CONTACT", "SNOOZED")


def opportunity_type(event: Column, confident: Column, drops: Column) -> Column:
    """Null where an event makes no opportunity."""
    private = (
        F.when(event == "FSBO_DETECTED", "NEW_FSBO").when(event.startswith("STALE_"), "STALE_FSBO").when((event == "PRICE_DROP") & (drops >= 2), "PRIVATE_MULTIPLE_PRICE_DROP").when(event == "PRICE_DROP", "PRIVATE_PRICE_DROP").when(event == "RELISTED", "PRIVATE_RELIST")
    )
    return F.when(event == "AGENCY_TO_PRIVATE", "AGENCY_TO_PRIVATE").when(confident, private)


def expiry_days(kind: Column, default: int = 30) -> Column:
    return (
        F.when(kind == "NEW_FSBO", min(default, 14)).when(kind.isin("PRIVATE_PRICE_DROP", "PRIVATE_MULTIPLE_PRICE_DROP"), min(default, 21)).when(kind.isin("AGENCY_TO_PRIVATE", "PRIVATE_RELIST"), default).when(kind == "STALE_FSBO", max(default, 45)).otherwise(max(default, 90))
    )


def factors() -> list[tuple[str, str, Column]]:
    """(code, dimension, points or null) of each factor over the scoring context's columns."""
    c = F.col
    steps = lambda col, *pairs: F.when(col >= pairs[0][0], F.lit(pairs[0][1])) if len(pairs) == 1 else F.when(col >= pairs[0][0], F.lit(pairs[0][1])).otherwise(steps(col, *pairs[1:]))
    return [
        ("private_seller", "intent", F.when(c("seller_type") == "private", 45)), ("agency_to_private", "intent", F.when(c("type") == "AGENCY_TO_PRIVATE", 25)), ("price_reduction", "intent", F.when(c("drop_count") >= 1, 15)), ("multiple_reductions", "intent", F.when(c("drop_count") >= 2, 15)),
        ("relisted", "intent", F.when(c("is_relisted"), 20)), ("long_on_market", "intent", steps(c("days_on_market"), (90, 20), (60, 15), (30, 10))), ("dormant_valuation", "intent", F.when(c("type") == "DORMANT_VALUATION_LEAD", 40)),
        ("former_seller_intent", "intent", F.when(c("type").isin("FORMER_SELLER_PROSPECT", "LOST_MANDATE"), 35)), ("never_contacted", "intent", F.when(c("never_contacted"), 25)), ("high_value", "intent", F.when(c("price") >= HIGH_VALUE, 10)),
        ("known_owner", "relationship", F.when(c("is_known_owner"), 55)), ("was_client", "relationship", F.when(c("was_client"), 30)), ("had_valuation", "relationship", F.when(c("had_valuation"), 20)),
        ("relationship_age", "relationship", F.when(c("relationship_months") >= 12, F.least(F.lit(15), 5 * F.floor(c("relationship_months") / 12)).cast("int"))), ("crm_known", "relationship", F.when(c("has_crm_match"), 15)),
        ("fresh_listing", "timing", F.when(c("minutes_since_seen") <= 10, 100).when(c("minutes_since_seen") <= 60, 60)), ("recent_price_drop", "timing", F.when(c("type").isin("PRIVATE_PRICE_DROP", "PRIVATE_MULTIPLE_PRICE_DROP"), 70)),
        ("stale_milestone", "timing", F.when(c("type") == "STALE_FSBO", F.when(c("days_on_market") >= 90, 65).otherwise(50))), ("relist_moment", "timing", F.when(c("is_relisted"), 75)), ("dormancy_ripe", "timing", steps(c("silent_months"), (84, 60), (36, 45), (12, 30))),
        ("territory_match", "territory", F.when(c("territory") == "postal_code", 100).when(c("territory") == "municipality", 75).when(c("territory") == "province", 40)),
        ("seller_confidence", "confidence", F.when(c("seller_type") != "unknown", F.floor(55 * c("seller_confidence") + 0.5).cast("int"))), ("crm_match_confidence", "confidence", F.when(c("has_crm_match"), F.floor(30 * c("crm_confidence") + 0.5).cast("int"))),
        ("phone_available", "confidence", F.when(c("has_phone"), 15)),
    ]


def score(context: DataFrame, with_reasons: bool = True) -> DataFrame:
    """Adds the five dimensions, weighted_base, cross_bonus, score and, if asked for, reasons (code,
    dimension, points, most first).

    A dimension is the sum of its factors, 100 at most; in the reasons, the factors with the most
    points fill it, the last one cut. The relationship counts only where there is a match with a contact.
    """
    all_factors = factors()
    totals = {}
    for d in WEIGHTS:
        points = [F.greatest(F.lit(0), F.coalesce(p.cast("int"), F.lit(0))) for _, of, p in all_factors if of == d]
        totals[d] = F.least(F.lit(100), sum(points[1:], points[0]))
    # ``territory`` is both a factor's input and a dimension, so the dimensions come in by one step.
    out = (with_reason_list(context, all_factors) if with_reasons else context).withColumns(totals)
    crm = F.coalesce("has_crm_match", F.lit(False))
    full = sum((w * F.col(d) for d, w in WEIGHTS.items()), F.lit(0.0))
    alone = sum((w * F.col(d) for d, w in WEIGHTS.items() if d != "relationship"), F.lit(0.0)) / (1 - WEIGHTS["relationship"])
    bonus = F.when((F.col("origin") == "CROSS") & crm, F.floor(CROSS_BONUS * F.col("relationship") / 100 * F.col("crm_confidence") + 0.5)).otherwise(0).cast("int")
    out = out.withColumn("weighted_base", F.floor(F.round(F.when(crm, full).otherwise(alone), 9) + 0.5).cast("int")).withColumn("cross_bonus", bonus)
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("weighted_base") + F.col("cross_bonus"))))


def with_reason_list(context: DataFrame, all_factors: list[tuple[str, str, Column]]) -> DataFrame:
    listed = F.filter(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(d).alias("dimension"), p.cast("int").alias("points"), F.lit(i).alias("n")) for i, (code, d, p) in enumerate(all_factors))), lambda f: f["points"] > 0)
    by_points = lambda a, b: F.when(a["points"] != b["points"], b["points"] - a["points"]).otherwise(a["n"] - b["n"])
    out = context.withColumn("_factors", F.array_sort(listed, by_points))
    item = "struct<code:string,dimension:string,points:int,n:int>"
    kind = f"struct<total:int,kept:array<{item}>>"
    start = F.struct(F.lit(0).alias("total"), F.array().cast(f"array<{item}>").alias("kept")).cast(kind)
    fill = lambda s, f: F.struct(
        F.least(F.lit(100), s["total"] + f["points"]).alias("total"),
        F.when(s["total"] >= 100, s["kept"]).otherwise(F.concat(s["kept"], F.array(F.struct(f["code"].alias("code"), f["dimension"].alias("dimension"), F.least(f["points"], 100 - s["total"]).alias("points"), f["n"].alias("n"))))).alias("kept"),
    ).cast(kind)
    kept = [F.aggregate(F.filter("_factors", lambda f, d=d: f["dimension"] == d), start, fill)["kept"] for d in WEIGHTS]
    reasons = F.transform(F.array_sort(F.concat(*kept), by_points), lambda r: F.struct(r["code"].alias("code"), r["dimension"].alias("dimension"), r["points"].alias("points")))
    return out.withColumn("reasons", reasons).drop("_factors")


def merge_opportunities(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch: one row per (agency_id, dedupe_key).

    New keys are taken up as NEW; a known one is refreshed only by a strictly higher score and
    while its status allows. Both: agency_id, dedupe_key, score, type; state also status.
    """
    keys = ["agency_id", "dedupe_key"]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct("score", "type"), F.struct("score", "type")).alias("n"))
    both = state.withColumn("_old", F.lit(True)).join(best, keys, "full")
    old = F.coalesce("_old", F.lit(False))
    take = ~old | (F.col("n.score").isNotNull() & (F.col("n.score") > F.col("score")) & F.col("status").isin(*REFRESHABLE))
    return both.select(*keys, F.when(take, F.col("n.score")).otherwise(F.col("score")).alias("score"), F.when(take, F.col("n.type")).otherwise(F.col("type")).alias("type"), F.coalesce("status", F.lit("NEW")).alias("status"), F.when(~old, "created").when(take, "refreshed").otherwise("kept").alias("outcome"))


def assess_contacts(contacts: DataFrame, interactions: DataFrame, now: Column, dormant_months: int = 12, least_score: int = 45) -> DataFrame:
    """Relationship score, dormancy and opportunity type of each contact.

    contacts: contact_id, contact_type, status, created_at, last_contact_at, roles (array).
    interactions: contact_id, kind. Interactions are rolled up before the join.
    """
    rolled = interactions.groupBy("contact_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "VALUATION").alias("had_valuation"), F.bool_or(F.col("kind") == "MANDATE").alias("had_mandate"))
    c = contacts.join(rolled, "contact_id", "left").fillna({"n": 0, "had_valuation": False, "had_mandate": False})
    silent, age = months_between(F.col("last_contact_at"), now), months_between(F.col("created_at"), now)
    owners = F.array(*map(F.lit, ("OWNER", "FORMER_OWNER", "SELLER", "VALUATION_SUBJECT")))
    c = c.withColumns({"silent_months": silent, "relationship_months": age, "never_contacted": (F.col("n") == 0) & F.col("last_contact_at").isNull()})
    points = (
        F.when(F.arrays_overlap("roles", owners), 25).otherwise(0) + F.when((F.col("status") == "WON") | (F.col("contact_type") == "FORMER_CLIENT"), 30).otherwise(0) + F.when(F.col("had_valuation") | (F.col("contact_type") == "VALUATION_LEAD"), 20).otherwise(0)
        + F.when(F.col("had_mandate"), 10).otherwise(0) + F.when(F.col("n") >= 5, 15).when(F.col("n") >= 2, 8).otherwise(0) + F.when(F.col("relationship_months") >= 24, F.least(F.lit(10), 2 * F.floor(F.col("relationship_months") / 12))).otherwise(0)
    )
    c = c.withColumn("relationship_score", F.least(F.lit(100), points).cast("int"))
    c = c.withColumn("is_dormant", F.when(F.col("silent_months").isNotNull(), F.col("silent_months") >= dormant_months).otherwise(F.coalesce(F.col("relationship_months") >= 1, F.lit(False))))
    kind, won = F.col("contact_type"), F.col("status") == "WON"
    ripe = F.col("is_dormant") & (F.col("relationship_score") >= least_score)
    of_ripe = (
        F.when(F.col("had_mandate") & (F.col("status") == "LOST"), "LOST_MANDATE").when((kind == "VALUATION_LEAD") & ~won, "DORMANT_VALUATION_LEAD").when((kind == "SELLER") & ~won, "FORMER_SELLER_PROSPECT").when(won | (kind == "FORMER_CLIENT"), "FORMER_CLIENT")
        .when((kind == "BUYER") & (F.col("relationship_months") >= 60), "PREVIOUS_BUYER")
    )
    return c.withColumn("opportunity_type", F.when(F.col("never_contacted") & (F.col("status") != "LOST"), "UNCONTACTED_LEAD").when(ripe, of_ripe))


def assignment_history(assignments: DataFrame) -> DataFrame:
    """(opportunity_id, user_id, assigned_at, unassigned_at): an assignment ends when the next begins."""
    w = Window.partitionBy("opportunity_id").orderBy("assigned_at", "user_id")
    return assignments.withColumn("unassigned_at", F.lead("assigned_at").over(w))


def expire(opportunities: DataFrame, now: Column) -> DataFrame:
    """NEW ones past expires_at become DISMISSED."""
    return opportunities.withColumn("status", F.when((F.col("status") == "NEW") & (F.col("expires_at") < now), "DISMISSED").otherwise(F.col("status")))


def reason_rows(scored: DataFrame, limit: int = 10, key: str = "opportunity_id") -> DataFrame:
    """(key, rank, code, dimension, points): the reasons of a score as rows, the strongest first from 0, ``limit`` at most."""
    rows = scored.select(key, F.posexplode(F.slice("reasons", 1, limit)).alias("rank", "r"))
    return rows.select(key, "rank", "r.code", "r.dimension", "r.points")


def reason_lines(reasons: Column, labels: dict[str, str], limit: int = 5) -> Column:
    """The labels of the first reasons; a code without a label stands for itself."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.transform(F.slice(reasons, 1, limit), lambda r: F.coalesce(F.try_element_at(names, r["code"]), r["code"]))
