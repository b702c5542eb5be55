"""From events to opportunities of agencies, and from silent contacts to opportunities, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between, minutes_between, months_between
from tidemark.operators.market import best_territory
from tidemark.operators.opportunities import assess_contacts, expiry_days, opportunity_type, score
from tidemark.operators.resolution import crm_matches

PRIVATE_CONFIDENCE, LEAST_SCORE, LEAST_STRENGTH_DAYS = 0.85, 40, 365
#: What an opportunity's type is called.
LABELS = {
    "NEW_FSBO": "Nieuwe particuliere verkoop", "PRIVATE_PRICE_DROP": "Prijsdaling particulier", "PRIVATE_MULTIPLE_PRICE_DROP": "Meerdere prijsdalingen", "STALE_FSBO": "Lang online", "PRIVATE_RELIST": "Herplaatst", "AGENCY_TO_PRIVATE": "Van makelaar naar particulier",
    "DORMANT_VALUATION_LEAD": "Slapende schattingsaanvraag", "FORMER_SELLER_PROSPECT": "Vroegere verkoopprospect", "LOST_MANDATE": "Verloren mandaat", "FORMER_CLIENT": "Oud-klant", "PREVIOUS_BUYER": "Eerdere koper", "UNCONTACTED_LEAD": "Nooit opgevolgd",
}


def label_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), kind), kind)


def confident_private(kind: Column, confidence: Column) -> Column:
    return F.coalesce((kind == "private") & (confidence >= PRIVATE_CONFIDENCE), F.lit(False))


def signals() -> Column:
    """What was seen, before any weighing: (kind, code, strength), strengths at most 1."""
    c = F.col
    one = lambda kind, code, strength, cond: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.least(F.lit(1.0), strength.cast("double")).alias("strength")))
    return F.array_compact(
        F.array(
            one("market", "seller_type", c("seller_confidence"), F.lit(True)), one("market", "price_drops", c("drop_count") / 3, c("drop_count") > 0), one("market", "days_on_market", c("days_on_market") / 120, c("days_on_market") >= 30),
            one("market", "relisted", F.lit(1), c("is_relisted")), one("crm", "crm_match", c("match_confidence"), c("match_confidence").isNotNull()), one("crm", "known_owner", F.lit(1), c("is_known_owner")),
        )
    )


def contact_states(contacts: DataFrame, interactions: DataFrame, now: Column) -> DataFrame:
    """What the score asks of a contact; interactions are rolled up before the join."""
    rolled = interactions.groupBy("contact_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "VALUATION").alias("valued"))
    c = contacts.join(rolled, "contact_id", "left")
    return c.select(
        "contact_id", months_between(F.col("last_contact_at"), now).alias("silent_months"), months_between(F.col("created_at"), now).alias("relationship_months"), ((F.col("contact_type") == "VALUATION_LEAD") | F.coalesce("valued", F.lit(False))).alias("had_valuation"),
        ((F.col("status") == "WON") | (F.col("contact_type") == "FORMER_CLIENT")).alias("was_client"), (F.col("n").isNull() & F.col("last_contact_at").isNull()).alias("never_contacted"),
    )


def opportunities_of_events(events: DataFrame, listings: DataFrame, territories: DataFrame, contacts: DataFrame, interactions: DataFrame, now: Column, least_score: int = LEAST_SCORE, with_reasons: bool = True) -> DataFrame:
    """One row per agency and property: the strongest reason to call now, with score, signals and expiry.

    events: listing_id, type, dedupe_key. listings: listing_id, property_id, seller_type,
    seller_confidence, seller_name, phone, email, match_key, postal_code, municipality, province,
    price, drop_count, is_relisted, first_seen. contacts: as for ``crm_matches`` with contact_type,
    status, created_at and last_contact_at. Agencies are those with a territory there; a contact
    counts only within its agency; opportunities under ``least_score`` aren't made.
    """
    kind = opportunity_type(F.col("type"), confident_private(F.col("seller_type"), F.col("seller_confidence")), F.col("drop_count"))
    # Events of one listing and type differ in their keys alone, and the greatest is kept below.
    found = events.groupBy("listing_id", "type").agg(F.max("dedupe_key").alias("event_key")).join(listings, "listing_id").withColumn("type", kind).where("type is not null").drop("match_key", "email", "seller_name")
    # What depends on the listing alone is settled once for each, not for each event.
    wanted = listings.join(found.select("listing_id").distinct(), "listing_id", "left_semi")
    served = best_territory(wanted.select(F.col("listing_id").alias("place_id"), F.col("postal_code").alias("postal"), F.col("municipality").alias("city"), "province"), territories)
    served = served.select(F.col("place_id").alias("listing_id"), "agency_id", "territory_id", F.col("kind").alias("territory"))
    market = wanted.select(F.col("listing_id").alias("market_id"), "match_key", "phone", "email", F.col("seller_name").alias("name"), "postal_code")
    matched = crm_matches(market, contacts).join(contact_states(contacts, interactions, now), "contact_id")
    matched = matched.select(F.col("market_id").alias("listing_id"), "agency_id", "contact_id", F.col("confidence").alias("match_confidence"), "confirmed", "known_owner", "silent_months", "relationship_months", "had_valuation", "was_client", "never_contacted")
    sure = F.coalesce("confirmed", F.lit(False))
    rows = found.join(served.join(matched, ["listing_id", "agency_id"], "left"), "listing_id")
    context = rows.withColumns(
        {
            "origin": F.when(sure, "CROSS").otherwise("MARKET"), "has_phone": F.col("phone").isNotNull(), "minutes_since_seen": minutes_between(F.col("first_seen"), now), "days_on_market": days_between(F.col("first_seen"), now), "has_crm_match": sure,
            "crm_confidence": F.when(sure, F.col("match_confidence")).otherwise(0.0), "is_known_owner": sure & F.coalesce("known_owner", F.lit(False)), **{c: F.coalesce(c, F.lit(False)) for c in ("had_valuation", "was_client", "never_contacted")},
        }
    )
    scored = score(context.withColumn("territory_kind", F.col("territory")).withColumn("signals", signals()), with_reasons).where(F.col("score") >= least_score)
    best = F.struct("score", "type", "event_key")
    kept = (*(["reasons"] if with_reasons else []), "type", "score", "origin", "contact_id", "territory_id", "territory_kind", "listing_id", "event_key", "signals")
    one = scored.groupBy("agency_id", "property_id").agg(F.max_by(F.struct(*kept), best).alias("o")).select("agency_id", F.concat(F.lit("property:"), F.col("property_id").cast("string")).alias("dedupe_key"), "o.*")
    return one.withColumn("expires_at", now + F.make_dt_interval(expiry_days(F.col("type"))))


def revive(contacts: DataFrame, interactions: DataFrame, territories: DataFrame, now: Column, least_score: int = LEAST_SCORE) -> DataFrame:
    """Opportunities of silent contacts of all agencies at once: agency_id, dedupe_key, type, score, contact_id.

    contacts: those of ``assess_contacts`` with agency_id, phone, postal_code, municipality, province.
    """
    assessed = assess_contacts(contacts, interactions, now).where("opportunity_type is not null")
    own = best_territory(assessed.select(F.col("contact_id").alias("place_id"), F.col("postal_code").alias("postal"), F.col("municipality").alias("city"), "province"), territories).select(F.col("place_id").alias("contact_id"), "agency_id", F.col("kind").alias("territory"))
    no, none = F.lit(False), F.lit(None).cast("int")
    context = assessed.join(own, ["contact_id", "agency_id"], "left").withColumns(
        {
            "origin": F.lit("LEADREVIVE"), "type": F.col("opportunity_type"), "seller_type": F.lit("unknown"), "seller_confidence": F.lit(0.0), "has_phone": F.col("phone").isNotNull(), "minutes_since_seen": none, "days_on_market": none, "drop_count": F.lit(0), "is_relisted": no, "price": none,
            "has_crm_match": F.lit(True), "crm_confidence": F.lit(1.0), "is_known_owner": F.arrays_overlap("roles", F.array(*map(F.lit, ("OWNER", "FORMER_OWNER", "SELLER", "VALUATION_SUBJECT")))), "was_client": (F.col("status") == "WON") | (F.col("contact_type") == "FORMER_CLIENT"), "had_valuation": F.col("had_valuation") | (F.col("contact_type") == "VALUATION_LEAD"),
        }
    )
    key = F.concat(F.lit("revive:"), F.col("contact_id").cast("string"), F.lit(":"), F.col("type"))
    return score(context, with_reasons=False).where(F.col("score") >= least_score).select("agency_id", key.alias("dedupe_key"), "type", "score", "contact_id")


def dormant_signals(contacts: DataFrame, now: Column, dormant_days: int = LEAST_STRENGTH_DAYS) -> DataFrame:
    """(contact_id, type, strength, silence_days) by days of silence: the first rule that fits, or no row.

    contacts: contact_id, contact_type, status, created_at, last_contact_at, interactions (count),
    has_property. Silence counts from the last contact, or else from the creation.
    """
    c = F.col
    silence = days_between(F.coalesce("last_contact_at", "created_at"), now)
    rows = contacts.where(F.coalesce("last_contact_at", "created_at").isNotNull()).withColumn("silence_days", silence).withColumn("years", F.floor(c("silence_days") / 365))
    dormant, kind = c("silence_days") >= dormant_days, c("contact_type")
    rule = lambda cond, name, strength: (cond, F.struct(F.lit(name).alias("type"), F.round(strength, 6).alias("strength")))
    rules = [
        rule((c("interactions") == 0) & c("last_contact_at").isNull() & dormant, "UNCONTACTED_LEAD", F.lit(0.7)), rule((kind == "VALUATION_LEAD") & dormant, "DORMANT_VALUATION_LEAD", F.lit(0.85)), rule((kind == "SELLER") & (c("status") == "LOST") & c("has_property"), "LOST_MANDATE", F.lit(0.75)),
        rule((kind == "SELLER") & dormant, "FORMER_SELLER_PROSPECT", F.lit(0.7)), rule((kind == "BUYER") & (c("years") >= 5), "PREVIOUS_BUYER", F.least(F.lit(0.8), 0.45 + c("years") * 0.05)), (kind == "BUYER", F.lit(None)),
        rule(((kind == "FORMER_CLIENT") | (c("status") == "WON")) & dormant, "FORMER_CLIENT", F.lit(0.6)), rule(dormant & c("has_property") & kind.isin("LANDLORD", "PROSPECT"), "FORMER_SELLER_PROSPECT", F.lit(0.5)),
    ]
    found = F.when(*rules[0])
    for cond, value in rules[1:]:
        found = found.when(cond, value)
    return rows.withColumn("s", found).where("s is not null").select("contact_id", "s.type", "s.strength", "silence_days")
