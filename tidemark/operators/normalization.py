"""Raw listings and contacts to the form that matching, events and scoring work on: one projection each, dealt over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.places import city_of, is_province, parse_address
from tidemark.functions.scalars import contact_date, match_key, phone_e164, phone_is_mobile, phones_in, postal_code, property_class, province_of, stable_hash, valid_price
from tidemark.functions.spread import dealt
from tidemark.functions.text import clean, name_key, normalize_text, text_or_empty

#: Words by which a contact's type is told, in the order in which they are tried.
CONTACT_TYPES = (
    ("VALUATION_LEAD", ("schatting", "waardebepaling", "valuation", "estimation", "expertise")),
    ("SELLER", ("verkoper", "verkoop", "vendeur", "seller", "vendre", "te koop")),
    ("BUYER", ("koper", "aankoop", "acheteur", "buyer", "zoeker", "kandidaat koper")),
    ("LANDLORD", ("verhuurder", "eigenaar verhuur", "bailleur", "landlord")),
    ("TENANT", ("huurder", "locataire", "tenant")),
    ("FORMER_CLIENT", ("oud klant", "ex klant", "former client", "ancien client", "klant")),
    ("PROSPECT", ("prospect", "lead", "interesse", "contact")),
)
#: Words by which a contact's status is told.
CONTACT_STATUSES = (
    ("WON", ("gewonnen", "won", "klant geworden", "verkocht", "sold", "mandaat")),
    ("LOST", ("verloren", "lost", "afgewezen", "geen interesse", "perdu")),
    ("DORMANT", ("slapend", "dormant", "inactief", "inactive")),
    ("ACTIVE", ("actief", "active", "lopend", "open")),
)
#: The role of a contact towards a property.
ROLES = {"SELLER": "SELLER", "VALUATION_LEAD": "VALUATION_SUBJECT", "FORMER_CLIENT": "FORMER_OWNER", "LANDLORD": "OWNER", "TENANT": "TENANT", "BUYER": "BUYER", "PROSPECT": "INTERESTED", "UNKNOWN": "INTERESTED"}
HASHED = ("title", "description", "price", "listing_type", "property_type", "address", "postal_code", "city", "bedrooms", "surface", "seller_name", "seller_phone", "seller_type_hint")


def first_kind(c: Column, kinds: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    n, out = normalize_text(c), F.lit("UNKNOWN")
    for kind, words in reversed(kinds):
        out = F.when(n.rlike("|".join(words)), kind).otherwise(out)
    return out


def contact_type(c: Column) -> Column:
    return first_kind(c, CONTACT_TYPES)


def contact_status(c: Column) -> Column:
    return first_kind(c, CONTACT_STATUSES)


def role_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), kind)


def best_phone(direct: Column, text: Column) -> Column:
    """The number of its own field, else the first mobile one of the text, else its first."""
    found = phones_in(text)
    return F.coalesce(phone_e164(direct), F.try_element_at(F.filter(found, phone_is_mobile), F.lit(1)), F.try_element_at(found, F.lit(1)))


def normalize_listings(raw: DataFrame) -> DataFrame:
    """Listings with typed fields, derived city and province, content_hash and match_key.

    raw: listing_id, title, description, price, currency, listing_type, property_type, address,
    postal_code, city, province, bedrooms, surface, seller_name, seller_phone, seller_type_hint;
    all may be null. The source's own field comes first, then the address line, then the title or,
    for the city, the postal code.
    """
    c = F.col
    rows = parse_address(dealt(raw), c("address"), "_a").withColumn("_postal", F.coalesce(postal_code(c("postal_code")), c("_a.postal"), postal_code(c("title"))))
    rows = rows.withColumn("_city", F.coalesce(clean(c("city")), c("_a.city"), city_of(c("_postal"))))
    rows = rows.withColumn("_phone", best_phone(c("seller_phone"), F.concat_ws(" ", text_or_empty(c("title")), text_or_empty(c("description")))))
    declared = F.replace(normalize_text(c("province")), F.lit(" "), F.lit("-"))
    out = rows.select(
        "listing_id", clean(c("title")).alias("title"), clean(c("description")).alias("description"), valid_price(c("price")).alias("price"), F.upper(F.coalesce("currency", F.lit("EUR"))).alias("currency"),
        F.coalesce("listing_type", F.lit("sale")).alias("listing_type"), property_class(F.coalesce("property_type", "title")).alias("property_type"),
        F.coalesce("_a.address", F.nullif(F.concat_ws(" ", "_postal", "_city"), F.lit(""))).alias("address"), c("_a.street").alias("street"), c("_a.number").alias("house_number"), c("_postal").alias("postal_code"), c("_city").alias("city"),
        F.coalesce(province_of(c("_postal")), F.when(is_province(declared), declared)).alias("province"), c("bedrooms").cast("int").alias("bedrooms"), c("surface").cast("int").alias("surface"), clean(c("seller_name")).alias("seller_name"),
        c("_phone").alias("seller_phone"), F.coalesce(phone_is_mobile(c("_phone")), F.lit(False)).alias("phone_is_mobile"), F.coalesce("seller_type_hint", F.lit("unknown")).alias("seller_type_hint"),
    )
    return out.withColumn("content_hash", stable_hash({f: c(f) for f in HASHED})).withColumn("match_key", match_key(c("postal_code"), c("street"), c("house_number")))


def normalize_contacts(raw: DataFrame) -> DataFrame:
    """Contacts with keys to match by, type, status, role and whether there is enough to use them.

    raw: contact_id, first_name, last_name, display_name, email, phone, address, postal_code, city,
    contact_type, lead_type, status, created_at, last_contact_at; all strings that may be null.
    """
    c = F.col
    rows = parse_address(dealt(raw), c("address"), "_a").withColumn("_postal", F.coalesce(postal_code(c("postal_code")), c("_a.postal")))
    name = F.coalesce(clean(c("display_name")), F.nullif(F.concat_ws(" ", clean(c("first_name")), clean(c("last_name"))), F.lit("")))
    kind = contact_type(F.coalesce("contact_type", "lead_type"))
    out = rows.select(
        "contact_id", name.alias("display_name"), F.lower(clean(c("email"))).alias("email"), phone_e164(clean(c("phone"))).alias("phone"), name_key(name).alias("name_key"), c("_postal").alias("postal_code"),
        F.coalesce(clean(c("city")), c("_a.city"), city_of(c("_postal"))).alias("city"), province_of(c("_postal")).alias("province"), match_key(c("_postal"), c("_a.street"), c("_a.number")).alias("address_key"),
        kind.alias("contact_type"), contact_status(c("status")).alias("status"), role_of(kind).alias("role"), contact_date(c("created_at")).alias("created_at"), contact_date(c("last_contact_at")).alias("last_contact_at"),
    )
    return out.withColumn("usable", c("phone").isNotNull() | c("email").isNotNull() | F.coalesce(F.length("name_key") >= 3, F.lit(False)))


def territory_values(c: Column, kind: str) -> Column:
    """The distinct values of a territory's input line, or null for all if one of them is no good."""
    parts = F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[,;\s]+" if kind == "postal" else r"[,;\n]+"), lambda p: F.trim(p) != ""))
    folded = F.transform(parts, lambda p: F.trim(p) if kind == "postal" else normalize_text(p) if kind == "city" else F.replace(normalize_text(p), F.lit(" "), F.lit("-")))
    good = F.forall(folded, lambda p: p.rlike("^[1-9][0-9]{3}$")) if kind == "postal" else F.forall(folded, lambda p: p != "") if kind == "city" else F.forall(folded, is_province)
    return F.when(good, F.array_distinct(folded))
