"""Phone, place, number, date and hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_text

# -- phone ---------------------------------------------------------------------


def national_digits(c: Column) -> Column:
    """Digits after the country's or trunk prefix; null if it's no Belgian number."""
    trimmed = F.trim(c)
    digits = F.regexp_replace(F.regexp_replace(trimmed, r"\(\s*0\s*\)", ""), r"[^0-9]", "")
    plus = trimmed.rlike(r"^(\+|00)")
    after = (
        F.when(digits.startswith("0032"), F.substr(digits, F.lit(5)))
        .when(digits.startswith("32") & plus, F.substr(digits, F.lit(3)))
        .when(digits.startswith("0"), F.substr(digits, F.lit(2)))
        .when(~plus & F.length(digits).isin(8, 9), digits)
        .when(digits.startswith("32"), F.substr(digits, F.lit(3)))
    )
    national = F.regexp_replace(after, "^0+", "")
    return F.when((F.length(digits) >= 8) & F.length(national).isin(8, 9), national)


def phone_e164(c: Column) -> Column:
    return F.concat(F.lit("+32"), national_digits(c))


def phone_is_mobile(c: Column) -> Column:
    n = national_digits(c)
    return F.when(n.isNotNull(), (F.length(n) == 9) & n.rlike("^4[5-9][0-9]"))


PHONE_IN_TEXT = r"(?:\+32|0032|0)[\s./()-]*(?:[0-9][\s./()-]*){8,9}"


def phones_in(c: Column) -> Column:
    """Distinct e164 numbers of a text, in order."""
    found = F.regexp_extract_all(c, F.lit(f"({PHONE_IN_TEXT})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, phone_e164), lambda p: p.isNotNull()))


def mask_phone(c: Column) -> Column:
    return F.when(F.length(c) <= 8, c).otherwise(F.concat(F.substring(c, 1, 6), F.repeat(F.lit("•"), F.length(c) - 8), F.right(c, F.lit(2))))


# -- place ---------------------------------------------------------------------

#: Fixed values: (first, last, province) of the postal codes.
POSTAL_RANGES = (
    (1000, 1299, "brussels"), (1300, 1499, "waals-brabant"), (1500, 1999, "vlaams-brabant"), (2000, 2999, "antwerpen"), (3000, 3499, "vlaams-brabant"), (3500, 3999, "limburg"), (4000, 4999, "luik"),
    (5000, 5999, "namen"), (6000, 6599, "henegouwen"), (6600, 6999, "luxemburg"), (7000, 7999, "henegouwen"), (8000, 8999, "west-vlaanderen"), (9000, 9999, "oost-vlaanderen"),
)


def postal_code(c: Column) -> Column:
    """The first stand-alone number of four digits, if it's within 1000 to 9992."""
    found = F.regexp_extract(c, r"(?<![0-9])(?:[Bb]-?\s?)?([0-9]{4})(?![0-9])", 1)
    return F.when(F.try_to_number(F.nullif(found, F.lit("")), F.lit("9999")).between(1000, 9992), found)


def province_of(c: Column) -> Column:
    """Province of a postal code; a generated CASE, as there are thirteen closed ranges."""
    n, out = c.cast("int"), F.lit(None).cast("string")
    for first, last, province in reversed(POSTAL_RANGES):
        out = F.when(n.between(first, last), province).otherwise(out)
    return out


def match_key(postal: Column, street: Column, number: Column) -> Column:
    """postal:street:number, null unless all three are there."""
    parts = [F.nullif(normalize_text(p), F.lit("")) for p in (postal, street, number)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat_ws(":", *parts))


#: Property classes in the order in which they are tried.
PROPERTY_CLASSES = (
    ("land", "bouwgrond bouwland grond terrain terrein perceel land plot"),
    ("garage", "garage staanplaats parking parkeerplaats carport emplacement"),
    ("commercial", "handelspand handelsruimte winkelpand winkel kantoorruimte kantoor bedrijfspand bedrijfsgebouw magazijn loods horeca commerce bureau entrepot immeuble_de_rapport commercial office retail"),
    ("apartment", "appartement flat studio duplex triplex penthouse loft gelijkvloers assistentiewoning apartment condo"),
    ("house", "huis woning villa bungalow hoeve fermette chalet rijwoning burgerwoning herenhuis landhuis maison residence house home singlefamilyresidence townhouse"),
)


def property_class(c: Column) -> Column:
    n, out = normalize_text(c), F.lit("other")
    for name, needles in reversed(PROPERTY_CLASSES):
        out = F.when(n.rlike("|".join(needles.split()).replace("_", " ")), name).otherwise(out)
    return out


# -- numbers -------------------------------------------------------------------


def loose_number(c: Column) -> Column:
    """Digits, dots, commas and minus kept, the first comma a dot; null if that's no number."""
    kept = F.regexp_replace(c.cast("string"), r"[^0-9.,-]", "")
    return F.when(F.contains(kept, F.lit(",")), F.concat(F.substring_index(kept, ",", 1), F.lit("."), F.substr(kept, F.instr(kept, ",") + 1))).otherwise(kept).try_cast("double")


def valid_price(c: Column) -> Column:
    """Whole euros from over 0 to 100 million, halves up; else null."""
    n = loose_number(c)
    return F.when((n > 0) & (n <= 100_000_000), F.floor(n + 0.5).cast("int"))


def closeness(a: Column, b: Column, tolerance: float) -> Column:
    """1 for equal values, 0 from a relative difference of ``tolerance`` on; null unless both are over 0."""
    relative = F.abs(a - b) / F.greatest(a, b)
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - relative / tolerance))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


# -- dates ---------------------------------------------------------------------


def days_between(a: Column, b: Column) -> Column:
    """Whole elapsed days, not calendar days; at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_millis(b) - F.unix_millis(a)) / 86_400_000)).cast("int")


def minutes_between(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_millis(b) - F.unix_millis(a)) / 60_000)).cast("long")


def months_between(a: Column, b: Column) -> Column:
    """Calendar months, one less before the day of the month is reached; at least 0."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.day(b) < F.day(a), 1).otherwise(0)
    return F.greatest(F.lit(0), months)


def day_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def hour_in_brussels(c: Column) -> Column:
    return F.hour(F.from_utc_timestamp(c, "Europe/Brussels"))


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """Wraps midnight; equal bounds mean never."""
    return F.when(start == end, False).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def contact_date(c: Column) -> Column:
    """Day first, then ISO; null for neither."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"[.\-]", "/"), F.lit("d/M/yyyy")), F.try_to_timestamp(c))


# -- hashes --------------------------------------------------------------------


def stable_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields that aren't null or empty, by name, as k=v joined by |."""
    parts = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in sorted(fields.items())]
    return F.sha2(F.concat_ws("|", *parts), 256)


def add_days(c: Column, days: int) -> Column:
    return c + F.make_dt_interval(F.lit(days))


def end_of_day_in_brussels(c: Column) -> Column:
    """The last millisecond of a day written as YYYY-MM-DD, in UTC; null for a date that doesn't exist."""
    day = F.try_to_timestamp(F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c), F.lit("yyyy-MM-dd"))
    return F.to_utc_timestamp(day + F.make_dt_interval(F.lit(1)), "Europe/Brussels") - F.expr("INTERVAL '0.001' SECOND")


def relative_time(c: Column, now: Column) -> Column:
    """How long ago, in Dutch: minutes, hours, days up to 30, months of 30 days, years of 365."""
    minutes = minutes_between(c, now)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    months = F.floor(days / 30)
    says = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} geleden"))
    return F.when(minutes < 1, "zojuist").when(minutes < 60, says(minutes, "min")).when(hours < 24, says(hours, "u")).when(days < 31, says(days, "d")).when(months < 12, says(months, "mnd")).otherwise(says(F.floor(days / 365), "j"))


def european_number(c: Column) -> Column:
    """A number as written in Belgium: dots before three digits are dropped, a comma is the decimal sign."""
    kept = F.regexp_replace(c.cast("string"), r"[^0-9,.\-]", "")
    plain = F.when(F.contains(kept, F.lit(",")), F.regexp_replace(F.replace(kept, F.lit("."), F.lit("")), "^([^,]*),", "$1.")).otherwise(F.regexp_replace(kept, r"\.(?=[0-9]{3}\b)", ""))
    return F.nullif(plain, F.lit("")).try_cast("double")


def total_drop_percent(first: Column, current: Column) -> Column:
    return F.when((first > 0) & (current > 0) & (first > current), (first - current) / first * 100).otherwise(0.0)
