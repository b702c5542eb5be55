"""Belgian places: the city of a postal code, address lines taken apart, what looks like a street."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import POSTAL_RANGES, postal_code
from tidemark.functions.text import clean, normalize_text

#: Cities of postal codes, in order of the code.
CITIES = {
    "1000": "Brussel", "1030": "Schaarbeek", "1040": "Etterbeek", "1050": "Elsene", "1060": "Sint-Gillis", "1070": "Anderlecht", "1080": "Sint-Jans-Molenbeek", "1082": "Sint-Agatha-Berchem", "1090": "Jette", "1140": "Evere",
    "1150": "Sint-Pieters-Woluwe", "1160": "Oudergem", "1170": "Watermaal-Bosvoorde", "1180": "Ukkel", "1190": "Vorst", "1200": "Sint-Lambrechts-Woluwe", "1210": "Sint-Joost-ten-Node", "1300": "Waver", "1310": "Terhulpen",
    "1340": "Ottignies-Louvain-la-Neuve", "1400": "Nijvel", "1410": "Waterloo", "1500": "Halle", "1600": "Sint-Pieters-Leeuw", "1700": "Dilbeek", "1800": "Vilvoorde", "1830": "Machelen", "1930": "Zaventem", "2000": "Antwerpen",
    "2018": "Antwerpen", "2020": "Antwerpen", "2030": "Antwerpen", "2050": "Antwerpen", "2060": "Antwerpen", "2100": "Deurne", "2140": "Borgerhout", "2170": "Merksem", "2180": "Ekeren", "2200": "Herentals", "2300": "Turnhout",
    "2400": "Mol", "2500": "Lier", "2600": "Berchem", "2610": "Wilrijk", "2800": "Mechelen", "2900": "Schoten", "2930": "Brasschaat", "3000": "Leuven", "3001": "Heverlee", "3010": "Kessel-Lo", "3200": "Aarschot", "3300": "Tienen",
    "3500": "Hasselt", "3600": "Genk", "3700": "Tongeren", "3800": "Sint-Truiden", "3900": "Pelt", "4000": "Luik", "4020": "Luik", "4100": "Seraing", "4500": "Hoei", "4600": "Wezet", "4700": "Eupen", "4800": "Verviers",
    "5000": "Namen", "5100": "Jambes", "5300": "Andenne", "5500": "Dinant", "6000": "Charleroi", "6040": "Jumet", "6200": "Châtelet", "6700": "Aarlen", "6800": "Libramont-Chevigny", "6900": "Marche-en-Famenne", "7000": "Bergen",
    "7100": "La Louvière", "7300": "Bergen", "7500": "Doornik", "7700": "Moeskroen", "8000": "Brugge", "8200": "Brugge", "8300": "Knokke-Heist", "8400": "Oostende", "8500": "Kortrijk", "8600": "Diksmuide", "8700": "Tielt",
    "8800": "Roeselare", "8900": "Ieper", "9000": "Gent", "9030": "Mariakerke", "9040": "Sint-Amandsberg", "9050": "Gentbrugge", "9100": "Sint-Niklaas", "9200": "Dendermonde", "9300": "Aalst", "9400": "Ninove",
    "9500": "Geraardsbergen", "9600": "Ronse", "9700": "Oudenaarde", "9800": "Deinze", "9900": "Eeklo",
}
PROVINCES = tuple(sorted({province for _, _, province in POSTAL_RANGES}))
#: Word parts that tell a street.
STREET_MARKERS = ("straat", "laan", "steenweg", "baan", "dreef", "plein", "weg", "kaai", "markt", "pad", "wal", "rue", "avenue", "chaussee", "boulevard", "place", "chemin", "route", "quai", "allee", "clos")
NUMBER_AT_END = r"(?i)\s([0-9]{1,4})\s*([a-z])?(?:\s*(?:/|bus|bte|boite|boîte|b)\s*[\w-]+)?\s*$"


def city_of(code: Column) -> Column:
    """City of a postal code that the table knows, else null."""
    table = F.create_map(*(F.lit(x) for pair in CITIES.items() for x in pair))
    return F.try_element_at(table, code)


def is_province(c: Column) -> Column:
    return F.coalesce(c.isin(*PROVINCES), F.lit(False))


def province_label(c: Column) -> Column:
    """Capitals at the start and after hyphens; a dash for nothing; unknown values as they are."""
    return F.when(F.coalesce(c, F.lit("")) == "", "—").when(is_province(c), F.replace(F.initcap(F.replace(c, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-"))).otherwise(c)


def looks_like_street(c: Column) -> Column:
    return normalize_text(c).rlike("|".join(STREET_MARKERS))


def parse_address(rows: DataFrame, line: Column, to: str) -> DataFrame:
    """Adds the struct ``to`` of address, street, number, postal and city; what can't be told is null.

    The part between commas that holds the postal code parts street from city: what stands before
    it is the street, or after it if it comes first; a line without commas is cut at the code. Each
    step is a column of its own, so that it's computed once.
    """
    c = F.col
    rows = rows.withColumn("_line", clean(F.regexp_replace(line, "[;|]", ",")))
    rows = rows.withColumns({"_code": postal_code(c("_line")), "_parts": F.filter(F.transform(F.split("_line", ","), lambda p: F.trim(p)), lambda p: p != "")})
    # The code is the line's first one, so the first part that holds one holds it.
    rows = rows.withColumn("_at", F.when(c("_code").isNotNull(), F.array_position(F.transform("_parts", lambda p: F.coalesce(postal_code(p), F.lit(""))), c("_code"))).cast("int"))
    many = F.size("_parts")
    part = lambda p: F.try_element_at("_parts", F.lit(p))
    street = (
        F.when(c("_code").isNull(), part(1)).when(c("_at") > 1, F.array_join(F.slice("_parts", F.lit(1), c("_at") - 1), " ")).when(many > 1, F.array_join(F.slice("_parts", F.lit(2), F.greatest(many - 1, F.lit(0))), " ")).otherwise(F.split_part(c("_line"), c("_code"), F.lit(1)))
    )
    held = F.try_element_at("_parts", F.greatest(c("_at"), F.lit(1)))
    town = F.when(c("_code").isNull(), F.when(many > 1, part(-1))).when(many > 1, F.concat(F.split_part(held, c("_code"), F.lit(1)), F.split_part(held, c("_code"), F.lit(2)))).otherwise(F.split_part(c("_line"), c("_code"), F.lit(2)))
    rows = rows.withColumns({"_street": clean(F.regexp_replace(street, r"^[-–—\s]+", "")), "_town": clean(F.regexp_replace(town, r"^[-–—,\s]+|[-–—,\s]+$", ""))})
    rows = rows.withColumns({"_number": F.regexp_extract("_street", NUMBER_AT_END, 1), "_suffix": F.upper(F.regexp_extract("_street", NUMBER_AT_END, 2)), "_name": clean(F.regexp_replace("_street", NUMBER_AT_END, ""))})
    numbered = (c("_number") != "") & (F.length("_name") >= 2)
    known_town = F.when((F.length("_town") >= 2) & ~c("_town").rlike("(?i)^(belgi[eë]|belgique|belgium)$") & ~c("_town").rlike("^[1-9][0-9]{3}$"), c("_town"))
    parsed = F.struct(c("_line").alias("address"), F.when(numbered, c("_name")).when(F.length("_street") >= 2, c("_street")).alias("street"), F.when(numbered, F.concat("_number", "_suffix")).alias("number"), c("_code").alias("postal"), known_town.alias("city"))
    return rows.withColumn(to, F.when(c("_line").isNotNull(), parsed)).drop("_line", "_code", "_parts", "_at", "_street", "_town", "_number", "_suffix", "_name")
