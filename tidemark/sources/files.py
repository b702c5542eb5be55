"""Sources: listing JSON, contact CSV, links of web pages."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import loose_number, valid_price
from tidemark.functions.text import clean, normalize_text

LISTING = "sourceListingId string, url string, title string, description string, price string, currency string, listingType string, propertyType string, address string, postalCode string, city string, province string, bedrooms string, surfaceArea string, sellerName string, sellerPhone string, sellerTypeHint string, publishedAt string"


def read_listings(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a JSON array of listings: without id or url a row is rejected, with its ``reason``; a bad optional value is null.

    A file that isn't JSON gives one rejected row, and the other files go on.
    """
    raw = spark.read.schema(f"{LISTING}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    whole = lambda c, low, high: F.when(loose_number(F.col(c)).between(low, high), F.floor(loose_number(F.col(c)) + 0.5).cast("int"))
    typed = raw.select(
        F.lit(source).alias("source"), *(clean(F.col(c)).alias(c) for c in ("sourceListingId", "url", "title", "description", "propertyType", "address", "postalCode", "city", "province", "sellerName", "sellerPhone")),
        valid_price(F.col("price")).alias("price"), F.coalesce(F.upper(clean(F.col("currency"))), F.lit("EUR")).alias("currency"), F.when(F.col("listingType") == "rent", "rent").otherwise("sale").alias("listingType"),
        whole("bedrooms", 0, 50).alias("bedrooms"), whole("surfaceArea", 1, 100_000).alias("surfaceArea"), F.when(F.col("sellerTypeHint").isin("private", "professional"), F.col("sellerTypeHint")).otherwise("unknown").alias("sellerTypeHint"), F.try_to_timestamp("publishedAt").alias("publishedAt"), "_broken",
    )
    reason = F.when(F.col("_broken").isNotNull() & F.col("sourceListingId").isNull(), "not JSON").when(F.col("sourceListingId").isNull(), "no id").when(F.col("url").isNull(), "no url").when(~F.col("url").rlike("^https?://"), "url isn't one")
    told = typed.withColumn("reason", reason).drop("_broken")
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


DELIMITERS = (";", ",", "\t", "|")
#: Fields in their order, with the header texts that name them in Dutch, French and English.
HEADERS = {
    "external_id": ("id", "contact id", "contactid", "klantnummer", "referentie", "reference", "nr"),
    "first_name": ("voornaam", "first name", "firstname", "prenom"),
    "last_name": ("achternaam", "naam", "last name", "lastname", "nom", "familienaam"),
    "display_name": ("volledige naam", "full name", "fullname", "contact", "nom complet", "display name"),
    "email": ("email", "e-mail", "mail", "emailadres", "courriel"),
    "phone": ("telefoon", "tel", "gsm", "mobiel", "phone", "telephone", "mobile"),
    "address": ("adres", "straat", "address", "adresse", "rue", "street"),
    "postal_code": ("postcode", "postal code", "zip", "code postal", "cp"),
    "city": ("gemeente", "stad", "city", "plaats", "ville", "localite"),
    "contact_type": ("type", "contacttype", "soort", "categorie", "category"),
    "status": ("status", "statut", "staat"),
    "lead_type": ("leadtype", "lead type", "bron", "source", "interesse", "aanvraag"),
    "assigned_agent": ("makelaar", "agent", "verantwoordelijke", "eigenaar", "owner", "courtier"),
    "notes": ("notities", "notes", "opmerking", "opmerkingen", "remarque", "commentaar"),
    "created_at": ("aangemaakt", "created", "datum", "date", "created at", "aanmaakdatum"),
    "last_contact_at": ("laatste contact", "last contact", "laatst gecontacteerd", "dernier contact"),
}


def outside_quotes(line: str) -> str:
    return "".join(part for i, part in enumerate(line.split('"')) if i % 2 == 0)


def sniff(header: str) -> str:
    """The delimiter that the header line has most of outside quotes; ; without any."""
    counts = {d: outside_quotes(header).count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ";"


def infer_fields(headers: list[str]) -> list[str | None]:
    """The field of each column, header by header: the first unused one that has a text which the header contains.

    ``headers`` are normalised; an empty or unknown one gives None.
    """
    out: list[str | None] = []
    for header in headers:
        out.append(next((f for f, texts in HEADERS.items() if header and f not in out and any(t in header for t in texts)), None))
    return out


def header_lines(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(header line, files that have it): one row per file reaches the driver, as their names do for any reader."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr")).where("trim(value) <> ''")
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "nr")).alias("line"))
    return sorted((r["line"], sorted(r["files"])) for r in first.groupBy("line").agg(F.collect_list("file").alias("files")).collect())


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contacts of CSV files, each with its own header and any of four delimiters; quotes, line breaks in fields, ragged rows.

    Columns: file, row_number (2 is the first after the header, blank rows not counted), malformed (the row had more or fewer
    values than the header; it's filled up or cut), and the fields of HEADERS, empty ones null. Files of one header are
    read together, each by one task, as a line break may stand in a field.
    """
    fields = [f"{f} string" for f in HEADERS]
    out = spark.createDataFrame([], "file string, row_number int, malformed boolean, " + ", ".join(fields))
    for line, files in header_lines(spark, path):
        line = line.lstrip("\ufeff")
        delimiter = sniff(line)
        names = next(iter(csv.reader([line], delimiter=delimiter)))
        folded = spark.range(1).select(*(normalize_text(F.lit(n)).alias(f"h{k}") for k, n in enumerate(names))).first()
        mapped = {f: f"_c{k}" for k, f in enumerate(infer_fields(list(folded))) if f}
        schema = ", ".join(f"_c{k} string" for k in range(len(names))) + ", _bad string"
        rows = spark.read.schema(schema).csv(files, sep=delimiter, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", encoding="UTF-8")
        values = [clean(F.col(f"_c{k}")) for k in range(len(names))]
        numbered = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nr")).where(F.coalesce(*values).isNotNull())
        numbered = numbered.withColumn("row_number", F.row_number().over(Window.partitionBy("file").orderBy("nr"))).where("row_number > 1")
        out = out.union(numbered.select("file", "row_number", F.col("_bad").isNotNull().alias("malformed"), *((clean(F.col(mapped[f])) if f in mapped else F.lit(None).cast("string")).alias(f) for f in HEADERS)))
    return out


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): distinct links of each page to its own host, made absolute."""
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    found = pages.select("page_id", origin.alias("origin"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    link = F.when(F.col("href").startswith("/"), F.concat("origin", "href")).when(F.col("href").startswith(F.concat(F.col("origin"), F.lit("/"))), F.col("href"))
    return found.select("page_id", link.alias("link")).where("link is not null").distinct()
