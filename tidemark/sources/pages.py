"""Structured data of web pages as variants: blocks of any nesting, fields that may be arrays, and the listings in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import european_number
from tidemark.operators.upkeep import settled

#: Schema.org types of listings.
LISTING_TYPES = ("RealEstateListing", "Product", "Offer", "Residence", "House", "Apartment", "SingleFamilyResidence")


def linked_data(html: Column) -> Column:
    """JSON-LD blocks of a page as strings."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))), lambda b: b != "")


def whole(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def kind_of(v: Column) -> Column:
    """STRING, OBJECT<...>, ARRAY<...>, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID."""
    return F.schema_of_variant(v)


def data_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, path, node): the objects of each page's blocks; arrays and @graph are opened, whatever their depth.

    ``path`` holds the places that lead to the node, so ordering by it is the order in the page. Blocks
    that aren't JSON, and values that aren't objects, are passed over. One round per level of nesting.
    """
    blocks = pages.select(key, "url", F.posexplode(linked_data(F.col("html"))).alias("at", "text"))
    level = blocks.select(key, "url", F.array("at").alias("path"), F.try_parse_json("text").alias("node")).where("node is not null")
    found = []
    while True:
        inner = F.coalesce(whole(F.col("node"), "array<variant>"), F.try_variant_get("node", "$['@graph']", "array<variant>"))
        opened = level.withColumn("inner", inner)
        found.append(opened.where(F.col("inner").isNull() & kind_of(F.col("node")).startswith("OBJECT")).drop("inner"))
        level = opened.where("inner is not null").select(key, "url", "path", F.posexplode("inner").alias("at", "node")).select(key, "url", F.concat("path", F.array("at")).alias("path"), "node")
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def types_of(node: Column) -> Column:
    """The node's types in lower case; it may name one or several."""
    one = F.try_variant_get(node, "$['@type']", "variant")
    many = F.coalesce(whole(one, "array<variant>"), F.array(one))
    return F.array_compact(F.transform(many, lambda t: F.when(kind_of(t) == "STRING", F.lower(whole(t, "string")))))


def picked(node: Column, *path: str) -> Column:
    """The value under the fields of ``path``; where one is an array, its first value goes on."""
    for name in path:
        node = F.try_variant_get(F.coalesce(F.try_variant_get(node, "$[0]", "variant"), node), f"$['{name}']", "variant")
    return node


def picked_text(node: Column, *path: str) -> Column:
    """A string or number as text; empty is null, and so is anything else."""
    v = picked(node, *path)
    return F.when(kind_of(v).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), F.nullif(F.trim(whole(v, "string")), F.lit("")))


def picked_number(node: Column, *path: str) -> Column:
    """A number as it is, or one that is written in a text."""
    v = picked(node, *path)
    return F.when(kind_of(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), whole(v, "double")).otherwise(european_number(picked_text(node, *path)))


def listings_of_pages(pages: DataFrame) -> DataFrame:
    """One row per page with a listing in its structured data: the first node of a listing type, by its place.

    Columns: page_id, url, listing_id, title, description, price, currency, property_type, address, postal_code,
    city, bedrooms, surface, seller_name, seller_phone, published_at. Without sku, identifier or @id the last part of the address is the id.
    """
    wanted = F.array(*(F.lit(t.lower()) for t in LISTING_TYPES))
    n = F.col("node")
    typed = data_nodes(pages).where(F.arrays_overlap(types_of(n), wanted))
    first = typed.groupBy("page_id").agg(F.min_by(F.struct("url", "node"), "path").alias("f")).select("page_id", "f.url", "f.node")
    text = lambda *paths: F.coalesce(*(picked_text(n, *p.split(".")) for p in paths))
    number = lambda *paths: F.coalesce(*(picked_number(n, *p.split(".")) for p in paths))
    last_part = F.nullif(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+)/*$", 1), F.lit(""))
    place = F.nullif(F.concat_ws(" ", text("address.postalCode"), text("address.addressLocality")), F.lit(""))
    return first.select(
        "page_id", "url", F.coalesce(text("sku", "identifier", "@id"), last_part).alias("listing_id"), text("name").alias("title"), text("description").alias("description"), number("offers.price", "price", "offers.lowPrice").alias("price"), F.coalesce(text("offers.priceCurrency"), F.lit("EUR")).alias("currency"),
        text("additionalType", "@type").alias("property_type"), F.nullif(F.concat_ws(", ", text("address.streetAddress"), place), F.lit("")).alias("address"), text("address.postalCode").alias("postal_code"), text("address.addressLocality").alias("city"), number("numberOfBedrooms", "numberOfRooms").alias("bedrooms"),
        number("floorSize.value").alias("surface"), text("offers.seller.name", "seller.name").alias("seller_name"), text("offers.seller.telephone", "telephone").alias("seller_phone"), F.try_to_timestamp(text("datePosted", "datePublished")).alias("published_at"),
    )


def canonical(url: Column) -> Column:
    """An address without fragment, scheme and host in lower case; an empty path is the root."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_extract(bare, "^([A-Za-z]+://[^/?]+)", 1)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.concat(F.lower(host), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def reached(pages: DataFrame, links: DataFrame, roots: DataFrame, depth: int, key: str = "page_id") -> DataFrame:
    """(key, depth): the pages that links lead to from the roots, and after how many steps at least.

    pages: key, url. links: key, link. Each step is a join of the last step's pages with their links and an
    anti-join with what was visited, on canonical addresses; steps end when nothing new is found or at
    ``depth``. Pages of one address are one place.
    """
    at = pages.select(key, canonical(F.col("url")).alias("place"))
    leads = settled(links.join(at, key).select("place", canonical(F.col("link")).alias("to")).distinct().join(at.select(F.col("place").alias("to")).distinct(), "to").where("place <> to"), needed=True)
    visited = last = settled(at.join(roots.select(key), key, "left_semi").select("place").distinct().withColumn("depth", F.lit(0)), needed=True)
    for step in range(1, depth + 1):
        found = leads.join(last.select("place"), "place").select(F.col("to").alias("place")).distinct().join(visited, "place", "left_anti")
        last = settled(found.withColumn("depth", F.lit(step)), needed=True)
        if last.isEmpty():
            break
        visited = visited.union(last)
    return at.join(visited, "place").select(key, "depth")
