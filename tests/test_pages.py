"""Structured data of pages: nesting, order, fields that are arrays, broken blocks."""

import json

from tidemark.sources import pages


def page(*blocks, quote='"'):
    return "".join(f"<p><script data-x=1 type={quote}application/ld+json{quote}>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks)


def one(spark, html, url="https://x/p/9"):
    rows = pages.listings_of_pages(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).collect()
    return rows[0] if rows else None


def test_nodes_of_any_depth_in_order(spark):
    block = [{"@type": "Person", "n": 0}, {"@graph": [[{"n": 1}], {"@graph": [{"n": 2}, 5, None]}]}, [[[{"n": 3}]]], "text"]
    table = spark.createDataFrame([(1, "u", page("{broken", block, {"n": 4}))], "page_id long, url string, html string").repartition(3)
    nodes = pages.data_nodes(table).select("path", pages.picked_number(pages.F.col("node"), "n").alias("n")).orderBy("path").collect()
    assert [r.n for r in nodes] == [0, 1, 2, 3, 4]


def test_listing_with_arrays_and_written_numbers(spark):
    house = {
        "@type": ["Thing", "HOUSE"], "sku": " h1 ", "name": "Huis", "offers": [{"price": "€ 495.000", "priceCurrency": "EUR", "seller": {"name": "Jan", "telephone": 475}}, {"price": 1}],
        "address": {"streetAddress": "Kerkstraat 1", "postalCode": 9000, "addressLocality": "Gent"}, "floorSize": {"value": "120,5"}, "numberOfRooms": 3, "datePosted": "2026-01-02T03:04:05Z",
    }
    r = one(spark, page({"@graph": [{"@type": "WebPage"}, house]}, quote="'"))
    assert (r.listing_id, r.title, r.price, r.address, r.surface, r.bedrooms, r.seller_name, r.seller_phone) == ("h1", "Huis", 495000.0, "Kerkstraat 1, 9000 Gent", 120.5, 3.0, "Jan", "475")
    assert r.published_at is not None


def test_first_listing_node_wins_and_ids_fall_back(spark):
    r = one(spark, page("<![CDATA[" + json.dumps([{"@type": "Offer", "price": 1.234}, {"@type": "House", "sku": "b"}]) + "]]>"), "https://x/a/77/?q=1")
    assert (r.listing_id, r.price, r.currency) == ("77", 1.234, "EUR")
    assert one(spark, page({"@type": "Person"}, {"@type": True}, [], {})) is None
    assert one(spark, None) is None
