import json

from pyspark.sql import functions as F

from tidemark.operators import market
from tidemark.sources import files
from tidemark.sources import pages as pages_
from tidemark.streaming import ingest


def test_contacts_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿Naam;E-mail;Telefoon;Opmerking\n"Peeters; Jan";a@b.c;0475;"twee\nregels"\nMarie;;;\n;;;\n', encoding="utf-8")
    got = files.read_contacts(spark, str(tmp_path / "c.csv")).orderBy("last_name").collect()
    assert [r["last_name"] for r in got] == ["Marie", "Peeters; Jan"]
    assert got[1]["notes"] == "twee regels" and got[0]["email"] is None


def test_headers_of_three_languages():
    assert files.infer_fields(["voornaam", "achternaam", "e mail", "gsm", "gemeente"]) == ["first_name", "last_name", "email", "phone", "city"]
    assert files.infer_fields(["telefoon", "telefoon 2", "tel prive"]) == ["phone", None, None]
    assert files.infer_fields(["voornaam", "interne kolom xyz", "", "leadtype", "makelaar", "naam", "date de creation"])[0] == "first_name"
    assert files.infer_fields(["interne kolom xyz", ""]) == [None, None]


def test_files_with_their_own_headers_and_malformed_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('Klantnummer,Prenom,Ville\n1,Luc,"Gent, Oost"\n\n2,Ann\n3,Jo,Luik,extra\n', encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text('first name|email\n"O ""B"""|x@y.z\n', encoding="utf-8")
    got = {(r.file[-5:], r.row_number): r for r in files.read_contacts(spark, str(tmp_path / "in")).collect()}
    assert {k: (r.malformed, r.external_id, r.first_name, r.city, r.email) for k, r in got.items()} == {
        ("a.csv", 2): (False, "1", "Luc", "Gent, Oost", None), ("a.csv", 3): (True, "2", "Ann", None, None), ("a.csv", 4): (True, "3", "Jo", "Luik", None), ("b.csv", 2): (False, None, 'O "B"', None, "x@y.z"),
    }


def test_listings_json(spark, tmp_path):
    rows = [{"sourceListingId": "a", "url": "https://x/a", "price": "€ 250.000".replace(".", ""), "bedrooms": "3"}, {"url": "https://x/b"}, {"sourceListingId": "c", "url": "nowhere"}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    good, bad = files.read_listings(spark, str(tmp_path / "l.json"), "made")
    assert [(r["sourceListingId"], r["price"], r["bedrooms"]) for r in good.collect()] == [("a", 250000, 3)]
    assert bad.count() == 2
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.json").write_text(json.dumps(rows))
    (tmp_path / "more" / "b.json").write_text('[{"sourceListingId": "x", ')
    good, bad = files.read_listings(spark, str(tmp_path / "more"), "made")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no id", "not JSON", "url isn't one"]


def test_structured_data(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Person"}, {"@type": "House", "sku": "h1", "offers": {"price": "199000"}}]}</script>'
    pages = spark.createDataFrame([(1, "https://x/p/9", html), (2, "https://x/q", "<p>")], "page_id long, url string, html string")
    assert [(r["page_id"], r["listing_id"], r["price"]) for r in pages_.listings_of_pages(pages).collect()] == [(1, "h1", 199000)]


def test_stream_gives_what_a_replay_gives(spark, tmp_path):
    rows = [(i % 3, f"2026-01-{1 + i // 3:02d} 00:00:00", 100_000 - 3_000 * (i // 5), "private" if i % 7 else "professional") for i in range(60)]
    o = spark.createDataFrame(rows, "listing_id long, at string, price long, seller_type string").select("listing_id", F.col("at").cast("timestamp").alias("observed_at"), "price", "seller_type")
    for k in range(2):
        o.where(F.floor((F.day("observed_at") - 1) / 10) == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(o.schema).parquet(str(tmp_path / "in" / "*"))
        query = ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
    got = ingest.Market(spark, str(tmp_path / "out")).events().select("dedupe_key")
    want = market.detect_events(market.history(o)).select("dedupe_key")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
