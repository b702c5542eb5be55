from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import text as T
from tidemark.operators import market, resolution


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text(spark):
    lit = F.lit
    assert one(spark, T.normalize_text(lit("  Crème-Brûlée, N° 5 "))) == "creme brulee n 5"
    assert one(spark, T.normalize_text(lit(None))) == ""
    assert one(spark, T.content_tokens(lit("De mooie villa in Gent"))) == ["villa", "gent"]
    assert one(spark, T.jaccard(lit("rode villa"), lit(""))) == 0
    assert one(spark, T.similarity(lit("Kerkstraat"), lit("Kerkstraad"))) == 0.9
    assert one(spark, T.truncate_text(lit("een heel lange tekst"), 15)) == "een heel lange…"
    assert one(spark, T.agency_name(lit("Immo Centrum BVBA"))) == "immo centrum"
    assert one(spark, T.clean(lit(" a   b "))) == "a b"
    assert one(spark, T.clean(lit("  "))) is None
    assert one(spark, T.is_poorer_name(lit("Jan Peeters"), lit("Peeters")))


def test_phones(spark):
    for written in ("0475 12 34 56", "+32 475 12 34 56", "0032475123456", "+32 (0)475/12.34.56", "475123456"):
        assert one(spark, S.phone_e164(F.lit(written))) == "+32475123456"
        assert one(spark, S.phone_is_mobile(F.lit(written)))
    assert one(spark, S.phone_e164(F.lit("12"))) is None
    assert one(spark, S.phone_is_mobile(F.lit("02 512 34 56"))) is False
    assert one(spark, S.phones_in(F.lit("bel 0475 12 34 56 of 0475/123456"))) == ["+32475123456"]


def test_places(spark):
    assert one(spark, S.postal_code(F.lit("Kerkstraat 12, B-9000 Gent"))) == "9000"
    assert one(spark, S.postal_code(F.lit("0999"))) is None
    assert one(spark, S.province_of(F.lit("9000"))) == "oost-vlaanderen"
    assert one(spark, S.match_key(F.lit("9000"), F.lit("Kerkstraat"), F.lit("12"))) == "9000:kerkstraat:12"
    assert one(spark, S.match_key(F.lit("9000"), F.lit(None), F.lit("12"))) is None


def test_dates(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, S.days_between(t("2026-01-01 23:59:59"), t("2026-01-02 00:00:01"))) == 0
    assert one(spark, S.months_between(t("2026-01-31"), t("2026-02-28"))) == 0
    assert one(spark, S.in_quiet_hours(F.lit(23), F.lit(22), F.lit(7)))
    assert not one(spark, S.in_quiet_hours(F.lit(23), F.lit(7), F.lit(7)))
    assert one(spark, S.hour_in_brussels(t("2026-07-01 10:00:00"))) == 12
    assert str(one(spark, S.contact_date(F.lit("03/04/2019")))) == "2019-04-03 00:00:00"


def test_numbers(spark):
    assert one(spark, S.valid_price(F.lit("€ 1500,50"))) == 1501
    assert one(spark, S.valid_price(F.lit("op aanvraag"))) is None
    assert one(spark, S.closeness(F.lit(100.0), F.lit(96.0), 0.08)) == 0.5
    assert one(spark, S.closeness(F.lit(None).cast("double"), F.lit(96.0), 0.08)) is None


def test_personal_names(spark):
    for name, personal in (("Jan Peeters", True), ("Immo De Meyer", False), ("IMMOPUNT", False), ("Marie van der Berg", False), ("An de Wit", True), (None, False)):
        assert one(spark, resolution.is_personal_name(F.lit(name).cast("string"))) is personal, name


def test_events(spark):
    rows = [(1, "2026-01-01", 495000, "private"), (1, "2026-01-05", 494000, "private"), (1, "2026-01-10", 464000, "private"), (1, "2026-04-06", 464000, "professional")]
    o = spark.createDataFrame(rows, "listing_id long, at string, price long, seller_type string").withColumn("observed_at", F.col("at").cast("timestamp")).drop("at")
    found = {r["type"]: r for r in market.detect_events(market.history(o)).collect()}
    assert set(found) == {"NEW_LISTING", "FSBO_DETECTED", "PRICE_DROP", "PRIVATE_TO_AGENCY", "STALE_30", "STALE_60", "STALE_90"}
    assert found["PRICE_DROP"]["absolute_drop"] == 30000
    assert found["PRICE_DROP"]["dedupe_key"] == "1:PRICE_DROP:494000:464000:2026-01-10"
    assert found["PRICE_DROP"]["percentage_drop"] == 6.07


def test_property_candidates_outside_the_block(spark):
    common = "match_key string, street string, house_number string, postal_code string, city string, property_type string, surface int, bedrooms int"
    listings = spark.createDataFrame(
        [(1, "a", "k1", "Kerkstraat", "1", "9000", "Gent", "house", 100, 2, None, None, None, 100.0), (2, "a", None, None, None, None, "Gent", "house", None, None, "+321", None, None, None), (3, "a", None, "Dorpstraat", "7", "8000", "Brugge", "house", 90, 2, None, None, None, None), (4, "a", *[None] * 12)],
        f"listing_id long, block string, {common}, phone string, title string, description string, price double",
    )
    known = spark.createDataFrame(
        [(11, "b", "k1", None, None, None, None, None, None, None, [], [], [], []), (12, "b", None, None, None, None, "Gent", "flat", None, None, ["+320", "+321"], [], [], []), (13, "b", None, "Dorpstraat", "7", "8000", "Brugge", "house", 90, 2, [], [], [], []), (14, "a", None, "Elders", None, None, None, "flat", None, None, [], [], [], [])],
        f"property_id long, block string, {common}, phones array<string>, titles array<string>, descriptions array<string>, prices array<double>",
    )
    got = {r["listing_id"]: (r["property_id"], r["decision"]) for r in resolution.match_properties(listings, known, ["block"]).collect()}
    assert got == {1: (11, "match"), 2: (12, "match"), 3: (13, "match"), 4: (None, "none")}
