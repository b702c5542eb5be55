"""Queries over what lists and pages show: labels and masks, gaps that listings fill, medians, parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import NORMAL, NOW_SQL, days_sql, query
from tidemark.catalog_flow import pick, pick_sql
from tidemark.functions import places as P
from tidemark.functions import scalars as S
from tidemark.functions import text as T
from tidemark.operators import insight, market, resolution, serving, upkeep
from tidemark.plans import analogue as A

PROVINCES = ("oost-vlaanderen", "vlaams-brabant", "luik", "Elsewhere", "", None)
LABELLED = ("Oost-Vlaanderen", "Vlaams-Brabant", "Luik", "Elsewhere", "—", "—")


@query(
    f"""WITH x AS (SELECT p_partkey, p_name AS a, p_type || ' ' || p_name || ' extra' AS b, '+32' || (p_partkey * 7919 % 100000000) AS phone, floor(p_retailprice * 1000)::BIGINT AS n, floor(p_retailprice)::BIGINT AS f, (p_size * 40)::BIGINT AS c FROM part),
    t AS (SELECT *, {NORMAL.format('a')} AS na, {NORMAL.format('b')} AS nb FROM x), j AS (SELECT *, list_distinct(list_filter(string_split(na, ' '), lambda w: len(w) > 2)) AS ta, list_distinct(list_filter(string_split(nb, ' '), lambda w: len(w) > 2)) AS tb FROM t)
    SELECT p_partkey, CASE WHEN len(phone) <= 8 THEN phone ELSE phone[:6] || repeat('•', len(phone) - 8) || phone[-2:] END AS phone, replace(format('{{:,}}', n), ',', '.') AS number, replace(nb, ' ', '') AS key, {pick_sql('p_partkey', *LABELLED)} AS province,
    round(CASE WHEN c > 0 AND f > c THEN (f - c) / f::DOUBLE * 100 ELSE 0 END, 6) AS dropped, round(greatest(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 1 - levenshtein(na, nb) / greatest(len(na), len(nb))::DOUBLE), 9) AS alike FROM j"""
)
def shown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked phones, written numbers, keys, names of provinces, the drop since the first price, and how alike two descriptions are."""
    k = F.col("p_partkey")
    a, b = F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", F.lit("extra"))
    first, current = F.floor("p_retailprice"), F.col("p_size").cast("long") * 40
    return A.read(spark, sf_dir, "part").select(
        "p_partkey", S.mask_phone(F.concat(F.lit("+32"), k * 7919 % 100_000_000)).alias("phone"), T.label_number(F.floor(F.col("p_retailprice") * 1000)).alias("number"), T.normalize_key(b).alias("key"), P.province_label(pick(k, *PROVINCES)).alias("province"), F.round(S.total_drop_percent(first, current), 6).alias("dropped"), F.round(T.description_similarity(a, b), 9).alias("alike"),
    )


@query(
    """WITH n AS (SELECT l_partkey AS id, l_shipdate AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'street ' || (l_orderkey % 20) END AS street, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::INTEGER END AS surface, CASE WHEN l_orderkey % 7 = 0 THEN (l_linenumber)::INTEGER END AS bedrooms FROM lineitem),
    g AS (SELECT id, max(t) AS t, arg_max(street, (t, street)) FILTER (street IS NOT NULL) AS street, arg_max(surface, (t, surface)) FILTER (surface IS NOT NULL) AS surface, arg_max(bedrooms, (t, bedrooms)) FILTER (bedrooms IS NOT NULL) AS bedrooms FROM n GROUP BY 1)
    SELECT p_partkey AS property_id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, street) AS street, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END, surface) AS surface, bedrooms, greatest(TIMESTAMP '1995-01-01', coalesce(t, TIMESTAMP '1995-01-01')) AS last_seen FROM part LEFT JOIN g ON id = p_partkey"""
)
def enriched_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as properties with gaps that their line items, as matched listings, fill: the newest value that is known."""
    k, none = F.col("p_partkey"), lambda kind: F.lit(None).cast(kind)
    known = A.read(spark, sf_dir, "part").select(k.alias("property_id"), F.when(k % 3 == 0, F.col("p_name")).alias("street"), none("string").alias("house_number"), none("string").alias("city"), F.when(k % 2 == 0, F.col("p_size")).alias("surface"), none("int").alias("bedrooms"), F.lit("1995-01-01").cast("timestamp").alias("last_seen"))
    n = F.col("l_linenumber")
    matched = A.read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("property_id"), F.col("l_shipdate").cast("timestamp").alias("observed_at"), F.when(n % 2 == 0, F.concat(F.lit("street "), F.col("l_orderkey") % 20)).alias("street"), none("string").alias("house_number"), none("string").alias("city"), F.when(n % 3 == 0, F.col("l_quantity").cast("int")).alias("surface"), F.when(F.col("l_orderkey") % 7 == 0, n.cast("int")).alias("bedrooms"),
    )
    return resolution.enrich_properties(known, matched).drop("house_number", "city")


@query(
    f"""WITH {A.OBSERVATIONS_SQL}, l AS (SELECT listing_id, price, seller_type, min(observed_at) OVER (PARTITION BY listing_id) AS first_seen FROM obs QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC) = 1)
    SELECT listing_id % 5 AS agency_id, count(*) AS active, count(*) FILTER (seller_type = 'private') AS private, round(count(*) FILTER (seller_type = 'private') * 100 / count(*)::DOUBLE, 4) AS private_share, floor(median(price) FILTER (price > 0) + 0.5)::BIGINT AS median_price, median({days_sql('first_seen', NOW_SQL)})::DOUBLE AS median_days FROM l GROUP BY 1"""
)
def agency_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agency's market: listings, private share, median price and median days since first sight."""
    state = market.listing_state(A.observations(spark, sf_dir), tie=A.TIE)
    rows = state.select("listing_id", "price", "seller_type", "first_seen", (F.col("listing_id") % 5).alias("agency_id"), F.lit("-").alias("city"))
    return serving.market_overview(rows, ["agency_id"], A.now()).drop("city")


@query(
    f"""WITH {A.OPPORTUNITIES_SQL}, n AS (SELECT * FROM opp ORDER BY created_at DESC, opportunity_id LIMIT 100)
    SELECT opportunity_id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS property, name AS contact, least(6, score % 9) AS n_reasons FROM n LEFT JOIN part ON p_partkey = opportunity_id % 3000 AND p_partkey % 2 = 0 LEFT JOIN con ON con.contact_id = n.contact_id AND opportunity_id % 4 <> 0"""
)
def latest_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred opportunities with their property and contact, where there are any, and six reasons at most."""
    o, k = F.col("opportunity_id"), F.col("p_partkey")
    reasons = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("r"), i))
    rows = A.opportunities(spark, sf_dir).select("opportunity_id", "created_at", (o % 3000).alias("property_id"), F.when(o % 4 != 0, F.col("contact_id")).alias("contact_id"), F.slice(reasons, F.lit(1), F.col("score") % 9).alias("reasons"))
    first = insight.latest(rows, [F.desc("created_at"), F.col("opportunity_id")], 100)
    properties = A.read(spark, sf_dir, "part").where(k % 2 == 0).select(k.alias("property_id"), F.col("p_name").alias("street"))
    out = insight.with_parents(first, properties, A.contacts(spark, sf_dir).select("contact_id", "name"))
    return out.select("opportunity_id", F.col("property.street").alias("property"), F.col("contact.name").alias("contact"), F.size("reasons").alias("n_reasons"))


@query(
    f"""WITH {A.OBSERVATIONS_SQL}, q AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY listing_id, observed_at >= TIMESTAMP '1996-01-01' ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC) = 1),
    s AS (SELECT *, price // 5000 AS band FROM q WHERE observed_at < TIMESTAMP '1996-01-01' AND listing_id % 5 <> 0), b AS (SELECT *, price // 5000 AS band FROM q WHERE observed_at >= TIMESTAMP '1996-01-01' AND listing_id % 7 <> 0)
    SELECT coalesce(s.listing_id, b.listing_id) AS listing_id, CASE WHEN b.band IS NOT NULL AND b.band IS DISTINCT FROM s.band THEN b.price ELSE s.price END AS price, coalesce(b.band, s.band)::VARCHAR AS content_hash, coalesce(b.seller_type, s.seller_type) AS seller_type, coalesce(s.price, b.price) AS first_price, coalesce(s.observed_at, b.observed_at) AS first_seen,
    coalesce(b.observed_at, s.observed_at) AS last_seen, CASE WHEN b.band IS NULL THEN 'MISSING' ELSE 'ACTIVE' END AS status, CASE WHEN b.band IS NULL THEN 2 ELSE 0 END AS missed_runs, (CASE WHEN s.band IS NULL THEN 0 ELSE 1 END + coalesce(b.band <> s.band AND b.price < s.price AND (s.price - b.price) / s.price::DOUBLE * 100 >= 0.5, false)::INTEGER)::INTEGER AS drop_count
    FROM s FULL JOIN b USING (listing_id)"""
)
def upserted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as last seen before 1996, merged with what was seen last since; the content is the price's band of 5000."""
    at, key = F.col("observed_at"), F.col("listing_id")
    rows = A.observations(spark, sf_dir).withColumn("content_hash", F.floor(F.col("price") / 5000).cast("string"))
    last = lambda df: df.groupBy("listing_id").agg(F.max_by(F.struct("price", "seller_type", "content_hash", "observed_at"), F.struct("observed_at", *A.TIE)).alias("s")).select("listing_id", "s.*")
    year = F.lit("1996-01-01").cast("timestamp")
    state = last(rows.where((at < year) & (key % 5 != 0))).select("listing_id", "price", "seller_type", "content_hash", F.col("price").alias("first_price"), at.alias("first_seen"), at.alias("last_seen"), F.lit("MISSING").alias("status"), F.lit(2).alias("missed_runs"), F.lit(1).alias("drop_count"))
    return upkeep.upsert_listings(state, last(rows.where((at >= year) & (key % 7 != 0))))


@query(
    f"""WITH {A.OPPORTUNITIES_SQL}, p AS (SELECT * FROM opp WHERE status = 'NEW' ORDER BY score DESC NULLS FIRST, created_at DESC NULLS FIRST, opportunity_id LIMIT 25), h AS (SELECT type, count(*) AS n FROM p GROUP BY 1),
    s AS (SELECT DISTINCT contact_id FROM opp WHERE status = 'WON'), r AS (SELECT contact_id, count(*) AS n FROM opp GROUP BY 1 ORDER BY n DESC, contact_id LIMIT 1)
    SELECT 'page' AS what, type AS name, n FROM h UNION ALL SELECT 'total', 'NEW', count(*) FROM opp WHERE status = 'NEW' UNION ALL SELECT 'won', 'contacts', count(*) FROM con WHERE contact_id IN (SELECT contact_id FROM s)
    UNION ALL SELECT 'richest', contact_id::VARCHAR, n FROM r UNION ALL SELECT 'since', agency_id::VARCHAR, count(*) FILTER (created_at >= TIMESTAMP '1997-01-01') FROM opp GROUP BY agency_id"""
)
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's types, its list's total, contacts with a won opportunity, the contact with the most, and each agency's since 1997."""
    o = A.opportunities(spark, sf_dir)
    page = serving.work_list(o, A.now(), status="NEW")
    row = lambda df, what, name, n: df.select(F.lit(what).alias("what"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    won = insight.having(A.contacts(spark, sf_dir), o.where("status = 'WON'"), "contact_id")
    parts = [
        row(insight.page_histogram(page, "type"), "page", F.col("type"), F.col("n")), row(o.where("status = 'NEW'").agg(F.count("*").alias("n")), "total", F.lit("NEW"), F.col("n")), row(won.agg(F.count("*").alias("n")), "won", F.lit("contacts"), F.col("n")),
        row(insight.richest(o, "contact_id"), "richest", F.col("contact_id"), F.col("n")), row(insight.alerts_since(o.withColumnRenamed("created_at", "at"), F.lit("1997-01-01").cast("timestamp")), "since", F.col("agency_id"), F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
