"""All queries of the market engine over whole tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import text as T
from tidemark.operators import market, opportunities, resolution, serving
from tidemark.plans import analogue as A
from tidemark.sources import files
from tidemark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "score_opportunities"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


NORMAL = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
NOW_SQL = f"TIMESTAMP '{A.NOW}'"


def months_sql(a: str, b: str) -> str:
    return f"greatest(0, (year({b}) - year({a})) * 12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"


def days_sql(a: str, b: str) -> str:
    return f"greatest(0, floor((epoch_ms({b}) - epoch_ms({a})) / 86400000.0))::INTEGER"


@query(f"SELECT doc_id, md5({NORMAL.format('text')}) AS folded, len(list_filter(string_split({NORMAL.format('text')}, ' '), lambda t: t <> ''))::INTEGER AS n_tokens FROM documents")
def text_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("folded"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


@query(
    f"""WITH x AS (SELECT p_partkey, p_name AS a, p_type || ' ' || p_name || ' extra' AS b FROM part),
    n AS (SELECT p_partkey, {NORMAL.format('a')} AS a, {NORMAL.format('b')} AS b FROM x),
    t AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda w: len(w) > 2)) AS ta, list_distinct(list_filter(string_split(b, ' '), lambda w: len(w) > 2)) AS tb FROM n)
    SELECT p_partkey, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 9) AS jaccard, round(greatest(0, 1 - levenshtein(a, b) / greatest(len(a), len(b))::DOUBLE), 9) AS similarity,
    list_aggregate(list_sort(list_filter(string_split(b, ' '), lambda w: len(w) > 1)), 'string_agg', ' ') AS name_key FROM t"""
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", F.lit("extra"))
    return A.read(spark, sf_dir, "part").select("p_partkey", F.round(T.jaccard(a, b), 9).alias("jaccard"), F.round(T.similarity(a, b), 9).alias("similarity"), T.name_key(b).alias("name_key"))


@query(
    """WITH x AS (SELECT c_custkey, '04' || lpad((50 + c_custkey % 60)::VARCHAR, 2, '0') || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS d FROM customer)
    SELECT c_custkey, '+32' || substr(d, 2) AS phone, substr(d, 2, 3) SIMILAR TO '4[5-9][0-9]' AS is_mobile FROM x"""
)
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.lit("04"), F.lpad((50 + F.col("c_custkey") % 60).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"))
    written = F.when(F.col("c_custkey") % 3 == 0, digits).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+32 (0) "), F.substr(digits, F.lit(2)))).otherwise(F.concat(F.lit("0032/"), F.substr(digits, F.lit(2))))
    return A.read(spark, sf_dir, "customer").select("c_custkey", S.phone_e164(written).alias("phone"), S.phone_is_mobile(written).alias("is_mobile"))


@query(
    "WITH r(a, b, p) AS (VALUES " + ", ".join(f"({a}, {b}, '{p}')" for a, b, p in S.POSTAL_RANGES) + "), x AS (SELECT p_partkey, 1000 + p_partkey % 9000 AS n FROM part) SELECT p_partkey, CASE WHEN n <= 9992 THEN n::VARCHAR END AS postal_code, CASE WHEN n <= 9992 THEN p END AS province, CASE WHEN n <= 9992 THEN n || ':main street:' || (p_partkey % 50) END AS match_key FROM x JOIN r ON n BETWEEN a AND b"
)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("Main Street "), F.col("p_partkey") % 50, F.lit(", B-"), F.lit(1000) + F.col("p_partkey") % 9000, F.lit(" Town"))
    p = A.read(spark, sf_dir, "part").select("p_partkey", S.postal_code(written).alias("postal_code"))
    return p.select("p_partkey", "postal_code", S.province_of(F.col("postal_code")).alias("province"), S.match_key(F.col("postal_code"), F.lit("Main Street"), F.col("p_partkey") % 50).alias("match_key"))


@query(f"SELECT o_orderkey, {days_sql('o_orderdate', NOW_SQL)} AS days, {months_sql('o_orderdate', NOW_SQL)}::INTEGER AS months, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return A.read(spark, sf_dir, "orders").select("o_orderkey", S.days_between(at, A.now()).alias("days"), S.months_between(at, A.now()).alias("months"), S.day_key(at).alias("day"))


@query("SELECT o_orderkey, sha256(concat_ws('|', 'customer=' || o_custkey, 'priority=' || o_orderpriority, 'status=' || o_orderstatus)) AS content_hash FROM orders")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "orders").select("o_orderkey", S.stable_hash({"status": F.col("o_orderstatus"), "customer": F.col("o_custkey"), "priority": F.col("o_orderpriority"), "nothing": F.lit("")}).alias("content_hash"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE floor(x + 0.5)::INTEGER END AS price, CASE p_partkey % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'apartment' WHEN 2 THEN 'land' ELSE 'other' END AS class FROM (SELECT p_partkey, (p_partkey % 5000 + 1) + (p_partkey % 100) / 100.0 AS x FROM part)")
def loose_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("p_partkey") % 4 == 3, F.lit("on request")).otherwise(F.concat(F.lit("€ "), F.col("p_partkey") % 5000 + 1, F.lit(","), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")))
    kind = F.element_at(F.array(*map(F.lit, ("Fermette te koop", "Duplex", "Perceel grond", "Ring"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return A.read(spark, sf_dir, "part").select("p_partkey", S.valid_price(written).alias("price"), S.property_class(kind).alias("class"))


@query(
    """WITH n AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS active FROM lineitem GROUP BY 1),
    s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Immo Centrum' WHEN 1 THEN 'Jan Peeters' WHEN 2 THEN 'Dubois NV' ELSE 'x' END AS name, s_suppkey % 3 AS hint, coalesce(active, 0) AS active FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey),
    w AS (SELECT s_suppkey, CASE WHEN name = 'Dubois NV' THEN 2.5 ELSE 0 END + CASE WHEN name = 'Immo Centrum' THEN 2.5 ELSE 0 END + CASE WHEN active >= 4 THEN 3 WHEN active >= 2 THEN 0.8 WHEN active = 1 THEN -0.5 ELSE 0 END
      + CASE hint WHEN 0 THEN 1.5 WHEN 1 THEN -1.5 ELSE 0 END - CASE WHEN name = 'Jan Peeters' THEN 1.2 + 3.5 ELSE 0 END AS z,
      (name <> 'x')::INTEGER + (name = 'Jan Peeters')::INTEGER + (active >= 1)::INTEGER + (hint < 2)::INTEGER AS n FROM s),
    p AS (SELECT s_suppkey, n, 1 / (1 + exp(-z)) AS p FROM w)
    SELECT s_suppkey, round(CASE WHEN n = 0 THEN 0 ELSE least(0.99, greatest(p, 1 - p)) END, 9) AS confidence, CASE WHEN n = 0 OR least(0.99, greatest(p, 1 - p)) < 0.6 THEN 'unknown' WHEN p >= 0.5 THEN 'professional' ELSE 'private' END AS seller_type FROM p"""
)
def classify_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = A.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("active_listings"))
    key = F.col("s_suppkey")
    name = F.when(key % 4 == 0, "Immo Centrum").when(key % 4 == 1, "Jan Peeters").when(key % 4 == 2, "Dubois NV").otherwise("x")
    text = F.when(key % 4 == 1, "Rechtstreeks van de eigenaar, zonder makelaar").otherwise("Mooie woning")
    s = A.read(spark, sf_dir, "supplier").join(active, key == F.col("l_suppkey"), "left").fillna(0, ["active_listings"])
    rows = s.select("s_suppkey", name.alias("name"), text.alias("text"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("boolean").alias("is_mobile"), F.when(key % 3 == 0, "professional").when(key % 3 == 1, "private").otherwise("unknown").alias("hint"), "active_listings")
    return resolution.classify_sellers(rows).select("s_suppkey", F.round("confidence", 9).alias("confidence"), "seller_type")


@query(
    f"""WITH {A.OBSERVATIONS_SQL}, h AS (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS old_price, lag(seller_type) OVER w AS old_type, first_value(price) OVER w AS first_price, min(observed_at) OVER w AS first_seen FROM obs WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, l_orderkey, l_linenumber)),
    d AS (SELECT *, sum(CASE WHEN price > 0 AND old_price > 0 AND price < old_price AND (old_price - price) / old_price::DOUBLE * 100 >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id ORDER BY observed_at, l_orderkey, l_linenumber) AS drops FROM h)
    SELECT listing_id, observed_at, price, seller_type, first_price, first_seen, drops::BIGINT AS drop_count FROM d QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC) = 1"""
)
def listing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.listing_state(A.observations(spark, sf_dir), tie=A.TIE).select("listing_id", "observed_at", "price", "seller_type", "first_price", "first_seen", "drop_count")


EVENTS_SQL = f"""{A.OBSERVATIONS_SQL}, h AS (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS old_price, lag(seller_type) OVER w AS old_type, lag(observed_at) OVER w AS prev, min(observed_at) OVER w AS first_seen FROM obs WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, l_orderkey, l_linenumber)),
    f AS (SELECT *, price > 0 AND old_price > 0 AND abs(price - old_price) / old_price::DOUBLE * 100 >= 0.5 AS big, {days_sql('first_seen', 'observed_at')} AS age, coalesce({days_sql('first_seen', 'prev')}, -1) AS before FROM h),
    g AS (SELECT *, sum(CASE WHEN big AND price < old_price THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id ORDER BY observed_at, l_orderkey, l_linenumber) AS drops FROM f),
    e AS (SELECT *, unnest([CASE WHEN n = 1 THEN 'NEW_LISTING' END, CASE WHEN n = 1 AND seller_type = 'private' THEN 'FSBO_DETECTED' END, CASE WHEN big AND price < old_price THEN 'PRICE_DROP' END, CASE WHEN big AND price > old_price THEN 'PRICE_INCREASE' END,
      CASE WHEN old_type = 'professional' AND seller_type = 'private' THEN 'AGENCY_TO_PRIVATE' END, CASE WHEN old_type = 'private' AND seller_type = 'professional' THEN 'PRIVATE_TO_AGENCY' END,
      CASE WHEN n > 1 AND age >= 30 AND before < 30 THEN 'STALE_30' END, CASE WHEN n > 1 AND age >= 60 AND before < 60 THEN 'STALE_60' END, CASE WHEN n > 1 AND age >= 90 AND before < 90 THEN 'STALE_90' END]) AS type FROM g),
    k AS (SELECT listing_id || ':' || type || CASE WHEN type LIKE 'PRICE%' THEN ':' || old_price || ':' || price || ':' || strftime(observed_at, '%Y-%m-%d') WHEN type LIKE '%_TO_%' THEN ':' || strftime(observed_at, '%Y-%m-%d') ELSE '' END AS dedupe_key, listing_id, type, observed_at AS occurred_at,
      CASE WHEN type LIKE 'PRICE%' THEN old_price END AS old_price, CASE WHEN type LIKE 'PRICE%' THEN price END AS new_price, drops, seller_type FROM e WHERE type IS NOT NULL),
    ev AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY occurred_at, new_price NULLS FIRST) AS r FROM k)"""


@query(f"WITH {EVENTS_SQL} SELECT dedupe_key, listing_id, type, occurred_at, old_price, new_price, old_price - new_price AS absolute_drop FROM ev WHERE r = 1")
def detect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market.detect_events(market.history(A.observations(spark, sf_dir), tie=A.TIE))
    return found.select("dedupe_key", "listing_id", "type", "occurred_at", "old_price", "new_price", "absolute_drop")


@query(f"WITH {EVENTS_SQL} SELECT type, count(*) AS n, round(avg(old_price - new_price), 6) AS mean_drop FROM ev WHERE r = 1 GROUP BY 1")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market.detect_events(market.history(A.observations(spark, sf_dir), tie=A.TIE))
    return found.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("absolute_drop"), 6).alias("mean_drop"))


RUNS_SQL = "seen AS (SELECT DISTINCT user_id, datediff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS run FROM events)"


@query(
    f"""WITH {RUNS_SQL}, runs AS (SELECT DISTINCT run FROM seen), grid AS (SELECT f.user_id, runs.run FROM (SELECT user_id, min(run) AS f FROM seen GROUP BY 1) f JOIN runs ON run >= f),
    last AS (SELECT g.user_id, g.run, max(s.run) AS seen_run FROM grid g JOIN seen s ON s.user_id = g.user_id AND s.run <= g.run GROUP BY 1, 2)
    SELECT l.user_id, l.run::INTEGER AS run, count(r.run) AS missed FROM last l LEFT JOIN runs r ON r.run > l.seen_run AND r.run <= l.run GROUP BY 1, 2"""
)
def missed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = A.read(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("run")).distinct()
    return market.missed_runs(seen, seen.select("run").distinct(), key="user_id")


@query(
    f"""WITH l AS (SELECT o_orderkey AS listing_id, o_custkey AS property_id, o_orderdate AS first_seen, o_orderdate + INTERVAL 20 DAY AS gone_at FROM orders),
    g AS (SELECT *, lag(listing_id) OVER w AS previous_id, lag(gone_at) OVER w AS pg FROM l WINDOW w AS (PARTITION BY property_id ORDER BY first_seen, listing_id))
    SELECT listing_id, previous_id, {days_sql('pg', 'first_seen')} AS gap_days, listing_id || ':RELISTED:' || previous_id AS dedupe_key FROM g WHERE pg <= first_seen AND {days_sql('pg', 'first_seen')} <= 365"""
)
def relisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return market.relisted(A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("property_id"), at.alias("first_seen"), (at + F.make_dt_interval(F.lit(20))).alias("gone_at")))


@query(
    """WITH t AS (SELECT n_nationkey AS territory_id, n_regionkey AS agency_id, n_nationkey % 3 AS k, n_nationkey FROM nation WHERE n_nationkey % 7 <> 6),
    p AS (SELECT p_partkey AS place_id, (p_partkey % 30)::VARCHAR AS postal, 'city ' || (p_partkey % 20) AS city, 'province ' || (p_partkey % 10) AS province FROM part),
    m AS (SELECT place_id, agency_id, territory_id, CASE k WHEN 0 THEN 'postal_code' WHEN 1 THEN 'municipality' ELSE 'province' END AS kind, 3 - k AS rank FROM t JOIN p ON (k = 0 AND postal = n_nationkey::VARCHAR) OR (k = 1 AND city = 'city ' || (n_nationkey % 20)) OR (k = 2 AND province = 'province ' || (n_nationkey % 10)))
    SELECT place_id, agency_id, territory_id, kind, rank::INTEGER AS rank FROM m QUALIFY row_number() OVER (PARTITION BY place_id, agency_id ORDER BY rank DESC, territory_id) = 1"""
)
def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    only = lambda n, v: F.when(k % 3 == n, F.array(v)).otherwise(F.array().cast("array<string>"))
    t = A.read(spark, sf_dir, "nation").select(k.alias("territory_id"), F.col("n_regionkey").alias("agency_id"), (k % 7 != 6).alias("active"), only(0, k.cast("string")).alias("postal_codes"), only(1, F.concat(F.lit("city "), k % 20)).alias("municipalities"), only(2, F.concat(F.lit("province "), k % 10)).alias("provinces"))
    key = F.col("p_partkey")
    p = A.read(spark, sf_dir, "part").select(key.alias("place_id"), (key % 30).cast("string").alias("postal"), F.concat(F.lit("city "), key % 20).alias("city"), F.concat(F.lit("province "), key % 10).alias("province"))
    return market.best_territory(p, t)


@query(
    f"""WITH p AS (SELECT p_partkey AS id, p_name AS street, p_brand AS kind, p_size AS surface, p_retailprice AS price, CASE WHEN p_partkey % 10 < 2 THEN 'k' || (p_partkey // 4) END AS mk, (1000 + p_size)::VARCHAR AS postal, '+32' || (p_partkey % 977) AS phone, p_partkey % 1000 AS seen FROM part),
    l AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN phone END AS phone) FROM p WHERE id % 2 = 0), c AS (SELECT * FROM p WHERE id % 2 = 1),
    t AS (SELECT l.id AS lid, c.id AS pid, 1 AS tier FROM l JOIN c ON l.mk = c.mk UNION ALL SELECT l.id, c.id, 2 FROM l JOIN c ON l.postal = c.postal AND l.kind = c.kind UNION ALL SELECT l.id, c.id, 3 FROM l JOIN c ON l.phone = c.phone),
    o AS (SELECT lid, pid, min(tier) AS tier, any_value(c.seen) AS seen FROM t JOIN c ON c.id = pid GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lid ORDER BY min(tier), any_value(c.seen) DESC, pid) <= 25),
    f AS (SELECT lid, pid, l.postal <> c.postal AS apart, coalesce(l.mk = c.mk, false) AS exact, coalesce(l.phone = c.phone, false) AS called, l.kind = c.kind AS alike, CASE WHEN l.street = c.street THEN 1 ELSE greatest(0, 1 - levenshtein(l.street, c.street) / greatest(len(l.street), len(c.street))::DOUBLE) END AS street,
      greatest(0, 1 - (abs(l.surface - c.surface) / greatest(l.surface, c.surface)::DOUBLE) / 0.08) AS surface, greatest(0, 1 - (abs(l.price - c.price) / greatest(l.price, c.price)) / 0.25) AS price FROM o JOIN l ON l.id = lid JOIN c ON c.id = pid),
    g AS (SELECT lid, pid, CASE WHEN apart THEN 0.1 ELSE greatest((CASE WHEN exact THEN 6 ELSE 2.5 * street END + 1.5 + CASE WHEN alike THEN 0.7 ELSE 0 END + 1.5 * surface + CASE WHEN called THEN 3 ELSE 0 END + 0.6 * price) / (CASE WHEN exact THEN 6 ELSE 2.5 END + 1.5 + 0.7 + 1.5 + CASE WHEN called THEN 3 ELSE 0 END + 0.6), CASE WHEN exact THEN 0.95 WHEN called THEN 0.82 ELSE 0 END) END AS x FROM f),
    b AS (SELECT lid, pid, x FROM g QUALIFY row_number() OVER (PARTITION BY lid ORDER BY x DESC, pid) = 1)
    SELECT l.id AS listing_id, CASE WHEN x >= 0.55 THEN pid END AS property_id, round(coalesce(x, 0), 6) AS confidence, CASE WHEN x >= 0.78 THEN 'match' WHEN x >= 0.55 THEN 'review' ELSE 'none' END AS decision FROM l LEFT JOIN b ON lid = l.id"""
)
def match_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even parts, as listings, against the odd ones, as properties: two tables in one, not a sample."""
    listings, known = listings_and_properties(spark, sf_dir)
    return resolution.match_properties(listings, known).withColumn("confidence", F.round("confidence", 6))


def listings_and_properties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = lambda kind: F.lit(None).cast(kind)
    key, phone = F.col("p_partkey"), F.concat(F.lit("+32"), (F.col("p_partkey") % 977).cast("string"))
    p = A.read(spark, sf_dir, "part").select(
        key.alias("property_id"), F.when(key % 10 < 2, F.concat(F.lit("k"), F.floor(key / 4).cast("string"))).alias("match_key"), F.col("p_name").alias("street"), none("string").alias("house_number"), (1000 + F.col("p_size")).cast("string").alias("postal_code"), none("string").alias("city"),
        F.col("p_brand").alias("property_type"), F.col("p_size").alias("surface"), none("int").alias("bedrooms"), phone.alias("phone"), F.col("p_retailprice").alias("price"), (key % 1000).alias("last_seen"),
    )
    listings = p.where("property_id % 2 = 0").withColumnRenamed("property_id", "listing_id").withColumn("phone", F.when(F.col("listing_id") % 3 == 0, F.col("phone"))).withColumns({"title": none("string"), "description": none("string")})
    empty = F.array().cast("array<string>")
    known = p.where("property_id % 2 = 1").withColumns({"phones": F.array("phone"), "titles": empty, "descriptions": empty, "prices": F.array("price")})
    return listings, known


@query(
    """WITH m AS (SELECT o_orderkey AS market_id, o_custkey, o_orderkey % 3 AS k FROM orders), c AS (SELECT c_custkey AS contact_id, n_regionkey AS agency_id FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT market_id, agency_id, contact_id, CASE k WHEN 0 THEN 0.97 WHEN 1 THEN 0.9 ELSE 0.96 END AS confidence, true AS confirmed FROM m JOIN c ON contact_id = o_custkey"""
)
def crm_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders name their customer by an address of the customer's file, its own address, or phone with name and postal code."""
    key, kind = F.col("o_custkey"), F.col("o_orderkey") % 3
    named = lambda c: F.concat(F.lit("client "), F.md5(c.cast("string")))
    m = A.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("market_id"), F.when(kind == 0, F.concat(F.lit("own:"), key)).when(kind == 1, F.concat(F.lit("at:"), key)).alias("match_key"), F.when(kind == 2, F.concat(F.lit("+32"), key)).alias("phone"), F.lit(None).cast("string").alias("email"), F.when(kind == 2, named(key)).alias("name"), F.when(kind == 2, key.cast("string")).alias("postal_code"),
    )
    c = A.contacts(spark, sf_dir)
    k = c.select("contact_id", "agency_id", F.concat(F.lit("at:"), "contact_id").alias("address_key"), F.array(F.concat(F.lit("own:"), "contact_id")).alias("owned_keys"), F.concat(F.lit("+32"), "contact_id").alias("phone"), F.lit(None).cast("string").alias("email"), named(F.col("contact_id")).alias("name"), F.col("contact_id").cast("string").alias("postal_code"))
    return resolution.crm_matches(m, k).drop("known_owner")


@query(
    """WITH x AS (SELECT c_custkey AS row_id, c_custkey % 4 AS k, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT row_id, CASE WHEN k < 3 THEN row_id END AS contact_id, CASE k WHEN 0 THEN 'external_id' WHEN 1 THEN 'phone' WHEN 2 THEN 'name_address' END AS tier, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence FROM x"""
)
def dedupe_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.contacts(spark, sf_dir)
    key, k = F.col("contact_id").cast("string"), F.col("contact_id") % 4
    existing = c.select("contact_id", "agency_id", F.concat(F.lit("x"), key).alias("external_id"), F.concat(F.lit("+32"), key).alias("phone"), F.lit(None).cast("string").alias("email"), F.concat(F.lit("n"), key).alias("name_key"), F.concat(F.lit("a"), key).alias("address_key"))
    incoming = c.select(F.col("contact_id").alias("row_id"), "agency_id", F.when(k == 0, F.concat(F.lit("x"), key)).alias("external_id"), F.when(k == 1, F.concat(F.lit("+32"), key)).alias("phone"), F.lit(None).cast("string").alias("email"), F.when(k >= 2, F.concat(F.lit("n"), key)).alias("name_key"), F.when(k == 2, F.concat(F.lit("a"), key)).alias("address_key"))
    return resolution.dedupe_contacts(incoming, existing)


SCORE_SQL = f"""WITH {EVENTS_SQL},
    o AS (SELECT dedupe_key, listing_id, occurred_at, new_price, drops, seller_type, CASE WHEN type = 'AGENCY_TO_PRIVATE' THEN type WHEN seller_type <> 'private' THEN NULL WHEN type = 'FSBO_DETECTED' THEN 'NEW_FSBO' WHEN type LIKE 'STALE%' THEN 'STALE_FSBO' WHEN type = 'PRICE_DROP' AND drops >= 2 THEN 'PRIVATE_MULTIPLE_PRICE_DROP' WHEN type = 'PRICE_DROP' THEN 'PRIVATE_PRICE_DROP' END AS type,
      p_retailprice * 400 AS price, p_partkey % 3 = 0 AS crm, p_partkey % 6 = 0 AS owner, (p_partkey % 240)::INTEGER AS rel, CASE p_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 75 WHEN 2 THEN 40 ELSE 0 END AS territory, {days_sql('first_seen', 'occurred_at')} AS age
      FROM ev JOIN part ON p_partkey = listing_id JOIN (SELECT listing_id AS l, min(observed_at) AS first_seen FROM obs GROUP BY 1) ON l = listing_id WHERE r = 1),
    d AS (SELECT *, least(100, CASE WHEN seller_type = 'private' THEN 45 ELSE 0 END + CASE WHEN type = 'AGENCY_TO_PRIVATE' THEN 25 ELSE 0 END + CASE WHEN drops >= 1 THEN 15 ELSE 0 END + CASE WHEN drops >= 2 THEN 15 ELSE 0 END + CASE WHEN age >= 90 THEN 20 WHEN age >= 60 THEN 15 WHEN age >= 30 THEN 10 ELSE 0 END + CASE WHEN price >= 600000 THEN 10 ELSE 0 END) AS intent,
      CASE WHEN crm THEN least(100, CASE WHEN owner THEN 55 ELSE 0 END + CASE WHEN rel >= 12 THEN least(15, 5 * (rel // 12)) ELSE 0 END + 15) ELSE 0 END AS relationship,
      least(100, CASE WHEN type LIKE '%PRICE_DROP' THEN 70 ELSE 0 END + CASE WHEN type = 'STALE_FSBO' THEN CASE WHEN age >= 90 THEN 65 ELSE 50 END ELSE 0 END) AS timing,
      CASE WHEN seller_type <> 'unknown' THEN floor(55 * 0.9 + 0.5) ELSE 0 END + CASE WHEN crm THEN floor(30 * 0.88 + 0.5) ELSE 0 END + 15 AS confidence FROM o WHERE type IS NOT NULL),
    b AS (SELECT *, CASE WHEN crm THEN 0.4 * intent + 0.22 * relationship + 0.15 * timing + 0.11 * territory + 0.12 * confidence ELSE (0.4 * intent + 0.15 * timing + 0.11 * territory + 0.12 * confidence)::DOUBLE / 0.78 END AS base, CASE WHEN crm THEN floor(12 * relationship::DOUBLE / 100 * 0.88 + 0.5) ELSE 0 END AS bonus FROM d)
    """


@query(SCORE_SQL + "SELECT dedupe_key, type, intent::INTEGER AS intent, relationship::INTEGER AS relationship, timing::INTEGER AS timing, territory::INTEGER AS territory, confidence::INTEGER AS confidence, least(100, floor(round(base::DOUBLE, 9) + 0.5) + bonus)::INTEGER AS score FROM b")
def score_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items to events to scored opportunities: the market pipeline at once."""
    h = market.history(A.observations(spark, sf_dir), tie=A.TIE)
    found = market.detect_events(h.withColumn("n", F.col("n")))
    first = A.observations(spark, sf_dir).groupBy("listing_id").agg(F.min("observed_at").alias("first_seen"))
    kind = opportunities.opportunity_type(F.col("type"), F.col("seller_type") == "private", F.col("drop_count"))
    part = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing_id"), "p_retailprice")
    key, crm = F.col("listing_id"), F.col("listing_id") % 3 == 0
    rows = found.withColumn("type", kind).where("type is not null").join(first, "listing_id").join(part, "listing_id")
    no, none = F.lit(False), F.lit(None).cast("int")
    context = rows.select(
        "dedupe_key", "type", "seller_type", "drop_count", F.when(crm, "CROSS").otherwise("MARKET").alias("origin"), F.lit(0.9).alias("seller_confidence"), F.lit(True).alias("has_phone"), no.alias("is_relisted"), S.days_between(F.col("first_seen"), F.col("occurred_at")).alias("days_on_market"), none.alias("minutes_since_seen"), (F.col("p_retailprice") * 400).alias("price"),
        crm.alias("has_crm_match"), F.lit(0.88).alias("crm_confidence"), (crm & (key % 6 == 0)).alias("is_known_owner"), no.alias("was_client"), no.alias("had_valuation"), F.when(crm, (key % 240).cast("int")).alias("relationship_months"), none.alias("silent_months"), no.alias("never_contacted"),
        F.element_at(F.array(*map(F.lit, ("postal_code", "municipality", "province", "none"))), (key % 4 + 1).cast("int")).alias("territory"),
    ).withColumnRenamed("territory", "place")
    scored = opportunities.score(context.withColumnRenamed("place", "territory").withColumn("territory_kind", F.col("territory")), with_reasons=False)
    return scored.select("dedupe_key", "type", "intent", "relationship", "timing", "territory", "confidence", "score")


@query(
    f"""WITH {A.OPPORTUNITIES_SQL}, s AS (SELECT agency_id, contact_id::VARCHAR AS dedupe_key, max(score) AS score, min(status) AS status FROM opp WHERE opportunity_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT agency_id, contact_id::VARCHAR AS dedupe_key, max(score) AS new FROM opp WHERE opportunity_id % 2 = 1 GROUP BY 1, 2)
    SELECT agency_id, dedupe_key, CASE WHEN s.score IS NULL OR (new > score AND status IN ('NEW', 'ASSIGNED', 'TO_CONTACT', 'SNOOZED')) THEN new ELSE score END AS score, coalesce(status, 'NEW') AS status, CASE WHEN s.score IS NULL THEN 'created' WHEN new > score AND status IN ('NEW', 'ASSIGNED', 'TO_CONTACT', 'SNOOZED') THEN 'refreshed' ELSE 'kept' END AS outcome FROM s FULL JOIN n USING (agency_id, dedupe_key)"""
)
def merge_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.opportunities(spark, sf_dir).withColumn("dedupe_key", F.col("contact_id").cast("string"))
    state = o.where("opportunity_id % 2 = 0").groupBy("agency_id", "dedupe_key").agg(F.max("score").alias("score"), F.min("status").alias("status"), F.min("type").alias("type"))
    return opportunities.merge_opportunities(state, o.where("opportunity_id % 2 = 1").select("agency_id", "dedupe_key", "score", "type")).drop("type")


@query(
    f"""WITH {A.CONTACTS_SQL}, i AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS val, bool_or(o_orderpriority = '5-LOW') AS man, max(o_orderdate) AS last, min(o_orderdate) AS first FROM orders GROUP BY 1),
    c AS (SELECT contact_id, contact_type, status, contact_id % 10 = 0 AS owner, coalesce(n, 0) AS n, coalesce(val, false) AS val, coalesce(man, false) AS man, {months_sql('last', NOW_SQL)} AS silent, {months_sql('first', NOW_SQL)} AS rel, last FROM con LEFT JOIN i ON o_custkey = contact_id),
    s AS (SELECT *, least(100, CASE WHEN owner THEN 25 ELSE 0 END + CASE WHEN status = 'WON' OR contact_type = 'FORMER_CLIENT' THEN 30 ELSE 0 END + CASE WHEN val OR contact_type = 'VALUATION_LEAD' THEN 20 ELSE 0 END + CASE WHEN man THEN 10 ELSE 0 END + CASE WHEN n >= 5 THEN 15 WHEN n >= 2 THEN 8 ELSE 0 END + CASE WHEN rel >= 24 THEN least(10, 2 * (rel // 12)) ELSE 0 END) AS score FROM c)
    SELECT contact_id, score::INTEGER AS relationship_score, CASE WHEN n = 0 AND last IS NULL AND status <> 'LOST' THEN 'UNCONTACTED_LEAD' WHEN NOT coalesce(silent >= 12, rel >= 1, false) OR score < 45 THEN NULL WHEN man AND status = 'LOST' THEN 'LOST_MANDATE' WHEN contact_type = 'VALUATION_LEAD' AND status <> 'WON' THEN 'DORMANT_VALUATION_LEAD' WHEN contact_type = 'SELLER' AND status <> 'WON' THEN 'FORMER_SELLER_PROSPECT' WHEN status = 'WON' OR contact_type = 'FORMER_CLIENT' THEN 'FORMER_CLIENT' WHEN contact_type = 'BUYER' AND rel >= 60 THEN 'PREVIOUS_BUYER' END AS opportunity_type FROM s"""
)
def dormant_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.read(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    seen = orders.groupBy(F.col("o_custkey").alias("contact_id")).agg(F.max(at).alias("last_contact_at"), F.min(at).alias("created_at"))
    roles = F.when(F.col("contact_id") % 10 == 0, F.array(F.lit("OWNER"))).otherwise(F.array().cast("array<string>"))
    c = A.contacts(spark, sf_dir).join(seen, "contact_id", "left").withColumn("roles", roles)
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "VALUATION").when(F.col("o_orderpriority") == "5-LOW", "MANDATE").otherwise("CALL")
    assessed = opportunities.assess_contacts(c, orders.select(F.col("o_custkey").alias("contact_id"), kind.alias("kind")), A.now())
    return assessed.select("contact_id", "relationship_score", "opportunity_type")


@query(f"WITH {A.OPPORTUNITIES_SQL} SELECT opportunity_id, score, status, price FROM opp WHERE status IN ('NEW','ASSIGNED','TO_CONTACT','CONTACTED','APPOINTMENT','NEGOTIATION','SNOOZED') AND (snoozed_until IS NULL OR snoozed_until <= {NOW_SQL}) AND score >= 40 AND origin = 'CROSS' ORDER BY score DESC NULLS FIRST, created_at DESC NULLS FIRST, opportunity_id LIMIT 25")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.work_list(A.opportunities(spark, sf_dir), A.now(), origin="CROSS", least_score=40).select("opportunity_id", "score", "status", "price")


@query(f"WITH {A.OPPORTUNITIES_SQL} SELECT contact_id, opportunity_id, rank::INTEGER AS rank FROM (SELECT contact_id, opportunity_id, row_number() OVER (PARTITION BY contact_id ORDER BY score DESC, opportunity_id) AS rank FROM opp) WHERE rank <= 6")
def top_per_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_per_parent(A.opportunities(spark, sf_dir).select("contact_id", "opportunity_id", "score"), "contact_id", [F.desc("score"), F.col("opportunity_id")], 6).select("contact_id", "opportunity_id", "rank")


@query(
    f"""WITH {A.OPPORTUNITIES_SQL}, g AS (SELECT agency_id, count(*) AS total, count(*) FILTER (status <> 'NEW') AS handled, count(*) FILTER (status = 'WON') AS won, count(*) FILTER (status = 'LOST') AS lost, count(*) FILTER (status = 'DISMISSED') AS dismissed, count(*) FILTER (status = 'WON' AND origin = 'CROSS') AS cross_won FROM opp GROUP BY 1)
    SELECT *, CASE WHEN won + lost + dismissed = 0 THEN 0 ELSE round(won * 100 / (won + lost + dismissed)::DOUBLE, 4) END AS conversion, CASE WHEN won = 0 THEN 0 ELSE round(cross_won * 100 / won::DOUBLE, 4) END AS cross_share FROM g"""
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.funnel(A.opportunities(spark, sf_dir))


@query(
    f"""WITH {A.OBSERVATIONS_SQL}, l AS (SELECT listing_id, price, seller_type, min(observed_at) OVER (PARTITION BY listing_id) AS first_seen FROM obs QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC) = 1)
    SELECT (1000 + listing_id % 90)::VARCHAR AS postal_code, count(*) AS active, count(*) FILTER (seller_type = 'private') AS private, round(count(*) FILTER (seller_type = 'private') * 100 / count(*)::DOUBLE, 4) AS private_share, floor(median(price) FILTER (price > 0) + 0.5)::BIGINT AS median_price, arg_min('city ' || (listing_id % 7), (first_seen, listing_id)) AS city FROM l GROUP BY 1"""
)
def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = market.listing_state(A.observations(spark, sf_dir), tie=A.TIE)
    rows = state.select("listing_id", "price", "seller_type", "first_seen", (1000 + F.col("listing_id") % 90).cast("string").alias("postal_code"), F.concat(F.lit("city "), F.col("listing_id") % 7).alias("city"))
    return serving.market_overview(rows, ["postal_code"])


@query(
    f"""WITH {A.OPPORTUNITIES_SQL}, rules AS (SELECT n_nationkey AS rule_id, n_regionkey AS agency_id, 40 + n_nationkey AS least, 20 AS cap, n_nationkey % 2 AS k FROM nation), sent AS (SELECT rule_id, opportunity_id, opportunity_id % 50 = 0 AS today FROM rules JOIN opp USING (agency_id) WHERE opportunity_id % 25 = 0 AND (opportunity_id // 25) % 40 = rule_id),
    used AS (SELECT rule_id, count(*) AS used FROM sent WHERE today GROUP BY 1)
    SELECT rule_id, opportunity_id, score, rank::INTEGER AS rank FROM (SELECT r.rule_id, o.opportunity_id, o.score, cap - coalesce(used, 0) AS rest, row_number() OVER (PARTITION BY r.rule_id ORDER BY o.score DESC, o.opportunity_id) AS rank FROM rules r JOIN opp o USING (agency_id) LEFT JOIN used u ON u.rule_id = r.rule_id WHERE o.score >= least AND (k = 0 OR o.type = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.rule_id = r.rule_id AND s.opportunity_id = o.opportunity_id)) WHERE rank <= rest"""
)
def select_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    types = F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1-URGENT")))
    rules = A.read(spark, sf_dir, "nation").select(k.alias("rule_id"), F.col("n_regionkey").alias("agency_id"), (40 + k).alias("least_score"), F.lit(20).alias("daily_cap"), types.alias("types"))
    o = A.opportunities(spark, sf_dir)
    key = F.col("opportunity_id")
    sent = rules.join(o, "agency_id").where((key % 25 == 0) & (F.floor(key / 25) % 40 == F.col("rule_id"))).select("rule_id", "opportunity_id", (key % 50 == 0).alias("today"))
    return serving.select_alerts(rules, o, sent)


@query(
    f"""WITH {A.CONTACTS_SQL}, i AS (SELECT o_custkey, max(o_orderdate) AS last, min(o_orderdate) AS first FROM orders GROUP BY 1)
    SELECT contact_id, CASE WHEN NOT coalesce(last < TIMESTAMP '2000-01-01', false) THEN name END AS name, coalesce(last < TIMESTAMP '2000-01-01', false) AS redacted FROM con LEFT JOIN i ON o_custkey = contact_id"""
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    calls = A.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contact_id"), at.alias("at"))
    seen = calls.groupBy("contact_id").agg(F.max("at").alias("last_contact_at"), F.min("at").alias("created_at"))
    c = A.contacts(spark, sf_dir).join(seen, "contact_id", "left")
    return serving.redact_silent(c, calls, F.lit("2000-01-01").cast("timestamp"), ("name",)).select("contact_id", "name", "redacted")


@query(
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer) SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'SELLER' ELSE c_mktsegment END AS contact_type,
    concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'name' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'contact_type' END, CASE WHEN c_custkey % 2 = 0 THEN 'last_contact_at' END) AS changes FROM o"""
)
def merge_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("c_custkey"), lambda s: F.lit(s).cast("timestamp")
    c = A.read(spark, sf_dir, "customer")
    state = c.select(k.alias("contact_id"), F.col("c_name").alias("name"), F.lit("a@b.c").alias("email"), F.col("c_mktsegment").alias("contact_type"), ts("2000-01-01").alias("created_at"), ts("2001-01-01").alias("last_contact_at"))
    batch = c.where(k % 2 == 0).select(k.alias("contact_id"), F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.lit("")).alias("name"), F.lit(None).cast("string").alias("email"), F.when(k % 5 == 0, "UNKNOWN").otherwise("SELLER").alias("contact_type"), ts("1999-01-01").alias("created_at"), ts("2001-06-01").alias("last_contact_at"))
    return serving.merge_contacts(state, batch).select("contact_id", "name", "contact_type", "changes")


@query(f"WITH {A.OPPORTUNITIES_SQL} SELECT contact_id, opportunity_id, created_at, lead(created_at) OVER (PARTITION BY contact_id ORDER BY created_at, opportunity_id) AS ended_at FROM opp")
def assignment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.opportunities(spark, sf_dir).select(F.col("contact_id").alias("opportunity_id"), F.col("opportunity_id").alias("user_id"), F.col("created_at").alias("assigned_at"))
    return opportunities.assignment_history(rows).toDF("contact_id", "opportunity_id", "created_at", "ended_at")


@query("WITH x AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages) SELECT DISTINCT page_id, CASE WHEN h LIKE '/%' THEN o || h ELSE h END AS link FROM x WHERE h LIKE '/%' OR starts_with(h, o || '/')")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extract_links(A.read(spark, sf_dir, "pages"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(A.read(spark, sf_dir, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(A.read(spark, sf_dir, "events"))


from tidemark import catalog_flow, catalog_actions, catalog_details, catalog_evidence, catalog_life, catalog_limits, catalog_masking, catalog_pages  # noqa: E402, F401, I001  register their queries here
