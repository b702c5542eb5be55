"""Queries in which every branch fires: contacts with shared keys, filters of the work list, rules of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import NORMAL, NOW_SQL, query
from tidemark.catalog_flow import pick, pick_sql
from tidemark.operators import resolution, serving
from tidemark.plans import analogue as A

NAMES = ("Jan Peeters", "Peeters, JAN", "Jan Peters", "An De Smet", "Élise Dubois", "Elise  Dubois", None)


def text(prefix: str, key):
    return F.concat(F.lit(prefix), key)


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as market signals and customers as contacts: phones, e-mails, addresses and names that many share."""
    o, c = F.col("o_orderkey"), F.col("contact_id")
    market = A.read(spark, sf_dir, "orders").select(
        o.alias("market_id"), F.when(o % 3 == 0, text("a", o % 900)).alias("match_key"), F.when(o % 20 == 0, text("+32", o % 10)).alias("phone"), F.when(o % 5 == 1, text("e", o % 300)).alias("email"), pick(o, *NAMES).alias("name"), (o % 50).cast("string").alias("postal_code"), F.when(o % 11 == 0, o % 400).alias("property_id"),
    )
    contacts = A.contacts(spark, sf_dir).select(
        "contact_id", "agency_id", text("a", c % 500).alias("address_key"), F.when(c % 4 == 0, F.array(text("a", c * 3 % 700))).otherwise(F.array().cast("array<string>")).alias("owned_keys"), F.when(c % 9 == 0, F.array(c % 400)).otherwise(F.array().cast("array<bigint>")).alias("owned_ids"),
        F.when(c % 6 != 0, text("+32", c % 10)).alias("phone"), F.when(c % 2 == 0, text("e", c % 300)).alias("email"), pick(c, *NAMES).alias("name"), (c % 50).cast("string").alias("postal_code"), (c % 13 == 0).alias("redacted"),
    )
    return market, contacts


@query(
    f"""WITH {A.CONTACTS_SQL}, m0 AS (SELECT o_orderkey AS mid, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || (o_orderkey % 900) END AS mk, CASE WHEN o_orderkey % 20 = 0 THEN '+32' || (o_orderkey % 10) END AS phone, CASE WHEN o_orderkey % 5 = 1 THEN 'e' || (o_orderkey % 300) END AS email, {pick_sql('o_orderkey', *NAMES)} AS name, (o_orderkey % 50)::VARCHAR AS postal, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 400 END AS pid FROM orders),
    k0 AS (SELECT contact_id AS cid, agency_id, 'a' || (contact_id % 500) AS mk, CASE WHEN contact_id % 4 = 0 THEN 'a' || (contact_id * 3 % 700) END AS owned, CASE WHEN contact_id % 9 = 0 THEN contact_id % 400 END AS pid, CASE WHEN contact_id % 6 <> 0 THEN '+32' || (contact_id % 10) END AS phone, CASE WHEN contact_id % 2 = 0 THEN 'e' || (contact_id % 300) END AS email, {pick_sql('contact_id', *NAMES)} AS name, (contact_id % 50)::VARCHAR AS postal FROM con WHERE contact_id % 13 <> 0),
    nm AS (SELECT name, n, (SELECT string_agg(w, ' ' ORDER BY w) FROM (SELECT unnest(string_split(n, ' ')) AS w) WHERE len(w) > 1) AS nk FROM (SELECT DISTINCT name, {NORMAL.format('name')} AS n FROM (SELECT name FROM m0 UNION SELECT name FROM k0) WHERE name IS NOT NULL)),
    m AS (SELECT m0.*, n, nk FROM m0 LEFT JOIN nm USING (name)), k AS (SELECT k0.*, n, nk FROM k0 LEFT JOIN nm USING (name)),
    e AS (SELECT mid, cid, 'owner' AS f FROM m JOIN k ON m.mk = owned UNION ALL SELECT mid, cid, 'owner' FROM m JOIN k ON m.pid = k.pid UNION ALL SELECT mid, cid, 'address' FROM m JOIN k ON m.mk = k.mk UNION ALL SELECT mid, cid, 'phone' FROM m JOIN k ON m.phone = k.phone UNION ALL SELECT mid, cid, 'email' FROM m JOIN k ON m.email = k.email UNION ALL SELECT mid, cid, 'name' FROM m JOIN k ON m.nk = k.nk AND m.postal = k.postal),
    p AS (SELECT mid, agency_id, cid, bool_or(f = 'owner') AS ow, bool_or(f = 'address') AS ad, bool_or(f = 'phone') AS ph, bool_or(f = 'email') AS em FROM e JOIN k USING (cid) GROUP BY mid, agency_id, cid),
    s AS (SELECT p.*, ow OR ad OR ph OR em AS hard, CASE WHEN ow THEN 0.97 WHEN ad THEN 0.90 WHEN ph THEN 0.88 WHEN em THEN 0.86 ELSE 0 END AS base, CASE WHEN coalesce(m.n, '') = '' OR coalesce(k.n, '') = '' THEN 0 WHEN m.n = k.n THEN 1 ELSE greatest(0, 1 - levenshtein(m.n, k.n) / greatest(len(m.n), len(k.n))::DOUBLE) END AS alike, m.postal = k.postal AS near FROM p JOIN m USING (mid) JOIN k USING (cid)),
    t AS (SELECT *, CASE WHEN NOT hard THEN 0 WHEN alike >= 0.92 THEN least(0.99, base + 0.06) WHEN alike >= 0.75 THEN least(0.99, base + 0.02) ELSE base END AS step FROM s),
    c AS (SELECT *, round(CASE WHEN hard AND alike >= 0.75 AND near THEN least(0.99, step + 0.02) WHEN hard THEN step ELSE 0.45 END, 3) AS confidence FROM t)
    SELECT mid AS market_id, agency_id, cid AS contact_id, confidence, confidence >= 0.8 AS confirmed, ow AS known_owner FROM c WHERE confidence >= 0.55 QUALIFY row_number() OVER (PARTITION BY mid, agency_id ORDER BY confidence DESC, cid) = 1"""
)
def crm_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best contact of each agency by address, ownership, phone, e-mail and name, keys shared by many."""
    return resolution.crm_matches(*evidence(spark, sf_dir))


@query(
    f"""WITH {A.CONTACTS_SQL}, x AS (SELECT contact_id AS cid, agency_id, 'x' || (contact_id % 700) AS ext, CASE WHEN contact_id % 6 <> 0 THEN '+32' || (contact_id % 400) END AS phone, CASE WHEN contact_id % 2 = 0 THEN 'e' || (contact_id % 300) END AS email, 'n' || (contact_id % 40) AS nk, 'a' || (contact_id % 30) AS ak FROM con),
    i AS (SELECT o_orderkey AS rid, o_custkey % 5 AS agency_id, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || (o_orderkey % 900) END AS ext, CASE WHEN o_orderkey % 5 = 0 THEN '+32' || (o_orderkey % 500) END AS phone, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || (o_orderkey % 400) END AS email, 'n' || (o_orderkey % 45) AS nk, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || (o_orderkey % 33) END AS ak FROM orders),
    f AS (SELECT rid, min(cid) AS cid, 0 AS r FROM i JOIN x USING (agency_id, ext) GROUP BY 1 UNION ALL SELECT rid, min(cid), 1 FROM i JOIN x USING (agency_id, phone) GROUP BY 1 UNION ALL SELECT rid, min(cid), 2 FROM i JOIN x USING (agency_id, email) GROUP BY 1 UNION ALL SELECT rid, min(cid), 3 FROM i JOIN x USING (agency_id, nk, ak) GROUP BY 1),
    b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rid ORDER BY r) = 1)
    SELECT rid AS row_id, cid AS contact_id, (['external_id', 'phone', 'email', 'name_address'])[r + 1] AS tier, coalesce(([1.0, 0.95, 0.9, 0.75])[r + 1], 0)::DOUBLE AS confidence FROM i LEFT JOIN b USING (rid)"""
)
def import_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rows against contacts whose ids, phones, e-mails and names with address many share: the first tier, the lowest contact."""
    c, o = F.col("contact_id"), F.col("o_orderkey")
    existing = A.contacts(spark, sf_dir).select("contact_id", "agency_id", text("x", c % 700).alias("external_id"), F.when(c % 6 != 0, text("+32", c % 400)).alias("phone"), F.when(c % 2 == 0, text("e", c % 300)).alias("email"), text("n", c % 40).alias("name_key"), text("a", c % 30).alias("address_key"))
    incoming = A.read(spark, sf_dir, "orders").select(o.alias("row_id"), (F.col("o_custkey") % 5).alias("agency_id"), F.when(o % 7 == 0, text("x", o % 900)).alias("external_id"), F.when(o % 5 == 0, text("+32", o % 500)).alias("phone"), F.when(o % 3 == 0, text("e", o % 400)).alias("email"), text("n", o % 45).alias("name_key"), F.when(o % 2 == 0, text("a", o % 33)).alias("address_key"))
    return resolution.dedupe_contacts(incoming, existing)


PLACED_SQL = f"{A.OPPORTUNITIES_SQL}, pl AS (SELECT *, CASE WHEN opportunity_id % 3 <> 0 THEN opportunity_id % 13 END AS assignee_id, CASE WHEN opportunity_id % 4 <> 0 THEN contact_id END AS crm, CASE WHEN opportunity_id % 6 <> 0 THEN price END AS asked, (['Gent', 'GENT', 'Brugge'])[opportunity_id % 3 + 1] AS city, (['private', 'professional'])[opportunity_id % 2 + 1] AS seller_type, (score * 7 % 101)::INTEGER AS relationship FROM opp)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("opportunity_id")
    rows = A.opportunities(spark, sf_dir).withColumns({"assignee_id": F.when(o % 3 != 0, o % 13), "contact_id": F.when(o % 4 != 0, F.col("contact_id")), "price": F.when(o % 6 != 0, F.col("price")), "city": pick(o, "Gent", "GENT", "Brugge"), "seller_type": pick(o, "private", "professional")})
    return rows.withColumn("relationship", (F.col("score") * 7 % 101).cast("int"))


@query(
    f"""WITH {PLACED_SQL}, a AS (SELECT 'price' AS list, opportunity_id FROM (SELECT * FROM pl WHERE crm IS NOT NULL AND lower(city) = 'gent' AND created_at >= {NOW_SQL} - INTERVAL 2000 DAY AND score >= 20 ORDER BY asked DESC NULLS FIRST, score DESC NULLS FIRST, opportunity_id LIMIT 25 OFFSET 25)),
    b AS (SELECT 'relationship', opportunity_id FROM (SELECT * FROM pl WHERE status = 'ASSIGNED' AND seller_type = 'private' AND asked BETWEEN 20000 AND 200000 ORDER BY relationship DESC NULLS FIRST, score DESC NULLS FIRST, opportunity_id LIMIT 25)),
    c AS (SELECT 'newest', opportunity_id FROM (SELECT * FROM pl WHERE assignee_id = 5 ORDER BY created_at DESC NULLS FIRST, opportunity_id LIMIT 25))
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""
)
def work_list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists: by price with contacts in one city, second page; by relationship of private sellers in a price range; the newest of one user."""
    rows, now = placed(spark, sf_dir), A.now()
    lists = {
        "price": serving.work_list(rows, now, status="ALL", crm_only=True, city="gent", max_age_days=2000, least_score=20, sort="price", page=2), "relationship": serving.work_list(rows, now, status="ASSIGNED", seller_type="private", price=(20_000, 200_000), sort="relationship"),
        "newest": serving.work_list(rows, now, status="ALL", assignee=5, sort="newest"),
    }
    out = [df.select(F.lit(name).alias("list"), "opportunity_id") for name, df in lists.items()]
    return out[0].union(out[1]).union(out[2])


@query(
    f"""WITH {PLACED_SQL}, ru AS (SELECT n_nationkey AS rule_id, n_regionkey AS agency_id, 30 + n_nationkey AS least, CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 3) % 24 END AS qs, (n_nationkey * 7) % 24 AS qe, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_nationkey END, CASE WHEN n_regionkey <> 2 THEN 'g' || n_regionkey END) AS chat, n_nationkey % 2 = 0 AS crm_only FROM nation),
    now AS (SELECT * FROM ru WHERE chat IS NOT NULL AND NOT coalesce(CASE WHEN qs < qe THEN 8 >= qs AND 8 < qe WHEN qs > qe THEN 8 >= qs OR 8 < qe ELSE false END, false))
    SELECT rule_id, opportunity_id, score, rank::INTEGER AS rank FROM (SELECT rule_id, opportunity_id, score, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, opportunity_id) AS rank FROM now JOIN pl USING (agency_id) WHERE status = 'NEW' AND score >= least AND (NOT crm_only OR crm IS NOT NULL)) WHERE rank <= 10"""
)
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules send at eight in the morning: quiet hours, some over midnight, chats of rule or agency, contacts required."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    rules = A.read(spark, sf_dir, "nation").select(
        n.alias("rule_id"), r.alias("agency_id"), (30 + n).alias("least_score"), F.lit(10).alias("daily_cap"), F.array().cast("array<string>").alias("types"), F.when(n % 5 != 0, n * 3 % 24).alias("quiet_start"), (n * 7 % 24).alias("quiet_end"),
        F.when(n % 3 == 0, text("r", n)).alias("chat_id"), F.when(r != 2, text("g", r)).alias("agency_chat_id"), (n % 2 == 0).alias("require_crm"),
    )
    nothing = spark.createDataFrame([], "rule_id int, opportunity_id long, today boolean")
    return serving.select_alerts(serving.rules_now(rules, 8), placed(spark, sf_dir).where("status = 'NEW'"), nothing)
