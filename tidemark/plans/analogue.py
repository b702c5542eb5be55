"""The market's tables from the driver's star schema, so that every operator runs on data of any size.

Observations are line items (a part is a listing), properties are parts, sellers are suppliers,
contacts are customers, their interactions and the opportunities are orders, tenants are regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2002-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "private").when(F.col("l_returnflag") == "R", "professional").otherwise("unknown")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").cast("timestamp").alias("observed_at"), "l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") + 0.5).cast("long").alias("price"), kind.alias("seller_type"))


TIE = ("l_orderkey", "l_linenumber")
OBSERVATIONS_SQL = "obs AS (SELECT l_partkey AS listing_id, l_shipdate AS observed_at, l_orderkey, l_linenumber, floor(l_extendedprice + 0.5)::BIGINT AS price, CASE l_returnflag WHEN 'A' THEN 'private' WHEN 'R' THEN 'professional' ELSE 'unknown' END AS seller_type FROM lineitem)"


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    postal = (1000 + F.col("p_partkey") % 9000).cast("string")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("property_id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", postal.alias("postal_code"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.element_at(F.array(*map(F.lit, ("BUYER", "SELLER", "VALUATION_LEAD", "FORMER_CLIENT", "OTHER"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("ACTIVE", "WON", "LOST", "ACTIVE"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("contact_id"), F.col("n_regionkey").alias("agency_id"), kind.alias("contact_type"), status.alias("status"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


CONTACTS_SQL = "con AS (SELECT c_custkey AS contact_id, n_regionkey AS agency_id, (['BUYER','SELLER','VALUATION_LEAD','FORMER_CLIENT','OTHER'])[c_custkey % 5 + 1] AS contact_type, (['ACTIVE','WON','LOST','ACTIVE'])[c_custkey % 4 + 1] AS status, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(contacts(spark, sf_dir).select("contact_id", "agency_id"), F.col("o_custkey") == F.col("contact_id"))
    status = F.element_at(F.array(*map(F.lit, ("NEW", "ASSIGNED", "CONTACTED", "WON", "LOST", "DISMISSED", "SNOOZED"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    origin = F.when(F.col("o_orderstatus") == "P", "CROSS").when(F.col("o_orderstatus") == "F", "LEADREVIVE").otherwise("MARKET")
    snoozed = F.when(F.col("o_orderkey") % 7 == 6, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(1000)))
    return o.select(F.col("o_orderkey").alias("opportunity_id"), "agency_id", "contact_id", status.alias("status"), origin.alias("origin"), F.col("o_orderpriority").alias("type"), (F.col("o_totalprice").cast("long") % 101).cast("int").alias("score"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("created_at"), snoozed.alias("snoozed_until"))


OPPORTUNITIES_SQL = (
    CONTACTS_SQL
    + ", opp AS (SELECT o_orderkey AS opportunity_id, agency_id, contact_id, (['NEW','ASSIGNED','CONTACTED','WON','LOST','DISMISSED','SNOOZED'])[o_orderkey % 7 + 1] AS status, CASE o_orderstatus WHEN 'P' THEN 'CROSS' WHEN 'F' THEN 'LEADREVIVE' ELSE 'MARKET' END AS origin, o_orderpriority AS type, (trunc(o_totalprice)::BIGINT % 101)::INTEGER AS score, o_totalprice AS price, o_orderdate AS created_at, CASE WHEN o_orderkey % 7 = 6 THEN o_orderdate + INTERVAL 1000 DAY END AS snoozed_until FROM orders JOIN con ON o_custkey = contact_id)"
)
