"""State after imports and runs: contact changes, relations, interactions, sources, tenants, outbox."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_poorer_name
from tidemark.operators.market import MIN_CHANGE_PERCENT

TEXTS = ("display_name", "email", "phone", "postal_code", "city", "address_key")


def settled(df: DataFrame, needed: bool = False) -> DataFrame:
    """Cut lineage here, so that what is used many times is planned and read once.

    It's written to the shared folder that ``spark.checkpoint.dir`` names. Where none is named, it stays
    as it is; where it's ``needed``, a session on one machine takes a folder of its own, and a cluster fails.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not needed:
        return df
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)



def contact_changes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(contact_id, changes): map of field to (before, after) for contacts that an import would change.

    What is empty never overwrites, a name that only loses words doesn't either; UNKNOWN isn't
    news; created_at takes the earliest, last_contact_at the latest value. Both: contact_id,
    display_name, email, phone, postal_code, city, address_key, contact_type, status, created_at, last_contact_at.
    """
    j = existing.alias("e").join(incoming.alias("i"), "contact_id")
    e, i = (lambda f: F.col(f"e.{f}")), (lambda f: F.col(f"i.{f}"))
    differs = {f: (F.coalesce(i(f), F.lit("")) != "") & ~i(f).eqNullSafe(e(f)) for f in TEXTS}
    differs["display_name"] = differs["display_name"] & ~F.coalesce(is_poorer_name(e("display_name"), i("display_name")), F.lit(False))
    differs |= {f: F.coalesce((i(f) != "UNKNOWN") & ~i(f).eqNullSafe(e(f)), F.lit(False)) for f in ("contact_type", "status")}
    differs["created_at"] = F.coalesce(i("created_at").isNotNull() & (e("created_at").isNull() | (i("created_at") < e("created_at"))), F.lit(False))
    differs["last_contact_at"] = F.coalesce(i("last_contact_at").isNotNull() & (e("last_contact_at").isNull() | (i("last_contact_at") > e("last_contact_at"))), F.lit(False))
    entry = lambda f: F.struct(F.lit(f).alias("key"), F.struct(e(f).cast("string").alias("before"), i(f).cast("string").alias("after")).alias("value"))
    changes = F.map_from_entries(F.array_compact(F.array(*(F.when(cond, entry(f)) for f, cond in differs.items()))))
    return j.select("contact_id", changes.alias("changes")).where(F.size("changes") > 0)


RELATION = ["agency_id", "contact_id", "address_key", "role"]


def upsert_listings(state: DataFrame, seen: DataFrame, content: tuple[str, ...] = ("price",), least_percent: float = MIN_CHANGE_PERCENT) -> DataFrame:
    """Listings after a run. What was seen is ACTIVE with no missed run, seen last now, and takes its class; the content only where its hash differs.

    state: listing_id, ``content``, seller_type, content_hash, first_price, first_seen, last_seen, status,
    missed_runs, drop_count. seen: listing_id, ``content``, seller_type, content_hash, observed_at, one row a
    listing. A price that fell by ``least_percent`` at least counts as a drop. Others stay as they are.
    """
    new = seen.select("listing_id", *(F.col(c).alias(f"_{c}") for c in (*content, "seller_type", "content_hash", "observed_at")))
    j = state.join(new, "listing_id", "full")
    there, known = F.col("_observed_at").isNotNull(), F.col("first_seen").isNotNull()
    changed = there & ~F.col("content_hash").eqNullSafe(F.col("_content_hash"))
    fell = changed & (F.col("_price") > 0) & (F.col("_price") < F.col("price")) & ((F.col("price") - F.col("_price")) / F.col("price") * 100 >= least_percent)
    take = lambda cond, c, value: F.when(cond, value).otherwise(F.col(c)).alias(c)
    return j.select(
        "listing_id", *(take(changed, c, F.col(f"_{c}")) for c in (*content, "content_hash")), take(there, "seller_type", F.col("_seller_type")), take(~known, "first_price", F.col("_price")), take(~known, "first_seen", F.col("_observed_at")), take(there, "last_seen", F.col("_observed_at")),
        take(there, "status", F.lit("ACTIVE")), take(there, "missed_runs", F.lit(0)), (F.coalesce("drop_count", F.lit(0)) + F.coalesce(fell, F.lit(False)).cast("int")).alias("drop_count"),
    )


def merge_relations(state: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per agency, contact, address and role; a known one only takes the batch's property, if it names one.

    Both: the key columns, property_id and since. Rows without an address are left out.
    """
    new = batch.where("address_key is not null").groupBy(*RELATION).agg(F.max("property_id").alias("_property"), F.min("since").alias("_since"))
    j = state.withColumn("_known", F.lit(True)).join(new, RELATION, "full")
    return j.select(*RELATION, F.coalesce("_property", "property_id").alias("property_id"), F.when(F.col("_known"), F.col("since")).otherwise(F.col("_since")).alias("since"))


def attach_properties(relations: DataFrame, properties: DataFrame) -> DataFrame:
    """Relations of all agencies whose address turns up as a property get its id; what they have stays."""
    known = properties.where("match_key is not null").groupBy(F.col("match_key").alias("address_key")).agg(F.min("property_id").alias("_found"))
    return relations.join(known, "address_key", "left").withColumn("property_id", F.coalesce("property_id", "_found")).select(*relations.columns)


def add_interactions(contacts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Contacts with last_contact_at moved forward to their newest interaction."""
    newest = interactions.groupBy("contact_id").agg(F.max("at").alias("_at"))
    return contacts.join(newest, "contact_id", "left").withColumn("last_contact_at", F.greatest("last_contact_at", "_at")).select(*contacts.columns)


def import_outcome(staged: DataFrame, matches: DataFrame, changes: DataFrame) -> DataFrame:
    """(row_id, outcome): of each staged row REJECTED, CREATED, UPDATED or UNCHANGED.

    staged: row_id, usable. matches: row_id, contact_id. changes: contact_id.
    """
    j = staged.join(matches.select("row_id", "contact_id"), "row_id", "left").join(changes.select("contact_id", F.lit(True).alias("_changed")).distinct(), "contact_id", "left")
    return j.select("row_id", F.when(~F.col("usable"), "REJECTED").when(F.col("contact_id").isNull(), "CREATED").when(F.col("_changed"), "UPDATED").otherwise("UNCHANGED").alias("outcome"))


def finish_runs(sources: DataFrame, runs: DataFrame, cooldown_minutes: int = 30) -> DataFrame:
    """Sources after one run each: failures in a row, cooldown from the third one on, last run.

    sources: key, failures, cooldown_until, last_run_at. runs: key, status, finished_at. The
    cooldown doubles with each further failure, four times the first at most.
    """
    j = sources.join(runs, "key", "left")
    ran, failed = F.col("finished_at").isNotNull(), F.coalesce(F.col("status") == "FAILED", F.lit(False))
    failures = F.when(~ran, F.col("failures")).when(failed, F.col("failures") + 1).otherwise(0)
    minutes = cooldown_minutes * F.least(F.lit(4.0), F.pow(F.lit(2.0), failures - 3))
    until = F.when(~ran, F.col("cooldown_until")).when(failed & (failures >= 3), F.col("finished_at") + F.make_dt_interval(mins=minutes.cast("int"))).when(failed, F.col("cooldown_until"))
    return j.select("key", failures.cast("int").alias("failures"), until.alias("cooldown_until"), F.coalesce("finished_at", "last_run_at").alias("last_run_at"))


def purge_agency(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the agencies that are gone (agency_id)."""
    ids = gone.select("agency_id").distinct()
    return {name: table.join(ids, "agency_id", "left_anti") for name, table in tables.items()}


def anonymise_audit(audit: DataFrame, gone: DataFrame) -> DataFrame:
    """The audit's rows stay; actor and details of agencies that are gone don't."""
    ids = gone.select("agency_id", F.lit(True).alias("_gone")).distinct()
    j = audit.join(ids, "agency_id", "left")
    return j.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("actor", "detail")}).select(*audit.columns)


def redact_sellers(sellers: DataFrame, listings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sellers without name, phone and e-mail, and their listings without description and seller name."""
    ids = gone.select("seller_id", F.lit(True).alias("_gone")).distinct()
    hide = lambda rows, fields: rows.join(ids, "seller_id", "left").withColumns({f: F.when(F.col("_gone").isNull(), F.col(f)) for f in fields}).select(*rows.columns)
    return hide(sellers, ("name", "phone", "email")), hide(listings, ("description", "seller_name"))


def outbox(selected: DataFrame, alerts: DataFrame, now: Column, delivered: DataFrame | None = None) -> DataFrame:
    """The alert table after a selection, and after what the sender says of it.

    selected: rule_id, opportunity_id, and chat_id where there is one. alerts: rule_id, opportunity_id, status, at.
    A pair is reserved once: what was SENT, or waits, isn't reserved again, what FAILED is. Without a
    chat it's SUPPRESSED_DRY_RUN. delivered: rule_id, opportunity_id, ok; a pair that waits becomes SENT or FAILED.
    """
    pair = ["rule_id", "opportunity_id"]
    chat = F.lit(None).cast("string") if "chat_id" not in selected.columns else F.col("chat_id")
    fresh = selected.select(*pair, chat.alias("chat_id")).dropDuplicates(pair).withColumn("_fresh", F.lit(True))
    j = alerts.select(*pair, "status", "at").join(fresh, pair, "full")
    again = F.col("_fresh") & (F.col("status").isNull() | (F.col("status") == "FAILED"))
    new = F.when(F.col("chat_id").isNull(), "SUPPRESSED_DRY_RUN").otherwise("PENDING")
    out = j.select(*pair, F.when(again, new).otherwise(F.col("status")).alias("status"), F.when(again, now).otherwise(F.col("at")).alias("at"))
    if delivered is None:
        return out
    told = delivered.groupBy(*pair).agg(F.bool_or("ok").alias("ok"))
    j = out.join(told, pair, "left")
    sent = (F.col("status") == "PENDING") & F.col("ok").isNotNull()
    return j.select(*pair, F.when(sent, F.when(F.col("ok"), "SENT").otherwise("FAILED")).otherwise(F.col("status")).alias("status"), F.when(sent, now).otherwise(F.col("at")).alias("at"))


def write_snapshots(changed: DataFrame, path: str) -> None:
    """Adds observations whose content changed, by day. A row that is there already isn't added again, so a repeat changes nothing.

    Only the days that the batch has are read, and only they are written anew.
    """
    spark = changed.sparkSession
    new = settled(changed.withColumn("day", F.to_date("observed_at")).distinct(), needed=True)
    rows = new
    if has_files(spark, path):
        days = [r[0] for r in new.select("day").distinct().collect()]  # one value per day of the batch
        there = spark.read.schema(new.schema).parquet(path).where(F.col("day").isin(days) if days else F.lit(False)).select(*new.columns)
        rows = settled(there.union(new).distinct(), needed=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stage_rows(rows: DataFrame, path: str) -> None:
    """Adds an import's rows once each by (import_id, row_number); rows staged by an earlier batch are skipped, so a repeat adds nothing."""
    spark, key = rows.sparkSession, ["import_id", "row_number"]
    fresh = rows.dropDuplicates(key)
    if has_files(spark, path):
        there = spark.read.schema(rows.schema).parquet(path).join(rows.select("import_id").distinct(), "import_id", "left_semi")
        fresh = settled(fresh.join(there.select(*key), key, "left_anti"), needed=True)
    fresh.write.mode("append").partitionBy("import_id").parquet(path)


def has_files(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
