"""What is kept for how long: redaction, retention and purge of all tables at once or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.upkeep import anonymise_audit, purge_agency

Tables = dict[str, DataFrame]
#: Days for which each kind is kept; 0 keeps it for ever.
DAYS = {"seller_contact": 365, "raw_payload": 90, "removed_listing": 730, "import_rows": 90, "crm_contact": 1095}
ERASED = "[gewist op verzoek]"


def cleared(rows: DataFrame, gone: Column, *fields: str, **values: Column) -> DataFrame:
    """Where ``gone`` holds, the fields null and the values set; other rows as they were."""
    sure, types = F.coalesce(gone, F.lit(False)), dict(rows.dtypes)
    new = {f: F.lit(None).cast(types[f]) for f in fields} | {f: v.cast(types[f]) for f, v in values.items()}
    return rows.withColumns({f: F.when(sure, v).otherwise(F.col(f)) for f, v in new.items()})


def marked(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with _gone, true where ``ids`` has their key."""
    return rows.join(ids.select(*on).distinct().withColumn("_gone", F.lit(True)), on, "left")


def redact_contacts(t: Tables, gone: DataFrame, now: Column) -> Tables:
    """Contacts (agency_id, contact_id in ``gone``) without what names them, and their traces in interactions, import rows, opportunities, activities and alerts."""
    pair = ["agency_id", "contact_id"]
    hide = lambda name, *fields, **values: cleared(marked(t[name], gone, pair), F.col("_gone"), *fields, **values).select(*t[name].columns)
    ids = t["opportunities"].join(gone.select(*pair).distinct(), pair, "left_semi").select("opportunity_id")
    of = lambda name, *fields, **values: cleared(marked(t[name], ids, ["opportunity_id"]), F.col("_gone"), *fields, **values).select(*t[name].columns)
    return t | {
        "contacts": hide("contacts", "name", "email", "phone", "address", "notes", redacted_at=now), "interactions": hide("interactions", "summary", "agent_name"), "import_rows": hide("import_rows", "raw", "changes", raw_cleared_at=now),
        "opportunities": hide("opportunities", "note"), "activities": of("activities", "note"), "alerts": of("alerts", message=F.lit(ERASED)),
    }


def redact_sellers(t: Tables, gone: DataFrame, now: Column) -> Tables:
    """Sellers (seller_id in ``gone``) without name and phone, their listings marked, the snapshots of those without seller."""
    own = t["listings"].join(gone.select("seller_id").distinct(), "seller_id", "left_semi").select("listing_id")
    new = {"sellers": (marked(t["sellers"], gone, ["seller_id"]), ("name", "phone"), {"redacted_at": now}), "listings": (marked(t["listings"], gone, ["seller_id"]), (), {"redacted_at": now}), "snapshots": (marked(t["snapshots"], own, ["listing_id"]), ("seller_phone", "seller_name"), {})}
    return t | {name: cleared(rows, F.col("_gone"), *fields, **values).select(*t[name].columns) for name, (rows, fields, values) in new.items()}


def silent_contacts(t: Tables, cutoff: Column) -> DataFrame:
    """(agency_id, contact_id) not yet redacted, last heard of before the cutoff, without an interaction since."""
    recent = t["interactions"].where(F.col("at") >= cutoff).select("agency_id", "contact_id").distinct()
    old = t["contacts"].where(F.col("redacted_at").isNull() & (F.coalesce("last_contact_at", "source_created_at", "created_at") < cutoff))
    return old.select("agency_id", "contact_id").join(recent, ["agency_id", "contact_id"], "left_anti")


def retain(t: Tables, now: Column, days: dict[str, int] | None = None) -> Tables:
    """All tables after a run of the retention rules: seller data, payloads, removed listings, import rows, silent contacts."""
    days = DAYS | (days or {})
    before = lambda kind: now - F.make_dt_interval(F.lit(days[kind]))
    if days["seller_contact"]:
        t = t | {"snapshots": cleared(t["snapshots"], F.col("captured_at") < before("seller_contact"), "seller_phone"), "sellers": cleared(t["sellers"], F.col("redacted_at").isNull() & (F.col("last_seen") < before("seller_contact")), "name", "phone", redacted_at=now)}
    if days["raw_payload"]:
        t = t | {"snapshots": cleared(t["snapshots"], F.col("captured_at") < before("raw_payload"), "raw")}
    if days["removed_listing"]:
        gone = F.coalesce((F.col("status") == "REMOVED") & (F.col("removed_at") < before("removed_listing")), F.lit(False))
        t = t | {"listings": t["listings"].where(~gone), "snapshots": t["snapshots"].join(t["listings"].where(gone).select("listing_id"), "listing_id", "left_anti").select(*t["snapshots"].columns)}
    if days["import_rows"]:
        t = t | {"import_rows": cleared(t["import_rows"], F.col("raw_cleared_at").isNull() & (F.col("created_at") < before("import_rows")), "raw", "changes", raw_cleared_at=now)}
    if days["crm_contact"]:
        t = redact_contacts(t, silent_contacts(t, before("crm_contact")), now)
    return t


def purge(t: Tables, gone: DataFrame) -> Tables:
    """All tables without the agencies in ``gone`` (agency_id); the audit's rows stay without actor and detail, alerts and activities go with their opportunities."""
    own = {n: rows for n, rows in t.items() if "agency_id" in rows.columns and n != "audit"}
    left = t["opportunities"].join(gone.select("agency_id").distinct(), "agency_id", "left_anti").select("opportunity_id")
    children = {n: t[n].join(left, "opportunity_id", "left_semi").select(*t[n].columns) for n in ("activities", "alerts")}
    return t | {n: rows.select(*t[n].columns) for n, rows in purge_agency(own, gone).items()} | children | {"audit": anonymise_audit(t["audit"], gone)}


class Kept:
    """Tables that change together: files stay as they were written, and a list names those that count, swapped last.

    Each table is dealt into ``parts`` by its key's hash. A change writes anew only the parts whose rows
    differ, then the list, under a new number and by a rename; until then, and after a failure, readers see
    all tables as they were before. Files of a change that failed are never listed.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, list[str]], parts: int = 32):
        self.spark, self.folder, self.keys, self.parts = spark, folder, keys, parts
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self) -> tuple[int, dict]:
        """The last list's number and {table: {"schema": .., "parts": {part: path}}}."""
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(f"{self.folder}/lists"))] if self.files.exists(self.path(f"{self.folder}/lists")) else []
        last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)
        if last < 0:
            return -1, {}
        return last, json.loads(self.spark.read.text(f"{self.folder}/lists/{last}.json", wholetext=True).first()[0])

    def tables(self) -> Tables:
        """Every table as it stands."""
        return {name: self.read(entry) for name, entry in self.listed()[1].items()}

    def read(self, entry: dict, parts: list[str] | None = None) -> DataFrame:
        paths = [p for k, p in sorted(entry["parts"].items()) if parts is None or k in parts]
        return self.spark.read.schema(entry["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], entry["schema"])

    def dealt(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.parts)).cast("int"))

    def sums(self, name: str, rows: DataFrame) -> dict[int, tuple]:
        """Of each part: its rows and the sum of their hashes. ``parts`` rows at most."""
        content = F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
        return {r[0]: (r[1], r[2]) for r in self.dealt(name, rows).groupBy("_part").agg(F.count("*"), F.sum(content)).collect()}

    def change(self, new: Callable[[Tables], Tables] | Tables) -> dict[str, list[int]]:
        """Replace the tables by what ``new`` makes of them; returns the parts of each that were written."""
        number, listed = self.listed()
        tables = new({n: self.read(e) for n, e in listed.items()}) if callable(new) else new
        mark, out, written = uuid.uuid4().hex, dict(listed), {}
        for name, rows in tables.items():
            old, now = self.sums(name, self.read(listed[name])) if name in listed else {}, self.sums(name, rows)
            touched = sorted(p for p in old.keys() | now.keys() if old.get(p) != now.get(p))
            kept = {p: f for p, f in listed.get(name, {"parts": {}})["parts"].items() if int(p) not in touched}
            if touched:
                path = f"{self.folder}/files/{mark}/{name}"
                self.dealt(name, rows).where(F.col("_part").isin(touched)).repartition("_part").write.partitionBy("_part").parquet(path)
                kept |= {str(p): f"{path}/_part={p}" for p in touched if p in now}
            if name in listed or rows.columns:
                out[name] = {"schema": ", ".join(f"`{c}` {k}" for c, k in rows.dtypes), "parts": kept}
            written[name] = touched
        self.swap(number + 1, out)
        return written

    def swap(self, number: int, listed: dict) -> None:
        """Make the list count: it's written aside, and a rename, which fails where the number is taken, brings it in."""
        aside, at = self.path(f"{self.folder}/lists/.{uuid.uuid4().hex}"), self.path(f"{self.folder}/lists/{number}.json")
        stream = self.files.create(aside, False)
        stream.write(bytearray(json.dumps(listed).encode()))
        stream.close()
        if self.files.exists(at) or not self.files.rename(aside, at):
            raise RuntimeError(f"another change took number {number}")
