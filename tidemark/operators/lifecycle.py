"""A listing's whole life as events: changes, removal after missed runs, relisting of its property.

Observations: source, property_id, listing_id, observed_at, price, seller_type. A run is a source at
a time, known by what it saw: one that saw nothing is none, so that a failing source removes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between
from tidemark.operators.market import RELIST_WINDOW, REMOVED_AFTER, detect_events, history
from tidemark.operators.upkeep import settled

OBSERVATION = ("source", "property_id", "listing_id", "observed_at", "price", "seller_type")
#: What orders observations of one listing at one time.
TIE = ("price", "seller_type")
EVENT = ("dedupe_key", "property_id", "listing_id", "type", "occurred_at", "old_price", "new_price", "absolute_drop", "percentage_drop", "days_on_market", "drop_count", "seller_type")


def runs_of(observations: DataFrame) -> DataFrame:
    return observations.select("source", "observed_at").distinct()


def numbered(runs: DataFrame) -> DataFrame:
    """(source, run_at, i, last): each source's runs in order, and the number of its last one. One row per run."""
    own = Window.partitionBy("source")
    return runs.select("source", F.col("observed_at").alias("run_at")).withColumns({"i": F.row_number().over(own.orderBy("run_at")), "last": F.count("*").over(own)})


#: Runs up to which they're sent to every task.
SENT = 100_000


def with_misses(runs: DataFrame, threshold: int = REMOVED_AFTER) -> DataFrame:
    """Numbered runs with the times of the next run of the source, and of the ``threshold``-th next."""
    order = Window.partitionBy("source").orderBy("i")
    return runs.withColumns({"missed_at": F.lead("run_at", 1).over(order), "removed_at": F.lead("run_at", threshold).over(order)})


def successors(rows: DataFrame) -> DataFrame:
    """(listing_id, next): the property's next listing by first sight, a listing's at most."""
    first = rows.groupBy("listing_id").agg(F.min(F.struct("observed_at", "price", "seller_type", "property_id", "source")).alias("f")).select("listing_id", "f.*").where("property_id is not null")
    before = F.lag("listing_id").over(Window.partitionBy("property_id").orderBy("observed_at", "listing_id"))
    follows = first.withColumn("previous_id", before).where("previous_id is not null")
    return follows.select(F.col("previous_id").alias("listing_id"), F.struct("listing_id", "property_id", F.col("observed_at").alias("occurred_at"), "price", "seller_type").alias("next"))


def seen_with_runs(observations: DataFrame, runs: DataFrame | None = None, threshold: int = REMOVED_AFTER) -> DataFrame:
    """The history of distinct observations, with what ``life_kinds`` asks of each; one shuffle of them by listing."""
    order = settled(with_misses(numbered(runs_of(observations) if runs is None else runs), threshold).withColumnRenamed("run_at", "observed_at"))
    order = F.broadcast(order) if order.count() <= SENT else order
    rows = observations.select(*OBSERVATION).repartition("listing_id").distinct().join(order, ["source", "observed_at"])
    seen = history(rows.join(successors(rows), "listing_id", "left"), tie=TIE)
    w = Window.partitionBy("listing_id").orderBy("observed_at", *TIE)
    long = F.coalesce(F.lead("i").over(w), F.col("last") + 1) - F.col("i") - 1 >= threshold
    out = seen.withColumns({"is_long": long, "later_at": F.lead("observed_at").over(w)})
    return out.withColumn("long_gaps", F.sum(F.col("is_long").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def life_kinds(window_days: int = RELIST_WINDOW) -> tuple[tuple[str, Column, Column], ...]:
    """(type, condition, dedupe_key) of removal and relisting, of rows of ``seen_with_runs``.

    LISTING_REMOVED: at the run that missed the listing for the threshold's time in a row, the first time.
    RELISTED, an event of the next listing of the property: this one was gone when that was first seen. Gone
    is what its source's next run missed before; since its removal, or else its last sight before.
    """
    c = F.col
    at = c("next.occurred_at")
    gone = c("is_long") & (c("long_gaps") == 1) & c("removed_at").isNotNull()
    last = (c("observed_at") < at) & (c("later_at").isNull() | (c("later_at") >= at))
    since = F.when(c("removed_at") < at, c("removed_at")).otherwise(c("observed_at"))
    again = last & (c("missed_at") < at) & (days_between(since, at) <= window_days)
    return (("LISTING_REMOVED", gone, F.concat_ws(":", c("listing_id").cast("string"), F.lit("LISTING_REMOVED"))), ("RELISTED", again, F.concat_ws(":", c("next.listing_id").cast("string"), F.lit("RELISTED"), c("listing_id").cast("string"))))


def lifecycle_events(observations: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """All events of the observations, columns EVENT; ``runs`` where they are known apart (source, observed_at).

    Whatever the order and repetition in which observations come, the events are the same: those of
    one listing at one time are ordered by price and seller type, and equal ones count once. Rows
    without a property relist nothing.
    """
    carry = ("property_id", "first_seen", "removed_at", "price", "next")
    found = detect_events(seen_with_runs(observations, runs), carry=carry, more=life_kinds())
    is_, c = (lambda name: F.col("type") == name), F.col
    removed, again = is_("LISTING_REMOVED"), is_("RELISTED")
    days = F.when(c("type").startswith("STALE_"), days_between(c("first_seen"), c("occurred_at"))).when(removed, days_between(c("first_seen"), c("removed_at")))
    of_next = lambda name, other: F.when(again, c(f"next.{name}")).otherwise(other)
    return found.select(
        "dedupe_key", of_next("property_id", c("property_id")).alias("property_id"), of_next("listing_id", c("listing_id")).alias("listing_id"), "type", F.when(removed, c("removed_at")).otherwise(of_next("occurred_at", c("occurred_at"))).alias("occurred_at"),
        F.when(again, c("price")).otherwise(c("old_price")).alias("old_price"), of_next("price", c("new_price")).alias("new_price"), "absolute_drop", "percentage_drop", days.alias("days_on_market"),
        F.when(again, F.lit(0)).otherwise(c("drop_count")).alias("drop_count"), of_next("seller_type", c("seller_type")).alias("seller_type"),
    ).select(*EVENT)
