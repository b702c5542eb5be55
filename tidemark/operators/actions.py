"""What users do with opportunities: a batch of actions merged into state, assignments with their intervals, activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an action may have: it sets a status, a snooze (or ends it), a note, an assignee (or none).
ACTION = ("action_id", "opportunity_id", "agency_id", "user_id", "kind", "at", "status", "sets_snooze", "snoozed_until", "note", "sets_assignee", "assignee_id")


def replayed(state: DataFrame, actions: DataFrame) -> DataFrame:
    """The actions that count, in the order of time and number, each with the status before it and what it changes.

    An action on another agency's opportunity, or on none, counts for nothing. One shuffle by opportunity;
    what an action leaves is the last value set so far.
    """
    own = state.select("opportunity_id", "agency_id", F.col("status").alias("_status"))
    rows = actions.select(*ACTION).join(own, ["opportunity_id", "agency_id"])
    order = Window.partitionBy("opportunity_id").orderBy("at", "action_id")
    snoozes = F.col("sets_snooze") & F.col("snoozed_until").isNotNull()
    after = F.last(F.when(snoozes, "SNOOZED").otherwise(F.col("status")), ignorenulls=True).over(order)
    rows = rows.withColumn("_after", F.coalesce(after, F.col("_status")))
    rows = rows.withColumn("from_status", F.coalesce(F.lag("_after").over(order), F.col("_status")))
    moves = F.coalesce(F.col("status") != F.col("from_status"), F.lit(False))
    ended = F.when(F.col("sets_snooze"), F.struct("snoozed_until")).when(moves & (F.col("status") != "SNOOZED"), F.struct(F.lit(None).cast("timestamp").alias("snoozed_until")))
    return rows.withColumns({"changed_at": F.when(moves | snoozes, F.col("at")), "contacted_at": F.when(moves & (F.col("status") == "CONTACTED"), F.col("at")), "snooze": ended, "noted": F.nullif(F.col("note"), F.lit(""))})


def apply_actions(state: DataFrame, actions: DataFrame) -> DataFrame:
    """State after the batch: status, status_changed_at, contacted_at, snoozed_until, note and assignee_id; other columns as they were."""
    order = F.struct("at", "action_id")
    last = lambda value, cond: F.max_by(value, F.when(cond, order))
    set_ = {c: last(F.col(v), F.col(v).isNotNull()) for c, v in {"status_changed_at": "changed_at", "contacted_at": "contacted_at", "note": "noted", "snooze": "snooze"}.items()}
    done = replayed(state, actions).groupBy("opportunity_id").agg(F.max_by("_after", order).alias("_status"), *(v.alias(f"_{c}") for c, v in set_.items()), last(F.struct("assignee_id"), F.col("sets_assignee")).alias("_assigned"))
    new = {
        "status": F.coalesce("_status", "status"), **{c: F.coalesce(f"_{c}", c) for c in ("status_changed_at", "contacted_at", "note")},
        "snoozed_until": F.when(F.col("_snooze").isNotNull(), F.col("_snooze.snoozed_until")).otherwise(F.col("snoozed_until")), "assignee_id": F.when(F.col("_assigned").isNotNull(), F.col("_assigned.assignee_id")).otherwise(F.col("assignee_id")),
    }
    return state.join(done, "opportunity_id", "left").withColumns(new).select(*state.columns)


def activities(state: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per action that counts: who did what, from which status to which."""
    return replayed(state, actions).select("opportunity_id", "action_id", "user_id", "kind", "at", "from_status", F.coalesce("status", "from_status").alias("to_status"), F.col("noted").alias("note"))


def reassigned(assignments: DataFrame, state: DataFrame, actions: DataFrame) -> DataFrame:
    """Assignments with their intervals: an action that sets an assignee closes what is open, and opens the next unless it sets none.

    assignments: opportunity_id, assigned_to, assigned_by, assigned_at, unassigned_at, reason.
    """
    moves = replayed(state, actions).where("sets_assignee")
    order = Window.partitionBy("opportunity_id").orderBy("at", "action_id")
    opened = moves.withColumn("unassigned_at", F.lead("at").over(order)).where("assignee_id is not null")
    opened = opened.select("opportunity_id", F.col("assignee_id").alias("assigned_to"), F.col("user_id").alias("assigned_by"), F.col("at").alias("assigned_at"), "unassigned_at", F.col("noted").alias("reason"))
    first = moves.groupBy("opportunity_id").agg(F.min("at").alias("_first"))
    closed = assignments.join(first, "opportunity_id", "left").withColumn("unassigned_at", F.coalesce("unassigned_at", "_first")).select(*opened.columns)
    return closed.union(opened)
