"""Queries over users' actions, replayed one by one in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog_flow import pick, pick_sql
from tidemark.operators import actions as acts
from tidemark.plans import analogue as A

STATUSES = (None, "CONTACTED", "WON", None, "SNOOZED", "LOST", "CONTACTED")
#: Line items are actions on the opportunity that is their order; some name another agency.
ACTIONS_SQL = f"""{A.OPPORTUNITIES_SQL}, st AS (SELECT opportunity_id, agency_id, status, created_at AS status_changed_at, NULL::TIMESTAMP AS contacted_at, snoozed_until, 'old' AS note, CASE WHEN opportunity_id % 3 = 0 THEN opportunity_id % 11 END AS assignee_id FROM opp),
    k AS (SELECT l_orderkey AS opportunity_id, l_partkey * 10 + l_linenumber AS action_id, l_partkey AS p, l_suppkey AS user_id, l_shipdate AS at_ FROM lineitem),
    ac AS (SELECT k.*, {pick_sql('(p + action_id)', *STATUSES)} AS new_status, p % 6 = 1 AS sets_snooze, CASE WHEN p % 12 = 1 THEN at_ + INTERVAL 30 DAY END AS snooze, CASE p % 4 WHEN 0 THEN 'n' || p WHEN 1 THEN '' END AS new_note, p % 3 = 0 AS sets_assignee, CASE WHEN p % 9 <> 0 THEN p % 13 END AS assignee,
      row_number() OVER (PARTITION BY k.opportunity_id ORDER BY at_, action_id) AS n FROM k JOIN st ON st.opportunity_id = k.opportunity_id WHERE p % 10 <> 7),
    r AS (SELECT opportunity_id, agency_id, 0::BIGINT AS n, status, status AS before, status_changed_at, contacted_at, snoozed_until, note, assignee_id FROM st
      UNION ALL SELECT r.opportunity_id, agency_id, ac.n, CASE WHEN snooze IS NOT NULL THEN 'SNOOZED' ELSE coalesce(new_status, status) END, status, CASE WHEN snooze IS NOT NULL OR coalesce(new_status <> status, false) THEN at_ ELSE status_changed_at END, CASE WHEN new_status = 'CONTACTED' AND status <> 'CONTACTED' THEN at_ ELSE contacted_at END,
        CASE WHEN sets_snooze THEN snooze WHEN coalesce(new_status <> status AND new_status <> 'SNOOZED', false) THEN NULL ELSE snoozed_until END, coalesce(nullif(new_note, ''), note), CASE WHEN sets_assignee THEN assignee ELSE assignee_id END
      FROM r JOIN ac ON ac.opportunity_id = r.opportunity_id AND ac.n = r.n + 1)"""


def worked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("opportunity_id")
    none = lambda kind: F.lit(None).cast(kind)
    state = A.opportunities(spark, sf_dir).select("opportunity_id", "agency_id", "status", F.col("created_at").alias("status_changed_at"), none("timestamp").alias("contacted_at"), "snoozed_until", F.lit("old").alias("note"), F.when(key % 3 == 0, key % 11).alias("assignee_id"))
    p, at = F.col("l_partkey"), F.col("l_shipdate").cast("timestamp")
    lines = A.read(spark, sf_dir, "lineitem").join(state.select(key.alias("l_orderkey"), "agency_id"), "l_orderkey")
    actions = lines.select(
        (p * 10 + F.col("l_linenumber")).alias("action_id"), F.col("l_orderkey").alias("opportunity_id"), F.when(p % 10 == 7, 99).otherwise(F.col("agency_id")).alias("agency_id"), F.col("l_suppkey").alias("user_id"), F.lit("EDIT").alias("kind"), at.alias("at"), pick(p * 11 + F.col("l_linenumber"), *STATUSES).alias("status"),
        (p % 6 == 1).alias("sets_snooze"), F.when(p % 12 == 1, at + F.make_dt_interval(F.lit(30))).alias("snoozed_until"), F.when(p % 4 == 0, F.concat(F.lit("n"), p)).when(p % 4 == 1, "").alias("note"), (p % 3 == 0).alias("sets_assignee"), F.when(p % 9 != 0, p % 13).alias("assignee_id"),
    )
    return state, actions


@query(f"WITH RECURSIVE {ACTIONS_SQL} SELECT opportunity_id, agency_id, status, status_changed_at, contacted_at, snoozed_until, note, assignee_id FROM r QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY n DESC) = 1")
def opportunity_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opportunity after all actions on it."""
    return acts.apply_actions(*worked(spark, sf_dir))


@query(f"WITH RECURSIVE {ACTIONS_SQL} SELECT r.opportunity_id, action_id, user_id, 'EDIT' AS kind, at_ AS at, before AS from_status, coalesce(new_status, before) AS to_status, nullif(new_note, '') AS note FROM r JOIN ac ON ac.opportunity_id = r.opportunity_id AND ac.n = r.n")
def opportunity_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that the actions leave."""
    return acts.activities(*worked(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {ACTIONS_SQL}, c AS (SELECT opportunity_id, min(at_) AS f FROM ac WHERE sets_assignee GROUP BY 1), o AS (SELECT *, lead(at_) OVER (PARTITION BY opportunity_id ORDER BY n) AS e FROM ac WHERE sets_assignee)
    SELECT opportunity_id, assignee_id AS assigned_to, 0::BIGINT AS assigned_by, status_changed_at AS assigned_at, f AS unassigned_at, NULL::VARCHAR AS reason FROM st LEFT JOIN c USING (opportunity_id) WHERE assignee_id IS NOT NULL
    UNION ALL SELECT opportunity_id, assignee, user_id, at_, e, nullif(new_note, '') FROM o WHERE assignee IS NOT NULL"""
)
def opportunity_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who had each opportunity, from when to when."""
    state, actions = worked(spark, sf_dir)
    before = state.where("assignee_id is not null").select("opportunity_id", F.col("assignee_id").alias("assigned_to"), F.lit(0).cast("long").alias("assigned_by"), F.col("status_changed_at").alias("assigned_at"), F.lit(None).cast("timestamp").alias("unassigned_at"), F.lit(None).cast("string").alias("reason"))
    return acts.reassigned(before, state, actions)
