"""Masking of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.masking import LONGEST_LIST, for_log
from tidemark.plans import analogue as A


@query(
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN len(text) > 500 THEN text[:500] || '…' ELSE text END AS says FROM conversations)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(turn || '|' || role || '|' || coalesce(says, '') || '|[redacted]', chr(10) ORDER BY turn, role, says) FILTER (true)) AS turns_sha256, '[redacted]' AS email, max(turn) AS last_turn FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, says) <= 50) GROUP BY 1"""
)
def masked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested records, fit for a log: each turn's phone and the e-mail masked, long texts cut, 50 turns at most."""
    turn = F.struct("turn", "role", F.col("text").alias("says"), F.concat(F.lit("+32"), "turn").alias("phone"))
    # A log shows 50 values of a list, so no more than one beyond is gathered.
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    first = A.read(spark, sf_dir, "conversations").withColumn("nth", nth).where(F.col("nth") <= LONGEST_LIST + 1)
    nested = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.lit("a@b.c").alias("email"))
    log = for_log(nested)
    line = F.transform("turns", lambda t: F.concat_ws("|", t["turn"].cast("string"), t["role"], F.coalesce(t["says"], F.lit("")), t["phone"]))
    return log.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, "\n"), 256).alias("turns_sha256"), "email", F.array_max(F.transform("turns", lambda t: t["turn"])).alias("last_turn"))
