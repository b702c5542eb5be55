"""Which pages a site's robots rules let a reader fetch: rules as rows, longest rule wins, by joins on prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, type, path, delay) of the group that holds for the agent; files: origin, content.

    The group with the longest name that the agent's name contains wins, then ``*``. Lines that name agents
    one after another open one group. Groups without a rule, and files without a group for the agent, give none;
    an empty Disallow is no rule.
    """
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    rows = files.select("origin", F.posexplode(F.split("content", "\r?\n")).alias("nr", "raw")).select("origin", "nr", line.alias("line")).where(F.contains("line", F.lit(":")))
    field, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    rows = rows.select("origin", "nr", field.alias("field"), value.alias("value")).where("field <> 'sitemap'")
    order = Window.partitionBy("origin").orderBy("nr")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = rows.withColumn("opens", opens.cast("int")).withColumn("nth", F.sum("opens").over(order)).where("nth > 0")
    # A group's name for the agent: the longest that the agent contains; * has length 0. Of several the first group counts.
    name = F.lower("value")
    fits = grouped.where("field = 'user-agent'").withColumn("length", F.when(name == "*", 0).when(F.contains(F.lit(agent.lower()), name), F.length(name)))
    best = fits.where("length is not null").groupBy("origin").agg(F.max_by("nth", F.struct("length", -F.col("nth"))).alias("nth"))
    own = grouped.join(best, ["origin", "nth"])
    delay = F.max_by(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double")), F.when((F.col("field") == "crawl-delay") & (F.col("value").try_cast("double") >= 0), F.col("nr"))).over(Window.partitionBy("origin"))
    rules = own.withColumn("delay", F.coalesce(delay, F.lit(0.0))).where(F.col("field").isin("allow", "disallow") & ~((F.col("field") == "disallow") & (F.col("value") == "")))
    return rules.select("origin", F.col("field").alias("type"), F.when(F.col("value") == "", "/").otherwise(F.col("value")).alias("path"), F.length("value").alias("length"), "delay")


def as_pattern(path: Column) -> Column:
    """A rule's path as a regular expression: ``*`` is anything, a ``$`` at the end anchors, all else is itself."""
    body = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def allowed_pages(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, allowed, rule, delay): the longest rule that fits a page's path decides, Allow before Disallow.

    pages: key, url. A rule can only fit a path that begins with what the rule has before its first ``*``
    or ``$``, so rules are joined on that prefix to the prefixes of the paths, of those lengths that an origin's
    rules have; only pairs that share it are tried as patterns.
    """
    rest = F.regexp_replace("url", "^[a-z]+://[^/?#]+", "")
    path = F.regexp_replace(rest, "#.*$", "")
    rows = pages.select(key, F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("origin"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("asked"))
    rows = rows.withColumn("asked", F.regexp_replace("asked", r"\?.*$", ""))
    fixed = rules.withColumn("prefix", F.regexp_extract("path", r"^([^*$]*)", 1))
    lengths = fixed.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = rows.join(lengths, "origin").select(key, "origin", "asked", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("asked")).withColumn("prefix", F.substring("asked", F.lit(1), F.col("n")))
    hits = cut.join(fixed, ["origin", "prefix"]).where(F.regexp_like("asked", as_pattern(F.col("path"))))
    winner = hits.groupBy(key).agg(F.max_by(F.struct("type", "path"), F.struct("length", (F.col("type") == "allow").cast("int"), "path")).alias("w"))
    delays = rules.groupBy("origin").agg(F.max("delay").alias("delay"))
    out = rows.select(key, "origin").join(winner, key, "left").join(delays, "origin", "left")
    return out.select(key, (F.col("w").isNull() | (F.col("w.type") == "allow")).alias("allowed"), F.when(F.col("w").isNotNull(), F.concat_ws(": ", "w.type", "w.path")).alias("rule"), F.coalesce("delay", F.lit(0.0)).alias("delay"))
