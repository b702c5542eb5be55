"""The ingest loop as Structured Streaming: tables that grow by batch, events exactly once, windows with a watermark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.operators.lifecycle import EVENT, OBSERVATION, lifecycle_events, numbered, runs_of
from tidemark.operators.market import REMOVED_AFTER


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) of an event stream or table; rows later than the watermark are dropped by a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): a user's events no further apart than the gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reject_reason() -> Column:
    """Why an observation can't be taken: the first reason that holds, or null."""
    c = F.col
    return F.when(c("listing_id").isNull(), "no listing id").when(c("observed_at").isNull(), "no time").when(c("price") <= 0, "price is not positive").when(~F.coalesce(c("seller_type"), F.lit("unknown")).isin("private", "professional", "unknown"), "unknown seller type")


class Market:
    """Observations and events of a streamed market, as tables in a folder that only grow.

    Every batch adds its own directories: observations that are new, the runs it saw, rejects,
    and changes of the event table (op 1 adds a row, -1 takes one back). All are dealt into buckets by
    the property's hash, so that a batch reads the buckets of the properties it touches and writes what
    it changes. A batch counts from its entry in ``commits`` on, its last act; repeated after a failure, it
    overwrites its directories and gives the same. Late observations, and late runs, change what was
    said before: the events of the properties concerned are made anew and the difference is written.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def path(self, table: str, batch: int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if batch is None else f"/batch={batch}")

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, schema: StructType, below: int, buckets: list[int] | None = None) -> DataFrame:
        """What batches under ``below`` wrote, of these buckets; files of others aren't opened."""
        whole = StructType([*schema.fields, *(StructField(n, LongType()) for n in ("bucket", "batch") if n not in schema.names)])
        if not self.exists(table):
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(self.path(table)).where(F.col("batch") < below)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def write(self, df: DataFrame, table: str, batch: int, dealt: bool = True) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy("bucket") if dealt else writer).parquet(self.path(table, batch))
        return self.spark.read.schema(df.schema).option("basePath", self.path(table, batch)).parquet(self.path(table, batch))

    def bucket(self, column: str = "property_id") -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("long").alias("bucket")

    def buckets_of(self, df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select("bucket").distinct().collect())  # ``buckets`` numbers at most

    def committed(self) -> int:
        """The number of the first batch that isn't committed."""
        if not self.exists("commits"):
            return 0
        return (self.spark.read.parquet(self.path("commits")).agg(F.max("number")).first()[0] or 0) + 1

    def commit(self, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("long").alias("number")).write.mode("overwrite").parquet(self.path("commits", batch))

    def events(self) -> DataFrame:
        """The events as they stand after the last committed batch, columns of ``EVENT``."""
        schema = self.spark.read.parquet(self.path("events")).schema
        return standing(self.read("events", StructType([f for f in schema if f.name not in ("bucket", "batch")]), self.committed()))

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(self.path("rejects")).where(F.col("batch") < self.committed())

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: listing_id, observed_at, price, seller_type, and source and property_id where there are any."""
        own = {"source": F.lit("-"), "property_id": F.col("listing_id")}
        rows = batch.withColumns({c: v for c, v in own.items() if c not in batch.columns}).select(*OBSERVATION).withColumn("reason", reject_reason())
        rows = rows.withColumn("source", F.coalesce("source", F.lit("-")))
        self.write(rows.where("reason is not null"), "rejects", number, dealt=False)
        good = rows.where("reason is null").drop("reason").withColumn("seller_type", F.coalesce("seller_type", F.lit("unknown")))
        good = good.withColumn("property_id", F.coalesce("property_id", F.col("listing_id").cast(good.schema["property_id"].dataType))).distinct().withColumn("bucket", self.bucket())
        schema = StructType([f for f in good.schema if f.name != "bucket"])

        same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in OBSERVATION))
        known = self.read("observations", schema, number, self.buckets_of(good))
        fresh = self.write(good.join(known, same(good, known), "left_anti"), "observations", number)
        run_schema = StructType([f for f in schema if f.name in ("source", "observed_at")])
        before = self.read("runs", run_schema, number)
        seen = self.write(runs_of(fresh), "runs", number, dealt=False)
        runs = before.select("source", "observed_at").union(seen).distinct()

        # A run that is new can only change what happens to listings that one of the runs just before it saw.
        new = seen.join(before, ["source", "observed_at"], "left_anti").select("source", F.col("observed_at").alias("run_at"))
        order = numbered(runs)
        at = new.join(order, ["source", "run_at"]).select("source", F.explode(F.array(*(F.col("i") - k for k in range(1, REMOVED_AFTER + 1)))).alias("i")).distinct()
        near = order.join(at, ["source", "i"]).select("source", F.col("run_at").alias("observed_at"))
        oldest = before.join(near, ["source", "observed_at"]).agg(F.min("batch")).first()[0]
        touched = fresh.select("property_id", "bucket")
        if oldest is not None:
            earlier = self.read("observations", schema, number).where(F.col("batch") >= oldest)
            touched = touched.union(earlier.join(near, ["source", "observed_at"], "left_semi").select("property_id", "bucket"))
        touched = self.write(touched.distinct(), "touched", number, dealt=False)

        buckets = self.buckets_of(touched)
        of_touched = lambda df: df.join(touched.select("property_id"), "property_id", "left_semi")
        every = of_touched(self.read("observations", schema, number + 1, buckets))
        now = lifecycle_events(every, runs).withColumn("bucket", self.bucket())
        kept = StructType([*(f for f in now.schema if f.name != "bucket"), StructField("op", IntegerType())])
        written = of_touched(self.read("events", kept, number, buckets)).select(*EVENT, "bucket", "op")
        changes = now.withColumn("op", F.lit(1)).union(written.withColumn("op", -F.col("op"))).groupBy(*EVENT, "bucket").agg(F.sum("op").cast("int").alias("op")).where("op <> 0")
        self.write(changes, "events", number)
        self.commit(number)


def standing(changes: DataFrame) -> DataFrame:
    """The rows that were added and not taken back."""
    return changes.groupBy(*EVENT).agg(F.sum("op").alias("op")).where("op > 0").drop("op")


def start_ingest(observations: DataFrame, folder: str, checkpoint: str, *, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Keep the events of streamed observations in ``folder`` (see ``Market``)."""
    writer = observations.writeStream.foreachBatch(lambda batch, number: Market(batch.sparkSession, folder, buckets).take(batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")).start()
