"""Importance resampling towards a target distribution by hashed n-grams of a table of word places.

Words are exploded with their place; ``lead`` over a document's places gives the words
that follow, which joined by spaces are the n-gram of each order at that place. N-grams
are hashed into buckets, counted in documents and target, and each bucket's gain is joined
back to the places, so that a document's weight is the mean gain of its n-grams. Gumbel
noise of the id turns weights into a draw without replacement.

All of it is built of DataFrame functions. Rows that repeat an id and a text are counted
once with their number, before texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, distinct_rows
from tidemark.llm.decontaminate import words

ORDERS, BUCKETS, SEED = 2, 10_000, 7
PERCENT, LEAST_WORDS = 25, 20


def places(table: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, copies, n_words, grams): the buckets of the n-grams that begin at each word.

    ``grams`` holds null for an order that the document ends before; a row without words has one place of nulls.
    """
    rows = distinct_rows(table, id_col, text_col).select("doc_id", "key", "copies", words(F.col("text")).alias("w"))
    placed = rows.select("doc_id", "key", "copies", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    ahead = Window.partitionBy("doc_id", "key").orderBy("pos")
    following = placed.select("*", *(F.lead("word", k).over(ahead).alias(f"word{k}") for k in range(1, orders)))
    gram, grams = F.col("word"), []
    for k in range(1, orders + 1):
        grams.append((F.crc32(gram.cast("binary")) % buckets).cast("int"))
        gram = F.concat(gram, F.lit(" "), F.col(f"word{k}")) if k < orders else gram
    return following.select("doc_id", "key", "copies", "n_words", F.array(*grams).alias("grams"))


def bucket_counts(grams: DataFrame) -> DataFrame:
    """(bucket, n), repeated rows counted as often as they stand."""
    return grams.select("copies", F.explode_outer("grams").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of each of the ``buckets``, from the places of documents and target: log ratio of smoothed shares in thousandths."""
    s, t = bucket_counts(documents).withColumnRenamed("n", "s"), bucket_counts(target).withColumnRenamed("n", "t")
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"]).withColumns({c: F.col(c).cast("double") for c in "st"})
    every_bucket = Window.partitionBy()  # ``buckets`` rows at any size of the input
    ratio = ((F.col("t") + 1) * (F.sum("s").over(every_bucket) + buckets)) / ((F.col("s") + 1) * (F.sum("t").over(every_bucket) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the id alone; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id") -> DataFrame:
    """(doc_id, key, copies, n_words, n_features, weight, score), one row for all that share an id and a text."""
    grams = places(docs, orders, buckets, id_col, text_col)
    # The table of gains has ``buckets`` rows at any size of the input, so it can be sent to all tasks.
    gain = F.broadcast(gains(grams, places(target, orders, buckets, target_id), buckets))
    each = grams.select("doc_id", "key", "copies", "n_words", F.explode_outer("grams").alias("bucket")).join(gain, "bucket", "left")
    sums = each.groupBy("doc_id", "key").agg(F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return sums.select("doc_id", "key", "copies", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id"
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    Of the rows with at least ``least_words`` words the ``percent`` with the highest
    scores are drawn, ties to the smaller id, null ids last. A null or empty text has no
    words: weight 0, never drawn. Very long texts are taken whole. Rows that repeat an id
    and a text count each for itself, in counts and draw; equal in all, they take ranks next
    to each other. An empty target has equal shares of all buckets, an empty table gives no rows.
    Further columns, whatever their names, aren't looked at.
    """
    scored = checkpoint(weights(docs, target, orders, buckets, seed, id_col, text_col, target_id))
    each = scored.select((F.col("n_words") >= least_words).alias("fit"), "doc_id", "key", "n_features", "weight", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    # The order of all rows is dealt out by ranges; a row's rank is its place in its range after the rows of the ranges before.
    ordered = each.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "key", "nth").withColumn("_at", F.monotonically_increasing_id())
    ordered = checkpoint(ordered.select("*", F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("fit").cast("long")).alias("n_fit"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per range, of which there are as many as shuffle partitions.
    starts = sizes.select("part", before.alias("before"), F.floor(F.sum("n_fit").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("at") + 1
    return ordered.join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= F.col("drawn")), rank).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, columns as they were; rows that repeat a drawn id and text stay together."""
    id_col = options.get("id_col", "doc_id")
    kept = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(kept, docs[id_col] == kept["_drawn"], "left_semi")


WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: The bucket's checksum from the bytes' hexadecimal digits, by the table of the reversed polynomial.
CRC_SQL = "xor(4294967295, list_reduce(list_transform(range(0, len(x), 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[i + 1]) - 1) + strpos('0123456789ABCDEF', x[i + 2]) - 1), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT v, v AS c, 0 AS k FROM range(256) r(v) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
gd AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
gb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b),
grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM gd UNION SELECT g FROM gb)),
bucket AS (SELECT g, {CRC_SQL} % 10000 AS h FROM grams, crc),
s AS (SELECT h, count(*) AS s FROM gd JOIN bucket USING (g) GROUP BY 1),
t AS (SELECT h, count(*) AS t FROM gb JOIN bucket USING (g) GROUP BY 1),
both_ AS (SELECT h, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) r(h) LEFT JOIN s USING (h) LEFT JOIN t USING (h)),
gain AS (SELECT h, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM both_),
total AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM gd JOIN bucket USING (g) JOIN gain USING (h) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN floor(total / n)::BIGINT ELSE 0 END AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN total USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= (25 * n) // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
