"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window (13 consecutive words of an item, or the whole of a shorter item) is a
set of 5-word shingles. Shingles are counted and ordered by rarity in the documents;
a window can only occur where its rarest shingle, its necessary prefix, does, so only
that one is joined. The shingle's place in the window and the document's length bound
where the window may start, and there the window is verified word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, text_key

WINDOW, SHINGLE = 13, 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark's shingles are broadcast up to this many rows, and shuffled beyond.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD), "")


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, text, words): each item's distinct windows; items without an id or words have none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    return each.select("item", F.array_join("words", " ").alias("text"), "words").dropDuplicates(["item", "text"])


def hashed(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def doc_shingles(rows: DataFrame, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, key, n_words, pos, s, h) and ``carry``: words and hash of the shingle at every place of every document."""
    parts = [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}") for k in range(size)]
    long_enough = rows.where(F.size("w") >= size)
    places = long_enough.select("doc_id", "key", "n_words", *carry, F.posexplode(F.arrays_zip(*parts)).alias("pos", "s"))
    return places.where(F.col(f"s.w{size - 1}").isNotNull()).select("doc_id", "key", "n_words", *carry, "pos", "s", hashed([F.col(f"s.w{k}") for k in range(size)]).alias("h"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words and isn't contaminated, nor is any text if the benchmark
    is empty; an empty table gives an empty result. Very long texts are taken whole. Rows of
    one id and one text get the same result, each its own row; a null id is a document like
    others. Further columns, whatever their names, aren't looked at.
    """
    return judged(docs, benchmark, window, shingle, id_col, text_col, item_col).drop("key")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``contamination`` with ``key``, which tells apart rows that share an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), words(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    wins = windows(benchmark, window, item_col, "text" if "text" in benchmark.columns else text_col).withColumn("len", F.size("words"))
    texts = checkpoint(wins.groupBy("text").agg(F.first("words").alias("words"), F.first("len").alias("len")))
    sizes = [r[0] for r in texts.select(F.least("len", F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]  # ``shingle`` values at most

    found = None
    for size in sizes:
        of_size = texts.where(F.least("len", F.lit(shingle)) == size)
        offsets = F.sequence(F.lit(0), F.col("len") - size)
        parts = of_size.select("text", "len", F.posexplode(F.transform(offsets, lambda o: F.slice("words", o + 1, size))).alias("offset", "sw"))
        parts = checkpoint(parts.select("text", "len", "offset", F.array_join("sw", " ").alias("shingle"), hashed([F.col("sw")[k] for k in range(size)]).alias("h")))
        distinct = parts.select("h", "shingle").distinct()
        small = parts.count() <= BROADCAST_ROWS  # bounds every table made of ``parts``
        sent = F.broadcast if small else lambda df: df
        # How often each shingle of the benchmark stands in the documents, compared word for word.
        same = F.concat_ws(" ", *(F.col(f"s.w{k}") for k in range(size))) == F.col("shingle")
        rarity = checkpoint(doc_shingles(rows, size).join(sent(distinct), "h").where(same).groupBy("shingle").agg(F.count("*").alias("n")))
        # The necessary prefix of a window: its rarest shingle; a window with a shingle that never occurs is out.
        rated = parts.join(rarity, "shingle", "left")
        prefix = rated.groupBy("text", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "h")).alias("p")).where("p.n > 0").select("text", "len", "p.shingle", "p.offset", "p.h")
        prefix = checkpoint(prefix)
        # The words themselves come along only where the join doesn't shuffle the places.
        start = F.col("pos") - F.col("offset")
        starts = doc_shingles(rows, size, ("w",) if small else ()).join(sent(prefix), "h").where(same & (start >= 0) & (start + F.col("len") <= F.col("n_words")))
        starts = starts.select("doc_id", "key", "text", "len", start.alias("start"), *(["w"] if small else []))
        if not small:
            held = rows.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "w")
            starts = starts.distinct().join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
        whole = starts.where(F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ") == F.col("text")).select("doc_id", "key", "text", "len", "start").distinct()
        found = whole if found is None else found.union(whole)

    base = rows.select("doc_id", "key", "n_words")
    nothing = F.sha2(F.lit(""), 256)
    if found is None:
        return base.select("doc_id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = checkpoint(found)
    end = F.col("start") + F.col("len")
    before = Window.partitionBy("doc_id", "key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "key", "start", "len").distinct().withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spans.groupBy("doc_id", "key").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).cast("long").alias("n_hit"))
    items = wins.select("item", F.col("text").alias("t"))
    small_items = items.count() <= BROADCAST_ROWS
    named = found.select("doc_id", "key", "text").distinct().join(F.broadcast(items) if small_items else items, F.col("text") == F.col("t")).groupBy(F.col("doc_id").alias("d2"), F.col("key").alias("k2")).agg(F.sort_array(F.collect_set("item")).alias("ids"))
    both = hit.join(named, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2"))).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_hit", "ids")
    out = base.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.sha2(F.array_join("ids", ","), 256), nothing).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that aren't contaminated, columns as they were.

    It's decided by id and text: a clean row stays where another text of its id goes. Rows with a null id stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = judged(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, (docs[id_col] == bad["_bad"]) & (text_key(text_col) == bad["_key"]), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i : i + 12], ' ') AS t, least(len(w), 13) AS n
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, place.n, item FROM place JOIN win ON place.t = win.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
