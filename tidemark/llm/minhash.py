"""MinHash near-duplicates with min-max hashing.

A document's set holds its distinct 5-word shingles. Each permutation gives both
its least and its greatest value, so PERMUTATIONS hash evaluations make twice as
many signature values; bands of four values link sets of a similarity of 0.75 but
for about five in a million. Rows with the same words in the same order are one
class, told by the SHA-256 of the words. The members of a band's bucket meet in
tasks of bounded size: there the signatures choose what is compared, whole sets
decide, a link is confirmed word for word, and members that are already in one
component are not compared again, so a task returns links that span its components
and never its pairs. Bands go by in rounds, and what a round has joined closes
buckets of the next ones. Buckets beyond one task are dealt out in blocks that
share some pivots; in the end, what the pivots have left outside a bucket's main
component is compared with the other blocks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, components, in_chunks, lean, mixed, run_hashes, text_key, texts_of

SHINGLE, PERMUTATIONS, BAND_VALUES, SEED = 5, 64, 4, 13
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: The low bits of a band's hash are its number.
LOW = np.uint64(BANDS - 1)
#: Similarity of a link: NUMERATOR of 100.
NUMERATOR = 75
#: A pair whose signatures agree in a smaller share isn't confirmed: five standard deviations under 0.75.
LEAST_AGREEMENT = 0.56
BLOCK = 8192
#: Members, and shingles, of a bucket that one task compares; larger buckets are dealt out in blocks.
BUCKET, BUCKET_SHINGLES = 2048, 1 << 20
#: Members, about, of a large bucket that are in all of its blocks.
PIVOTS = 16
#: Bands of each round: the first ones join most of what is alike.
ROUNDS = ((0, 2), (2, 8), (8, BANDS))
#: Rows of members that are broadcast to the candidates' texts; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


@functools.cache
def shingle_factors() -> np.ndarray:
    return np.random.default_rng(SEED + 1).integers(0, 1 << 63, SHINGLE, np.uint64) << np.uint64(1) | np.uint64(1)


@functools.cache
def byte_classes() -> np.ndarray:
    """0 for ASCII white space, 1 for all else."""
    out = np.ones(256, np.uint8)
    out[[32, *range(9, 14)]] = 0
    return out


def words_of(text: str) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII alone, as asked."""
    return text.encode("utf-8", "replace").lower().split()


def word_shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} - {()}
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def digest_of(words: list[bytes]) -> bytes:
    """128 bits of the SHA-256 of the words."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. bytes.lower() knows ASCII alone, as asked."""
    factors = shingle_factors()
    for _, chunk in in_chunks([t.encode("utf-8", "replace").lower() for t in texts]):
        hashes, first = run_hashes(chunk, byte_classes())
        places = max(0, len(hashes) - SHINGLE + 1)
        total = np.full(places, SHINGLE, np.uint64)
        for k in range(SHINGLE if places else 0):
            total += mixed(hashes[k : k + places] * factors[k])
        total = mixed(total)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= SHINGLE:
                yield np.unique(total[a : b - SHINGLE + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for k in range(b - a):
                    short += mixed(hashes[a + k : a + k + 1] * factors[k])
                yield mixed(short)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of each permutation, side by side."""
    a, b = permutations()
    least, greatest = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        v = shingles[at : at + BLOCK, None] * a + b
        least, greatest = np.minimum(least, v.min(0)), np.maximum(greatest, v.max(0))
    return np.column_stack([least, greatest]).ravel()


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, key, n, digest, bands, sig) of (doc_id, key, text): set size, the class, a hash for each band, a byte per signature value."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED + 2).integers(0, 1 << 63, (BANDS, BAND_VALUES), np.uint64) << np.uint64(1) | np.uint64(1)
        for batch, texts in texts_of(batches):
            n, digests, bands, sigs = [], [], [], []
            for text, s in zip(texts, shingle_sets(texts)):
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    digests.append(digest_of(words_of(text)))
                    hashes = mixed((mixed(sig.reshape(BANDS, BAND_VALUES)) * factors).sum(1, dtype=np.uint64))
                    bands.append(((hashes & ~LOW) | np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                    sigs.append((mixed(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    digests.append(None), bands.append(None), sigs.append(None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "digest", "bands", "sig"])

    return rows.mapInArrow(lean(sketch), f"doc_id {rows.dtypes[0][1]}, key long, n long, digest binary, bands array<long>, sig binary")


def compare(table: pa.Table) -> pa.Table:
    """Links (a, b) that span the components of one task's members.

    Columns: digest, component, n, sig, bands, text, band, asks, main and strict. If any member asks,
    only pairs of one that asks and one that doesn't are compared, else all pairs. ``strict`` leaves a
    pair that meets in an earlier band to that one. A table of one member or none gives no link; of
    members with equal digests only one is there, as classes are made before.
    """
    table = table.sort_by("digest")
    texts, digests, components_ = (table.column(c).to_pylist() for c in ("text", "digest", "component"))
    m, links = len(texts), []
    if m > 1:
        names = {c: k for k, c in enumerate(dict.fromkeys(components_))}
        root = np.array([names[c] for c in components_])
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(m, -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(m, -1)
        n, asks, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "asks", "main"))
        pos, strict = table.column("band")[0].as_py() & int(LOW), table.column("strict")[0].as_py()
        sets = list(shingle_sets(texts))
        common = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], np.uint8)
        later = np.ones(m, bool)
        # The centre first: it joins most.
        for i in np.argsort(-(sig == common).sum(1), kind="stable"):
            later[i] = False
            if asks.any() and not asks[i]:
                continue
            open_ = ~asks & (main | (np.arange(m) > i)) if asks[i] else later
            j = np.flatnonzero(open_ & (root != root[i]) & (100 * np.minimum(n, n[i]) >= NUMERATOR * np.maximum(n, n[i])))
            if strict and len(j):
                j = j[(bands[j] == bands[i]).argmax(1) == pos]
            share = (sig[j] == sig[i]).mean(1)
            j, share = j[share >= LEAST_AGREEMENT], share[share >= LEAST_AGREEMENT]
            j = j[np.argsort(-share, kind="stable")]
            mine = None
            at, step = 0, 1
            while at < len(j):
                some = j[at : at + step]
                at, step = at + step, min(256, step * 4)
                some = some[root[some] != root[i]]
                if not len(some):
                    continue
                values = np.concatenate([sets[k] for k in some])
                place = np.minimum(np.searchsorted(sets[i], values), len(sets[i]) - 1)
                both = np.add.reduceat(sets[i][place] == values, np.cumsum([0] + [len(sets[k]) for k in some[:-1]]), dtype=np.int64)
                for k in some[100 * both >= NUMERATOR * (n[i] + n[some] - both)]:
                    if root[k] == root[i]:
                        continue
                    mine = mine or word_shingles(words_of(texts[i]))
                    other = word_shingles(words_of(texts[k]))
                    if 100 * len(mine & other) >= NUMERATOR * len(mine | other):
                        root[root == root[k]] = root[i]
                        links.append((digests[i], digests[k]))
    a, b = zip(*links) if links else ((), ())
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, each with its component, of buckets that hold more than one component."""
    now = members.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    several = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    return now.join(several, "band", "left_semi")


def joined_links(units: DataFrame, candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Components of ``found`` with the links within the units: (band, x, y, digest, component, asks, main, strict)."""
    units = checkpoint(units)
    few = units.count() <= BROADCAST_ROWS
    filled = candidates.join(F.broadcast(units) if few else units, "digest")
    links = filled.groupBy("band", "x", "y").applyInArrow(compare, "a binary, b binary")
    before = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return components(before.union(links))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept), a row for each row of ``docs``; key is ``text_key``.

    Null and empty texts have no shingles and stay alone, as do rows with a null id. Very long texts are taken
    whole. Rows repeated whole are one component, each its own row. An empty table gives an empty result. Further
    columns, whatever their names, aren't looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    all_rows = checkpoint(sketches(rows))
    usable = all_rows.where("n > 0 and doc_id is not null")
    # Rows of a class agree in all but their id.
    classes = checkpoint(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("one"), *(F.first(c).alias(c) for c in ("n", "sig", "bands"))).select("digest", F.col("one.doc_id").alias("node"), F.col("one.key").alias("key"), "n", "sig", "bands"))
    in_bands = classes.select("digest", F.explode("bands").alias("band"))
    prints = (F.bit_xor(F.xxhash64("digest")).alias("print"), F.bit_xor(F.xxhash64("digest", F.lit(SEED))).alias("print2"))
    buckets = in_bands.groupBy("band").agg(F.count("*").alias("size"), *prints).where("size > 1")
    # Of buckets with the same members the first one does for all.
    pos = F.col("band").bitwiseAND(BANDS - 1)
    buckets = buckets.groupBy("size", "print", "print2").agg(F.min_by("band", pos).alias("band")).select("band", "size")
    members = checkpoint(in_bands.join(buckets, "band"))
    totals = members.join(classes.select("digest", "n"), "digest").groupBy("band").agg(F.sum("n").alias("total")).where(F.col("total") > BUCKET_SHINGLES)
    blocks = F.greatest(F.ceil(F.col("size") / BUCKET), F.ceil(F.coalesce("total", F.lit(1)) / BUCKET_SHINGLES)).cast("int")
    members = checkpoint(members.join(totals, "band", "left").select("band", "digest", "size", pos.alias("pos"), blocks.alias("blocks")))
    in_company = checkpoint(classes.join(members.select("digest").distinct(), "digest", "left_semi"))
    ids = in_company.select("node", "key")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = rows.withColumnRenamed("doc_id", "node").join(ids, ["node", "key"], "left_semi").groupBy("node", "key").agg(F.first("text").alias("text"))
    candidates = checkpoint(in_company.join(texts, ["node", "key"]).drop("node", "key"))

    found = members.select(F.col("digest").alias("node"), F.col("digest").alias("component")).where(F.lit(False))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    plain = [F.lit(False).alias("asks"), F.lit(False).alias("main")]
    for low, high in ROUNDS:
        crowd = still_open(members.where(F.col("pos").between(low, high - 1)), found)
        pivot = F.pmod(F.xxhash64("digest", F.lit(SEED)), F.ceil(F.col("size") / PIVOTS)) == 0
        dealt = crowd.withColumn("y", F.explode(F.when((F.col("blocks") > 1) & pivot, everywhere).otherwise(F.array(own))))
        found = joined_links(dealt.select("band", F.lit(0).alias("x"), "y", "digest", "component", *plain, (F.col("blocks") == 1).alias("strict")), candidates, found)

    # In buckets of several blocks, what isn't in the largest component asks the other blocks.
    crowd = checkpoint(still_open(members.where("blocks > 1"), found).withColumn("own", own))
    sizes = crowd.groupBy("band", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"))
    crowd = crowd.join(largest, "band").withColumn("main", F.col("component") == F.col("largest"))
    shares = F.ceil(F.col("blocks") * (F.col("all") - F.col("most")) / F.col("all")).cast("int")
    crowd = crowd.withColumn("shares", shares)
    asking = crowd.where("not main").withColumn("x", F.pmod(F.xxhash64("digest", F.lit(SEED + 1)), F.col("shares")).cast("int")).withColumn("y", F.explode(everywhere)).where("y <> own").withColumn("asks", F.lit(True))
    asked = crowd.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("y", F.col("own")).withColumn("asks", F.lit(False))
    columns = ["band", "x", "y", "digest", "component", "asks", "main"]
    found = joined_links(asking.select(columns).union(asked.select(columns)).withColumn("strict", F.lit(True)), candidates, found)

    of_class = classes.select("digest", "node").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = of_class.groupBy("component").agg(F.min("node").alias("component_id"))
    out = all_rows.select("doc_id", "key", "n", "digest").join(of_class.join(smallest, "component").select("digest", "component_id"), "digest", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links) and kept.

    Empty and null texts, and an empty table, link nothing; very long texts are taken whole.
    A row's component is that of its own text, also where rows repeat an id with another text;
    rows repeated whole get the same values. A null id links with nothing, has no component and
    is kept. Further columns of ``docs``, whatever their names, aren't looked at.
    """
    return groups(docs, id_col, text_col).drop("key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates (the smallest id), columns as they were.

    It's decided by row: of rows that share an id, those with another text stay or go by that
    text. Rows that repeat both id and text leave one, the least by a hash of its other columns.
    Rows with a null id stay.
    """
    judged = checkpoint(groups(docs, id_col, text_col).groupBy("doc_id", "key").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")))
    marks = judged.where("doc_id is not null and (not kept or rows > 1)").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("kept").alias("_kept"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    marked = row.join(marks, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    alone = marked.where("_id is null").select("row.*")
    hashable = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    again = marked.where("_kept").groupBy("id", "key").agg(F.min_by("row", F.xxhash64(*hashable)).alias("row")).select("row.*")
    return alone.union(again)
