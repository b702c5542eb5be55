"""Helpers shared by the corpus operators: folds, samples, checkpoints, components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, one of our own on one machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder: cuts lineage as a checkpoint does, in columns and compressed."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int):
    """crc32 of the id's text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def text_key(text_col: str = "text"):
    """With the id, tells rows apart that share an id but not their text."""
    return F.xxhash64(F.col(text_col))


def distinct_rows(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, text, copies): rows that share an id and a text become one with their number.

    They are counted within tasks before the shuffle, which deals out by id and key, so that neither
    a row repeated very often nor an id with many texts makes a hot task.
    """
    rows = table.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, modulus: int, held: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled rows outside the held-out fold.

    The rows with the smallest hash of their id are taken, so the sample doesn't
    depend on partitioning. It's broadcast: ``limit`` bounds its size. Conflicting
    labels of one id count as the larger one; of several rows of one id the text with
    the smallest hash counts; null ids and labels are left out.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isNotNull() & (fold("_id", modulus) != held))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("_id")).groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "y")


#: Rows whose texts are held as Python strings at once.
ROWS = 1000


def texts_of(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows, ROWS at a time, with their texts; null counts as empty."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def give_back() -> None:
    """Return to the system what this worker's allocators hold unused, as Spark keeps the worker for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(task: Callable) -> Callable:
    """``task``, a function of batches, giving its memory back when it is through."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


#: Edges that a task of ``components`` is worth, and its tasks at least.
EDGES, LEAST_TASKS = 20_000, 8


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from the undirected edges (a, b): the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars around
    the smallest node of each component; nodes without an edge don't appear. Edges
    stay distributed, only their count and checksum reach the driver. The count gives the
    number of tasks that a step's shuffles are written by: few edges in many partitions
    would be little but small files, at each of its shuffles anew.
    """
    a, b = F.col("a"), F.col("b")
    e = checkpoint(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct())
    seen = None
    while True:
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if not sums[0] or tuple(sums) == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
        seen = tuple(sums)
        tasks = max(LEAST_TASKS, -(-sums[0] // EDGES))
        e = e.coalesce(tasks)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).coalesce(tasks).distinct().coalesce(tasks)
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        e = checkpoint(small.union(root.select(F.col("m").alias("lo"), "hi")).coalesce(tasks).distinct().coalesce(tasks))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def in_chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of about ``size`` bytes together; a longer text is a chunk by itself."""
    at = 0
    while at < len(texts):
        end, total = at + 1, len(texts[at])
        while end < len(texts) and total + len(texts[end]) < size:
            total += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


#: Odd multipliers of the independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.cache
def byte_values(which: int = 0) -> np.ndarray:
    return np.random.default_rng(29 + which).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    base = BASES[which]
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_sums(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums with which (sums[b] - sums[a]) * inverse[a] is a hash of data[a:b], wherever it stands."""
    size = 1 << 20
    while size < len(data) + 1:
        size *= 2
    up, down = powers(size, which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(which)[data] * up[: len(data)], out=sums[1:])
    return sums, down


def run_hashes(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the maximal runs of bytes of one class (class 0, which holds the space, left out),
    and the number of each text's first run, with the number of all at the end."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kinds = classes[data]
    starts = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
    ends = np.append(starts[1:], len(data))
    kept = kinds[starts] != 0
    starts, ends = starts[kept], ends[kept]
    sums, inverse = prefix_sums(data)
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, begins)
