"""Near-duplicate vectors by collision-counting projections.

Vectors of one label are projected on many fixed random directions. TABLES groups
of GROUP directions, cut into cells with random offsets, bring a pair that is at
the least cosine together in at least one group but for about three in ten
thousand; in a cell the pair's collisions in query-centred windows over all
directions are counted, and those that pass the recall-calibrated count are
verified in double precision. A pair is judged in the first table it meets in, so
a cell reports how many links each vector has and stars that span what is linked,
never the pairs. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, components

LEAST_COSINE, TABLES, GROUP, SEED = 0.98, 20, 6, 17
#: Cell width and half window, in standard deviations of a projected pair at the least cosine.
CELL, REACH = 4.8, 2.0
#: Chance that a pair at the least cosine has too few collisions.
MISS = 1e-6
#: Members of a cell that one task compares at once; larger cells are dealt out in pairs of blocks.
BLOCK, PAIRS = 1024, 100_000


def directions(dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit directions, offsets in cells, and the deviation of a projected pair at the least cosine."""
    rng = np.random.default_rng([SEED, dims])
    a = rng.normal(size=(dims, TABLES * GROUP))
    deviation = math.sqrt(2 - 2 * LEAST_COSINE) / math.sqrt(dims)
    return a / np.linalg.norm(a, axis=0), rng.random(TABLES * GROUP), deviation


def least_count() -> int:
    """The most collisions that all but MISS of the pairs at the least cosine reach."""
    n, p = TABLES * GROUP, math.erf(REACH / math.sqrt(2))
    total, k = 0.0, 0
    while total <= MISS:
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        k += 1
    return max(0, k - 1)


def unit(rows: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector (doubles as bytes, null if it can't be compared)."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                a = np.array(v if v and None not in v else [np.nan], np.float64)
                out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    return rows.mapInArrow(pack, f"vec_id {rows.dtypes[0][1]}, label string, vector binary")


def cells(classes: DataFrame) -> DataFrame:
    """(node, t, cell): where each vector falls in each table."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, vector = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "label", "vector"))
            raw = vector.to_pylist()
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                a, offset, dev = directions(size // 8)
                q = np.floor(unit([raw[i] for i in at]) @ a / (CELL * dev) + offset).astype(np.int32).reshape(len(at), TABLES, GROUP)
                names = [q[i, t].tobytes() for i in range(len(at)) for t in range(TABLES)]
                yield pa.RecordBatch.from_arrays([node.take(pa.array(np.repeat(at, TABLES))), label.take(pa.array(np.repeat(at, TABLES))), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))), pa.array(names, pa.binary()), pa.array(np.full(len(at) * TABLES, size, np.int64))], ["node", "label", "t", "place", "size"])

    kind = dict(classes.dtypes)["node"]
    placed = classes.select("node", "label", "vector").mapInArrow(place, f"node {kind}, label string, t int, place binary, size long")
    return placed.select("node", "t", F.sha2(F.concat(F.col("place"), F.encode(F.concat_ws("|", "label", "t", "size"), "UTF-8")), 256).substr(1, 32).alias("cell"))


def pairs_of(sizes: np.ndarray, splits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of the same run of ``sizes`` rows, in chunks. With a split, i is before it and j is not."""
    starts = np.cumsum(sizes) - sizes
    left, right, held = [], [], 0
    for start, size, split in zip(starts.tolist(), sizes.tolist(), splits.tolist()):
        for i in range(split if split else size - 1):
            j = np.arange(start + (split or i + 1), start + size)
            left.append(np.full(len(j), start + i)), right.append(j)
            held += len(j)
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def judge(vectors: list[bytes], table: np.ndarray, sizes: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of rows whose first common cell is this one; runs of ``sizes`` rows share a cell."""
    u = unit(vectors)
    a, offset, dev = directions(u.shape[1])
    p = u @ a
    q = np.floor(p / (CELL * dev) + offset).astype(np.int32).reshape(len(u), TABLES, GROUP)
    least, out_i, out_j = least_count(), [], []
    for i, j in pairs_of(sizes, splits):
        count = (np.abs(p[i] - p[j]) <= REACH * dev).sum(1)
        pick = count >= least
        i, j = i[pick], j[pick]
        pick = np.einsum("ij,ij->i", u[i], u[j]) >= LEAST_COSINE
        i, j = i[pick], j[pick]
        pick = (q[i] == q[j]).all(2).argmax(1) == table[i]
        out_i.append(i[pick]), out_j.append(j[pick])
    return np.concatenate([*out_i, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*out_j, np.zeros(0, np.int64)]).astype(np.int64)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it with."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            return least


def linked(members: DataFrame) -> DataFrame:
    """From rows sorted by cell block: (node, other, links). ``links`` counts vectors linked to the
    node, ``other`` is a node of the same component."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.array(table.column("block").to_pylist())
            heads = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(heads)
            own = table.column("own").to_numpy()
            apart = table.column("x").to_numpy()[heads[:-1]] != table.column("y").to_numpy()[heads[:-1]]
            x = np.repeat(table.column("x").to_numpy()[heads[:-1]], sizes)
            splits = np.where(apart, np.add.reduceat((own == x).astype(np.int64), heads[:-1]), 0)
            sizes = np.where(apart & ((splits == 0) | (splits == sizes)), 0, sizes)  # one of the two blocks is empty
            widths = np.array([len(v) for v in table.column("vector").to_pylist()])
            node, copies = table.column("node"), table.column("copies").to_numpy()
            for width in np.unique(widths):
                runs = widths[heads[:-1]] == width
                rows = np.flatnonzero(np.repeat(runs & (sizes > 0), np.diff(heads)))
                if not len(rows):
                    continue
                part = table.take(pa.array(rows))
                i, j = judge(part.column("vector").to_pylist(), part.column("t").to_numpy(), sizes[runs & (sizes > 0)], splits[runs & (sizes > 0)])
                if not len(i):
                    continue
                links = np.bincount(i, copies[rows[j]], len(rows)) + np.bincount(j, copies[rows[i]], len(rows))
                seen = np.flatnonzero(links > 0)
                least = stars(len(rows), i, j)
                yield pa.RecordBatch.from_arrays([part.column("node").combine_chunks().take(pa.array(seen)), part.column("node").combine_chunks().take(pa.array(least[seen])), pa.array(links[seen].astype(np.int64))], ["node", "other", "links"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            last = table.column("block")[-1].as_py()
            keys = table.column("block").to_pylist()
            cut = keys.index(last)
            held = table.slice(cut)
            if cut:
                yield from work(table.slice(0, cut).combine_chunks())
        if held is not None:
            yield from work(held.combine_chunks())

    kind = dict(members.dtypes)["node"]
    return members.mapInArrow(compare, f"node {kind}, other {kind}, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components, null labels and
    null ids link with nothing; vectors of different lengths neither. A row with a null id has no
    component and is kept. Rows that share an id and are equal count as links of each other. An empty
    table gives an empty result. Further columns, whatever their names, aren't looked at.
    """
    rows = checkpoint(usable(vectors, id_col, vector_col, label_col))
    valid = rows.where("vec_id is not null and label is not null and vector is not null")
    classes = checkpoint(valid.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    placed = cells(classes)
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    rows_of = placed.join(crowded, "cell").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = rows_of.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "t", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "cell").withColumn("block", F.concat_ws("/", "cell", "x", "y"))
    members = dealt.join(classes.select("node", "copies", "label", "vector"), "node").where(F.col("cell").isNotNull())
    members = members.select("block", "own", "x", "y", "t", "node", "copies", "vector").repartition("block").sortWithinPartitions("block", "own", "node")
    found = checkpoint(linked(members))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("n2"), "component")
    by_class = classes.join(degree, "node", "left").join(component, F.col("node") == F.col("n2"), "left")
    by_class = by_class.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    whole = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "vector").join(by_class, ["label", "vector"], "left")
    component_id = F.coalesce("component", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))
