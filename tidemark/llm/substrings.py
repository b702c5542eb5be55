"""Exact-substring dedup over a sampled suffix array with deep-shallow sorting.

Every 400-byte string is represented by its minimizer, the least hash of its
32-byte grams, so equal strings have the same minimizer at the same place. The
consecutive strings of a document that share a minimizer are a run; its row holds
the minimizer's hash and a BLAKE2 digest of the run's bytes. Runs equal to another
are repeated as a whole, runs whose minimizer stands nowhere else are not repeated
at all, and only the rest, where copies begin, end or differ, ship their bytes:
once for each different run. In a group of one minimizer, the suffixes that start
there are sorted deep-shallow (multikey quicksort to SHALLOW bytes, blind tries for
what is still equal), as are the reversed bytes before it. Merging neighbours by
falling common prefix, and within a merged set looking at the neighbours by common
text before, gives each run's repeated strings without comparing all pairs. A group
of more than GROUP different runs is first split the same way over Spark's keys: what
all its runs have in common, before and after, is judged at once, and runs that can
share more meet again under a longer prefix of the bytes after or before, until a
group fits one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, in_chunks, mixed, prefix_sums, text_key, texts_of

LENGTH, GRAM, SHALLOW = 400, 32, 64
#: Bits of a gram's place in a chunk; the higher bits of its hash decide.
PLACE_BITS = 22
GROUP = 4096
#: Keys and lengths of groups that are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
SEGMENT = 1 << 21


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` consecutive ones, by minima from both ends of blocks."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, minimizer hash, digest in two halves, first string's start, strings, minimizer's place) of the runs."""
    for at, chunk in in_chunks(texts):
        if len(chunk) == 1 and len(chunk[0]) > SEGMENT:
            # A very long text: segments that share no string.
            text = chunk[0]
            for k in range(0, len(text) - length + 1, SEGMENT - length + 1):
                for _, h, f1, f2, start, n, place in runs_of([text[k : k + SEGMENT]], length):
                    yield np.full(len(h), at), h, f1, f2, start + k, n, place + k
            continue
        data = np.frombuffer(b"".join(chunk), np.uint8)
        if len(data) < length:
            continue
        ends = np.cumsum([len(t) for t in chunk])
        sums, inverse = prefix_sums(data)
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (window_minima(keys, length - GRAM + 1) & low).astype(np.int64)
        start = np.arange(len(place))
        of = np.searchsorted(ends, start, side="right")
        whole = start + length <= ends[of]
        start, place, of = start[whole], place[whole], of[whole]
        if not len(start):
            continue
        heads = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (of[1:] != of[:-1])) + 1])
        n = np.diff(np.append(heads, len(start)))
        a, p, t = start[heads], place[heads], of[heads]
        b = a + n + length - 1
        shape = n.astype(np.uint64) << np.uint64(32) | (p - a).astype(np.uint64)
        whole_text = data.tobytes()
        digests = b"".join([hashlib.blake2b(whole_text[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist())])
        f1, f2 = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        f1 = f1 ^ mixed(shape)
        base = ends[t] - np.array([len(x) for x in chunk])[t]
        yield t + at, grams[p], f1, f2, a - base, n, p - base


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by the places where they branch; a string is read in full once, against one leaf."""

    def __init__(self) -> None:
        self.root: list | None = None  # [place, {byte: node}] or a leaf (list of numbers in a tuple)

    def insert(self, number: int, strings: list[bytes]) -> None:
        s = strings[number]
        if self.root is None:
            self.root = ([number],)
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[0][0]]
        shared = common(s, other)
        if shared == len(s) == len(other):
            node[0].append(number)
            return
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < shared:
            byte = s[node[0]]
            parent, node = (node, byte), node[1][byte]
        mine = s[shared] if shared < len(s) else -1
        if isinstance(node, list) and node[0] == shared:
            node[1][mine] = ([number],)
            return
        theirs = other[shared] if shared < len(other) else -1
        fork = [shared, {mine: ([number],), theirs: node}]
        if parent is None:
            self.root = fork
        else:
            parent[0][1][parent[1]] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node[0]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Numbers of the strings in sorted order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1:
            out += rows
        elif depth >= SHALLOW:
            trie = BlindTrie()
            for r in rows:
                trie.insert(r, strings)
            out += trie.ordered()
        else:
            keys = [strings[r][depth : depth + 8] for r in rows]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [r for r, k in zip(rows, keys) if k < pivot]
            same = [r for r, k in zip(rows, keys) if k == pivot]
            more = [r for r, k in zip(rows, keys) if k > pivot]
            if more:
                stack.append((more, depth))
            stack.append((same, depth + 8) if len(pivot) == 8 else (same, SHALLOW))
            if less:
                stack.append((less, depth))
    return out


def repeated(before: list[bytes], after: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each run of a group the (least, greatest) distance from its strings' start to the minimizer
    of strings that another run also has. ``before`` holds the bytes before the minimizer, reversed."""
    n = len(before)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = deep_shallow(after)
    rank = [0] * n
    for k, r in enumerate(deep_shallow(before)):
        rank[r] = k
    by_rank = sorted(range(n), key=rank.__getitem__)
    shared = sorted(((common(after[a], after[b]), k) for k, (a, b) in enumerate(zip(order, order[1:]))), reverse=True)
    sets = {k: [rank[r]] for k, r in enumerate(order)}  # of the first in sorted order
    head = list(range(n))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for prefix, k in shared:
        if prefix + max(map(len, before)) < length:
            break
        x, y = find(k), find(k + 1)
        small, large = sorted((sets.pop(x), sets.pop(y)), key=len)
        for r in small:
            at = bisect_left(large, r)
            for other in large[max(0, at - 1) : at + 1]:
                a, b = by_rank[r], by_rank[other]
                far = common(before[a], before[b])
                if far + prefix >= length:
                    out[a].append((length - prefix, far)), out[b].append((length - prefix, far))
        head[max(x, y)] = min(x, y)
        sets[min(x, y)] = sorted(large + small)
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RUN = "doc_id {0}, key long, h long, f1 long, f2 long, start int, n int, place int"


def run_rows(rows: DataFrame, length: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, strings in texts_of(batches):
            texts = [t.encode("utf-8", "replace") for t in strings]
            for t, h, f1, f2, start, n, place in runs_of(texts, length):
                at = pa.array(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.view(np.int64)) for x in (h, f1, f2)), *(pa.array(x.astype(np.int32)) for x in (start, n, place))], ["doc_id", "key", "h", "f1", "f2", "start", "n", "place"])

    return rows.mapInArrow(emit, RUN.format(rows.dtypes[0][1]))


def bytes_of_runs(joined: DataFrame, length: int) -> DataFrame:
    """(h, single, doc_id, key, place, before, after) of the runs that ship their bytes."""
    kind = dict(joined.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text, out = (batch.column(2)[i].as_py() or "").encode("utf-8", "replace"), []
                for r in batch.column(3)[i].as_py():
                    a, p, n = r["start"], r["place"], r["n"]
                    out.append((r["h"], r["single"], p, text[a:p][::-1], text[p : a + n - 1 + length]))
                h, single, place, before, after = zip(*out)
                at = pa.array([i] * len(out))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(single, pa.bool_()), doc.take(at), key.take(at), pa.array(place, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["h", "single", "doc_id", "key", "place", "before", "after"])

    return joined.mapInArrow(cut, f"h long, single boolean, doc_id {kind}, key long, place int, before binary, after binary")


def group_spans(shipped: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, a, b) of bytes that strings shared within a group cover; ``shipped`` is sorted by it."""
    kind = dict(shipped.dtypes)["doc_id"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for r, spans in zip(rows, repeated([r[5] for r in rows], [r[6] for r in rows], length)):
                if r[1] and spans:
                    out += [(r[2], r[3], r[4] - far, r[4] - near + length) for near, far in union([(x, y + 1) for x, y in spans]) for far in (far - 1,)]
            return out

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            doc, key, a, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(doc, shipped_id), pa.array(key, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "key", "a", "b"])

        for batch in batches:
            shipped_id, done = batch.schema.field("doc_id").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    done += work(held)
                    held = []
                held.append(row)
            if done:
                yield pack(done)
        if held and (done := work(held)):
            yield pack(done)

    return shipped.mapInArrow(solve, f"doc_id {kind}, key long, a int, b int")


def split_groups(crowd: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, groups that fit a task) of groups of more than GROUP runs, by prefixes of their bytes.

    All runs of a group share some bytes P after the minimizer and Q before it. Two of its runs that
    share a string share P + s after or Q + s before, where s is half of what P + Q lacks of the
    length; so each run goes on in at most two smaller groups.
    """
    spans, fitting = [], []

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a, b, c, d = (x.to_pylist() for x in batch.columns)
            after, before = [common(x, y) for x, y in zip(a, b)], [common(x, y) for x, y in zip(c, d)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(after, pa.int32()), pa.array(before, pa.int32())], ["of", "p", "q"])

    while not crowd.isEmpty():
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("after", "before") for f in (F.min, F.max)]
        shared = checkpoint(crowd.groupBy(F.col("h").alias("of")).agg(*ends).mapInArrow(reach, "of long, p int, q int"))
        shared = F.broadcast(shared) if shared.count() <= BROADCAST_GROUPS else shared
        held = checkpoint(crowd.join(shared, F.col("h") == F.col("of")))
        spans.append(held.where((F.col("p") + F.col("q") >= length) & F.col("single")).select("doc_id", "key", (F.col("place") - F.col("q")).alias("a"), (F.col("place") + F.col("p")).alias("b")))
        step = F.greatest(F.lit(1), F.ceil((length - F.col("p") - F.col("q")) / 2)).cast("int")
        longer = [held.where(F.octet_length(c) >= F.col(k) + step).withColumn("h", F.xxhash64("h", F.lit(c), F.substring(F.col(c), F.lit(1), F.col(k) + step))) for c, k in (("after", "p"), ("before", "q"))]
        parts = checkpoint(longer[0].union(longer[1]).drop("of", "p", "q"))
        sizes = checkpoint(parts.groupBy(F.col("h").alias("of")).agg(F.count("*").alias("g")).where("g > 1"))
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes
        sized = parts.join(sizes, F.col("h") == F.col("of")).drop("of")
        fitting.append(sized.where(F.col("g") <= GROUP).drop("g"))
        crowd = checkpoint(sized.where(F.col("g") > GROUP).drop("g"))
    return spans, fitting


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, key, a, b): bytes covered by a string of ``length`` bytes that also starts elsewhere."""
    runs = checkpoint(run_rows(rows, length))
    same = F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "start", "n", "place")).alias("one")
    kinds = checkpoint(runs.groupBy("h", "f1", "f2").agg(*same))
    sizes = kinds.groupBy("h").agg(F.count("*").alias("g")).where("g > 1")
    again = kinds.where("c > 1").select("h", "f1", "f2")
    copied = runs.join(again, ["h", "f1", "f2"], "left_semi").select("doc_id", "key", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b"))

    asked = checkpoint(kinds.join(sizes, "h").select("h", (F.col("c") == 1).alias("single"), "g", "one.*"))

    def with_bytes(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("h", "single", "start", "n", "place")).alias("runs"))
        held = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "runs")
        return bytes_of_runs(held, length)

    spans, fitting = split_groups(checkpoint(with_bytes(asked.where(F.col("g") > GROUP))), length)
    shipped = with_bytes(asked.where(F.col("g") <= GROUP))
    for more in fitting:
        shipped = shipped.union(more.select(shipped.columns))
    spans.append(group_spans(shipped.repartition("h").sortWithinPartitions("h"), length))
    for some in spans:
        copied = copied.union(some)
    return copied


def remove_repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain).

    Null text counts as empty; an empty table gives an empty result; very long texts are taken whole,
    in segments. Rows of one id and one text are repeats of each other; a null id is a document like
    others. Further columns, whatever their names, aren't looked at. What remains may not be valid
    UTF-8, so it's returned as bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(rows, length).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            out = []
            for text, found in zip(texts, batch.column(2).to_pylist()):
                data, parts, at = text.encode("utf-8", "replace"), [], 0
                gone = union([(s["a"], s["b"]) for s in found or []])
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, count, sha, kept = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(strip, f"doc_id {rows.dtypes[0][1]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
