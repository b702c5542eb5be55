"""Limits that depend on all that a key did before: fixed windows, token buckets, lockouts that double.

Each is a fold over a key's events in order of time, with a state of a few numbers. The events of all
keys are sorted together and dealt out by ranges, so a hot key spans as many partitions as it
needs. What a partition begins with may hang on the partitions before it: the states at their ends are
found first (a partition with a break that forgets the past, or with more than one key, knows its own;
the others follow one after another), and then all partitions fold at once, each from its state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.upkeep import settled

DAY = 86_400_000
State = list | None


@dataclass(frozen=True)
class FixedWindow:
    """``limit`` events in a window of ``width`` ms that opens with the first event after the last one ended."""

    limit: int
    width: int
    columns = "nth int, allowed boolean"

    @property
    def forgets(self) -> int:
        return self.width

    def fold(self, times: np.ndarray, kinds: list, state: State) -> tuple[list, State]:
        opened, n = state or (None, 0)
        nth = np.zeros(len(times), np.int64)
        at = 0
        while at < len(times):
            if opened is None or times[at] >= opened + self.width:
                opened, n = int(times[at]), 0
            end = int(np.searchsorted(times, opened + self.width))
            nth[at:end] = n + 1 + np.arange(end - at)
            n, at = n + end - at, end
        return [nth, nth <= self.limit], [opened, n]


@dataclass(frozen=True)
class TokenBucket:
    """An event takes a token; ``capacity`` of them are refilled evenly in ``period`` ms. Without a whole one it's put off."""

    capacity: int
    period: int
    columns = "delay_ms long, allowed boolean"

    @property
    def forgets(self) -> int:
        return self.period

    def fold(self, times: np.ndarray, kinds: list, state: State) -> tuple[list, State]:
        rate = self.capacity / self.period
        tokens, last = state or (float(self.capacity), int(times[0]) if len(times) else 0)
        delays = []
        for t in times.tolist():
            tokens, last = min(float(self.capacity), tokens + (t - last) * rate), t
            if tokens >= 1:
                tokens -= 1
                delays.append(0)
            else:
                delays.append(int(-((tokens - 1) / rate // 1)))
        delays = np.array(delays, np.int64)
        return [delays, delays == 0], [tokens, last]


@dataclass(frozen=True)
class Lockout:
    """Every ``attempts``-th failure in a row locks the key, ``minutes`` long and each time twice as long, up to a day.

    What comes while it's locked is refused and doesn't count. A success begins anew, and so does a day after a lock.
    """

    attempts: int
    minutes: int
    failure: str
    success: str
    columns = "failures int, locked_until_ms long, refused boolean"
    forgets = None

    def fold(self, times: np.ndarray, kinds: list, state: State) -> tuple[list, State]:
        failures, locked = state or (0, None)
        out: list[tuple] = []
        for t, kind in zip(times.tolist(), kinds):
            if locked is not None and t - locked >= DAY:
                failures, locked = 0, None
            refused = locked is not None and t < locked
            if not refused and kind == self.success:
                failures, locked = 0, None
            elif not refused and kind == self.failure:
                failures += 1
                if failures % self.attempts == 0:
                    locked = t + min(self.minutes * 2 ** min(failures // self.attempts - 1, 11), 24 * 60) * 60_000
            out.append((failures, locked, refused))
        return list(zip(*out)) if out else [[], [], []], [failures, locked]


def limited(events: DataFrame, rule: FixedWindow | TokenBucket | Lockout, key: str = "key", at: str = "at", kind: str | None = None, tie: str = "id", partitions: int | None = None) -> DataFrame:
    """The events' ``tie``, ``key`` and what the rule says of each, by order of ``at`` and then ``tie``.

    Events without a key or time are left out. The number of ``partitions`` is Spark's own where it isn't given.
    """
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(tie).alias("tie"), F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), (F.lit(None) if kind is None else F.col(kind)).cast("string").alias("kind"))
    order = ["key", "ms", "tie"]
    ordered = settled(rows.repartitionByRange(n, *order).sortWithinPartitions(*order), needed=True)
    states = carried(ordered, rule)
    id_type, kinds = ordered.schema["tie"].dataType, [c.rsplit(" ", 1) for c in rule.columns.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = states.get(TaskContext.get().partitionId(), (None, None))
        for batch, name, times, names in stretches(batches):
            if name != last:
                last, state = name, None
            out, state = rule.fold(times, names, state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, arrow[t]) for v, (_, t) in zip(out, kinds))], ["tie", "key", *(c for c, _ in kinds)])

    return ordered.mapInArrow(judge, f"tie {id_type.simpleString()}, key string, {rule.columns}").withColumnRenamed("tie", tie)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, str, np.ndarray, list]]:
    """Runs of rows of one key, as they come."""
    for batch in batches:
        keys = batch.column(1).dictionary_encode()
        codes = keys.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                yield part, keys.dictionary[int(codes[a])].as_py(), part.column(2).to_numpy(), part.column(3).to_pylist()


def carried(ordered: DataFrame, rule: FixedWindow | TokenBucket | Lockout) -> dict[int, tuple[str, State]]:
    """Of each partition that goes on with the key of the one before it: the key and its state there.

    What reaches the driver is one row per partition: its first and last key and its last state.
    """

    def ends(known: dict[int, State]) -> Callable:
        """Each partition's keys and last state; from partitions in ``known``, whose whole past is given, all of it."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            if known and part not in known:
                return
            first = last = before = None
            # Whether the state is right without what came before the partition.
            state, sure = known.get(part), part in known
            for _, name, times, names in stretches(batches):
                if name != last:
                    sure = sure and last is None or last is not None
                    state = state if last is None else None
                    first, last, before = first if first is not None else name, name, None
                if not sure and rule.forgets is not None:
                    gaps = np.diff(times, prepend=times[0] if before is None else before)
                    breaks = np.flatnonzero(gaps >= rule.forgets)
                    if len(breaks):
                        sure, state = True, None
                        times, names = times[breaks[0] :], names[breaks[0] :]
                if sure:
                    _, state = rule.fold(times, names, state)
                before = times[-1]
            if last is not None:
                yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "state": json.dumps(state) if sure else None}], schema=pa.schema({"part": pa.int32(), "first": pa.string(), "last": pa.string(), "state": pa.string()}))

        return walk

    found = {r["part"]: r for r in ordered.mapInArrow(ends({}), "part int, first string, last string, state string").collect()}
    parts = sorted(found)
    first_of = {p: found[p]["first"] for p in parts}
    last_of = {p: found[p]["last"] for p in parts}
    states: dict[int, State] = {p: json.loads(found[p]["state"]) for p in parts if found[p]["state"] is not None}
    before = dict(zip(parts[1:], parts))
    goes_on = [p for p in parts[1:] if first_of[p] == last_of[before[p]]]
    # A partition that opens its key knows all of it; what it couldn't say of itself is found with nothing before it.
    opens = {p: None for p in parts if p not in states and p not in goes_on}
    while opens:
        for r in ordered.mapInArrow(ends(opens), "part int, first string, last string, state string").collect():
            states[r["part"]] = json.loads(r["state"])
        opens = {p: states[before[p]] for p in goes_on if p not in states and before[p] in states}
    return {p: (first_of[p], states[before[p]]) for p in goes_on}
