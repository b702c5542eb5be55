"""Rate limits of any dealing out against one pass in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import limits

RULES = [limits.FixedWindow(3, 60_000), limits.TokenBucket(4, 90_000), limits.Lockout(3, 10, "no", "yes")]


def rows(seed):
    r, out = random.Random(seed), []
    for k in range(900):
        key = "hot" if r.random() < 0.5 else f"k{r.randrange(12)}"
        out.append((k, key, r.randrange(3_000) if key == "hot" else r.randrange(40_000), r.choice(["no", "no", "no", "yes", "view"])))
    return out + [(1000, None, 5, "no"), (1001, "k1", None, "no")]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: type(r).__name__)
@pytest.mark.parametrize("partitions", [1, 13])
def test_limits(spark, rule, partitions):
    data = rows(7)
    events = spark.createDataFrame(data, "id long, key string, sec long, kind string").withColumn("at", F.timestamp_seconds("sec"))
    want = []
    for key in {r[1] for r in data if r[1]}:
        own = sorted((r[2], r[0], r[3]) for r in data if r[1] == key and r[2] is not None)
        out, _ = rule.fold(np.array([1000 * s for s, _, _ in own]), [k for _, _, k in own], None)
        want += [(i, key, *v) for (_, i, _), v in zip(own, zip(*out))]
    got = [tuple(r) for r in limits.limited(events, rule, kind="kind", partitions=partitions).collect()]
    assert sorted(got) == sorted(want) and len(got) == 900
    assert limits.limited(events.where("false"), rule, kind="kind").count() == 0


def test_rules_by_hand():
    window, _ = limits.FixedWindow(2, 100).fold(np.array([0, 10, 99, 100, 150, 300]), [None] * 6, None)
    assert [list(map(int, w)) for w in window] == [[1, 2, 3, 1, 2, 1], [1, 1, 0, 1, 1, 1]]
    bucket, _ = limits.TokenBucket(2, 100).fold(np.array([0, 0, 0, 50, 51]), [None] * 5, None)
    assert list(map(int, bucket[0])) == [0, 0, 50, 0, 49]
    fails = ["no"] * 2 + ["no"] + ["no", "no", "yes"]
    lock, _ = limits.Lockout(2, 1, "no", "yes").fold(np.array([0, 1, 2, 60_001, 60_002, 60_003]), fails, None)
    assert list(lock[0]) == [1, 2, 2, 3, 4, 4] and list(lock[2]) == [False, False, True, False, False, True]
    assert lock[1][1] == 60_001 and lock[1][4] == 60_002 + 120_000
