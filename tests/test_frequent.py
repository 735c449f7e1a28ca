"""Commonest values by summaries against counts of everything."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from plumbline.operators import frequent


@pytest.mark.parametrize("capacity", [3, 20, 1000])
def test_commonest_are_exact(spark, capacity):
    rng = random.Random(capacity)
    zipf = [int(1 / max(1e-3, rng.random())) for _ in range(3000)]
    rows = [(z, k, k % 7 if k % 3 else None, "x" * (z % 5), None) for k, z in enumerate(zipf)]
    df = spark.createDataFrame(rows, "zipf int, `a key` int, few int, text string, none string").repartition(5)
    got = {}
    for r in frequent.commonest(df, 4, capacity).collect():
        got.setdefault(r.column_name, []).append((r["rank"], r.value, r.n))
    want = {}
    for k, c in enumerate(df.columns):
        counts = Counter(str(r[k]) for r in rows if r[k] is not None)
        if counts:
            want[c] = [(i + 1, v, n) for i, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert {c: sorted(x) for c, x in got.items()} == want


def test_bounds_of_summaries():
    rng = random.Random(1)
    s, true = frequent.Summary(10), Counter()
    for _ in range(50):
        part = Counter(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.randrange(1, 27)]) for _ in range(100))
        true += part
        s.add(list(part), list(part.values()))
    s.shrink()
    assert len(s.counts) <= 10 and all(s.counts.get(v, 0) <= n <= s.counts.get(v, 0) + s.error for v, n in true.items()) and s.error <= sum(true.values()) / 11


def test_empty(spark):
    assert frequent.commonest(spark.createDataFrame([], "a int, b string")).collect() == []
