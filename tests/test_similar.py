"""Near words and percentiles against their definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import reports, similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


@pytest.mark.parametrize("least", [70.0, 85.0, 100.0])
def test_all_near_pairs_are_found(spark, least):
    rng = random.Random(int(least))
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    words += [w[:k] + rng.choice("abcd") * rng.randrange(2) + w[k + rng.randrange(3):] for w in words[:100] for k in [rng.randrange(len(w))]] + ["x" * 300, "x" * 290 + "y", "ü", "", "ü"]
    a, b = words[::2], words[1::2] + ["a", None]
    got = similar.similar(spark.createDataFrame([(w,) for w in a], "w string"), spark.createDataFrame([(w,) for w in b], "w string"), "w", "w", least).collect()
    want = {(x, y): 200 * lcs(x, y) / (len(x) + len(y)) for x in set(a) for y in set(b) if x and y and 200 * lcs(x, y) / (len(x) + len(y)) >= least}
    assert {(r.left, r.right): r.ratio for r in got} == want and len(got) == len(want) and len(want) > 3


def test_bounds():
    assert similar.ratio("", "") == 100.0 and similar.common("abcde" * 30, "ace" * 30) == lcs("abcde" * 30, "ace" * 30)
    with pytest.raises(ValueError):
        similar.similar(None, None, "w", "w", 50.0)


def test_percentiles_of_any_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random() * 10 ** rng.randrange(-9, 9), 1.0, None])) for _ in range(900)] + [("one", 7.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in reports.five_numbers(df, "v", "g").collect()}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(q)) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]).collect()}
    assert got.keys() == want.keys() and got["none"] == (None,) * 5
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want if g != "none")
    assert reports.five_numbers(df.limit(0), "v", "g").collect() == []
