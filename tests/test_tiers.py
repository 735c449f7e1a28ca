"""Greedy matching in tiers against the loop over all pairs."""

from __future__ import annotations

import random

import pytest

from plumbline.operators import matching, tiers


def loop(rest, by_tokens):
    """All pairs in order, each as often as both rows are left."""
    weight = (lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))) if by_tokens else (lambda a, b: sum(x == y for x, y in zip(a, b)))
    gain = (lambda a, b: len(set(a) & set(b))) if by_tokens else weight
    edges = sorted((-weight(a, b), a, b) for a, ga, _ in rest if ga for b, _, pb in rest if pb if gain(a, b))
    left = {("g", k): g for k, g, _ in rest} | {("p", k): p for k, _, p in rest}
    out = []
    for _, a, b in edges:
        if n := min(left["g", a], left["p", b]):
            left["g", a] -= n
            left["p", b] -= n
            out.append((a, b, gain(a, b), n))
    return sorted(out)


def case(seed, by_tokens, width=4, rows=45):
    rng, found = random.Random(seed), {}
    for _ in range(rows):
        key = tuple(rng.choice("abcdefghijkl"[: rng.choice((2, 3, 12))]) + str(k) * (not by_tokens) for k in range(width))
        key = tuple(sorted(set(key))) if by_tokens else key
        side = rng.randrange(2)
        n = found.get(key, [0, 0])
        if not n[1 - side]:  # equal rows are gone
            n[side] += rng.choice((1, 1, 2, 5))
            found[key] = n
    return [(k, g, p) for k, (g, p) in found.items()]


@pytest.mark.parametrize("seed, by_tokens", [(1, False), (3, True)])
def test_tiers_are_the_loop(spark, monkeypatch, seed, by_tokens):
    monkeypatch.setattr(matching, "EDGES_AT_ONCE", -1)
    monkeypatch.setattr(tiers, "pairs", lambda rest, by, by_tokens: rest.groupBy(*by).agg({"g": "count"}).toDF(*by, "pairs").selectExpr(*by, "pairs * 1e9 AS pairs"))
    rest = case(seed, by_tokens)
    df = spark.createDataFrame([(list(k), g, p) for k, g, p in rest], "key array<string>, g long, p long")
    got = sorted((tuple(r.gk), tuple(r.pk), r.gain, r.n) for r in tiers.matched(df, by_tokens=by_tokens).collect())
    assert got == loop(rest, by_tokens) and len(got) > 10


def test_few_values_make_no_pairs(spark):
    """Two columns, one of three values and one of keys that differ: a round matches 4,000 rows a side."""
    df = spark.range(8000).selectExpr("array(concat('k', id), concat('v', id % 3)) AS key", "if(id < 4000, 1L, 0L) AS g", "if(id < 4000, 0L, 1L) AS p")
    assert tiers.pairs(df, (), False).first().pairs > 5_000_000 > matching.EDGES_AT_ONCE
    rows = tiers.matched(df).collect()
    assert sum(r.gain * r.n for r in rows) == 1333 + 1333 + 1333 and all(r.gk[1] == r.pk[1] for r in rows)
    third = sorted((r for r in rows if r.gk[1] == "v0"), key=lambda r: r.gk)
    assert [r.pk for r in third] == sorted(r.pk for r in third)  # first with first


def test_cases_large_and_small(spark, monkeypatch):
    monkeypatch.setattr(matching, "EDGES_AT_ONCE", 400)
    small, large = case(5, False, 3, 12), case(6, False, 3, 120)
    df = spark.createDataFrame([(c, list(k), g, p) for c, rows in (("s", small), ("l", large)) for k, g, p in rows], "case_id string, key array<string>, g long, p long")
    got = sorted((r.case_id, tuple(r.gk), tuple(r.pk), r.gain, r.n) for r in tiers.matched(df, ("case_id",)).collect())
    assert got == sorted((c, *x) for c, rows in (("s", small), ("l", large)) for x in loop(rows, False))
    assert tiers.matched(df.limit(0), ("case_id",)).collect() == [] and tiers.in_tiers(df.limit(0).drop("case_id")).collect() == []
