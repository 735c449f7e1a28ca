"""Best partners against the assignment of all pairs."""

from __future__ import annotations

import random

import pytest

from plumbline.functions import embed
from plumbline.operators import partners, techniques


@pytest.mark.parametrize("more", ["gold", "pred"])
def test_undisputed_partners_are_the_best_assignment(spark, more):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghij") for _ in range(12)) + f" {k}" for k in range(60)]
    changed = [n if k % 3 else n[:-1] + "z" for k, n in enumerate(names[:40])]
    a, b = [names + names[:5], changed + changed[:5]][:: 1 if more == "gold" else -1]
    frames = [spark.createDataFrame([(t,) for t in x], "text string").repartition(3) for x in (a, b)]
    sims = embed.similarities(embed.hashed_ngrams(sorted(a)), embed.hashed_ngrams(sorted(b)))
    sims[[[x == y for y in sorted(b)] for x in sorted(a)]] = 1.0
    want = sum(sims[i, j] for i, j in embed.assignment(sims))
    assert partners.undisputed(*frames, embed.hashed_ngrams, 16) == pytest.approx(want, abs=1e-9)


def test_disputes_are_told(spark):
    one = lambda *x: spark.createDataFrame([(t,) for t in x], "text string")
    assert partners.undisputed(one("alpha", "alphb"), one("alpha", "zzz", "yyy"), embed.hashed_ngrams) is None
    assert partners.undisputed(one("alpha", "alpha"), one("alpha", "alpha", "yyy"), embed.hashed_ngrams) == 2.0
    assert partners.undisputed(one(), one("alpha"), embed.hashed_ngrams) == 0.0


def test_many_rows(spark, monkeypatch):
    gold = spark.range(120).selectExpr("id AS k", "concat('name ', id * 7919) AS name")
    few, whole = gold.where("k % 3 > 0"), techniques.unified_column_and_semantic_row(gold, gold.where("k % 3 > 0")).first()
    monkeypatch.setattr(techniques, "PAIRS", 100)
    got = techniques.unified_column_and_semantic_row(gold, few).first()
    assert tuple(got) == tuple(whole) and got.exp == 1.0 and got.exr == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="dispute"):
        techniques.unified_column_and_semantic_row(spark.range(50).selectExpr("concat('same ', id) AS a"), spark.range(60).selectExpr("if(id = 0, 'same 1', repeat('z', int(id))) AS a"))
