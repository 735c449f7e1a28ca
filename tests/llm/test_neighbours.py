from __future__ import annotations

import numpy as np
import pytest

from plumbline.llm import neighbours, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, wanted=20):
    """Each query's exact nearest by plain sums: (query_id, rank, vec_id, score)."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in kept:
        if q % every == 0:
            near = sorted((-(c * x).sum(), i) for i, c in kept if i != q)[:wanted]
            out += [(q, k + 1, i, float(-s)) for k, (s, i) in enumerate(near)]
    return out


def test_every_part_asked_is_brute_force(spark):
    """With one part nothing is left out; blocks are small, so results of many tasks are merged; copies make ties."""
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.integers(-3, 4, 5) / 4).tolist()) for i in rng.permutation(230)]
    rows += [(300 + k, rows[0][1]) for k in range(60)]
    odd = [(1000, None), (1001, [0.0] * 5), (1020, [float("nan")] * 5), (1040, [None] + [0.5] * 4), (1060, [1.0]), (None, [0.5] * 5), (1080, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], SCHEMA).repartition(3)
    got = neighbours.nearest(df, parts=1, rows=64, queries=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_repeated_ids_and_names(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 5, "a"), (20, [0.0, 1.0], 5, "b"), (1, [1.0, 1.0], 5, "c"), (2, [2.0, 0.0], 5, "d"), (2, [2.0, 0.0], 5, "d")],
                               "vec_id long, embedding array<float>, part int, vector string")
    got = sorted(map(tuple, neighbours.nearest(df).collect()))
    assert got == sorted([(20, 1, 2, 2.0), (20, 2, 2, 2.0), (20, 3, 1, 1.0), (20, 1, 1, 1.0), (20, 2, 2, 0.0), (20, 3, 2, 0.0)])


@pytest.mark.parametrize("rows", [[], [(20, None, 0)], [(20, [0.0, 0.0], 0)], [(20, [1.0], 0)], [(1, [1.0], 0), (2, [1.0], 0)]])
def test_small_tables(spark, rows):
    assert neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_components():
    rows = np.array([[1e300, 1e300], [1.0, 1.0], [-1e300, 1e300]])
    (_, ids, score), = neighbours.best(np.array([[1e300, 1e300]]), np.array([9]), rows, np.array([3, 2, 1]), 2)
    assert ids.tolist()[0] == 3 and score[0] == np.inf


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(100, 8)) * 0.05 + c for c in np.eye(8)])
    near = neighbours.neighbours(x, x, 8, True)
    part = neighbours.partition(near, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= 105 and size.min() >= 60
    assert (part[near] == part[:, None]).mean() > 0.9


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    got = registry.queries()["op12_nearest_neighbours"](spark, folder)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    found = {(r.query_id, r.vec_id): r.score for r in got.collect()}
    exact = {(q, i): s for q, _, i, s in want}
    assert len(found) == len(exact)
    assert len(found.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(found[k] == exact[k] for k in found.keys() & exact.keys())
    exact_df = spark.createDataFrame(want, "query_id long, rank int, vec_id long, score double")
    assert neighbours.recall(got, exact_df) >= 0.9
