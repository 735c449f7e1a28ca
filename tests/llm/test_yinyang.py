from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from plumbline.llm import registry, yinyang

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters, rounds, dim):
    """The definition, vector by vector: rows of (vec_id, vector)."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:clusters]
    now = [x for _, x in start]
    d2 = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(now)), key=lambda c: (d2(x, now[c]), c))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        for c in range(len(now)):
            own = [x for (_, x), o in zip(kept, of) if o == c]
            if own:
                now[c] = [sum(col) // len(own) for col in zip(*own)]
    of = [near(x) for _, x in kept]
    by = [sum(d2(x, now[c]) for (_, x), o in zip(kept, of) if o == c) for c in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted((str(i), c, d2(x, now[c]), by[c], sum(by), sha[c]) for (i, x), c in zip(kept, of))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("seed, clusters, per_group", [(1, 12, 3), (2, 7, 10), (3, 5, 1)])
def test_agrees_with_the_definition(spark, seed, clusters, per_group):
    """Few different values make many ties, repeats and empty clusters."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-4, 5, 6) / 64).astype(np.float32).tolist()) for i in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 400)] + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1])]
    rows += [(900, None), (901, [0.5]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [None] + [0.0] * 5), (905, [])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).repartition(3)
    assert got(yinyang.clustered(df, clusters=clusters, rounds=4, dim=6, per_group=per_group)) == plain(rows, clusters, 4, 6)


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(7)
    middle = rng.integers(-3000, 3000, (40, 16))
    x = (middle[rng.integers(0, 40, 4000)] + rng.integers(-300, 300, (4000, 16))).astype(np.int64)
    now, before = x[:40].copy(), None
    of, state, costs = yinyang.groups(now), None, []
    for _ in range(6):
        model = yinyang.Centroids(now, of, before)
        cluster, upper, lower, computed = model.nearest(x, *(state or (np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), model.n)))))
        exact = yinyang.squares(x, now)
        assert (cluster == exact.argmin(1)).all()
        true = np.sqrt(exact.astype(float))
        assert (upper >= true[np.arange(len(x)), cluster]).all()
        true[np.arange(len(x)), cluster] = np.inf
        assert all((lower[:, g] <= true[:, of == g].min(1)).all() for g in range(model.n))
        state, before = (cluster, upper, lower), now
        costs.append(computed)
        now = np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else now[c] for c in range(40)])
    assert costs[0] == x.shape[0] * 40 and costs[-1] < costs[0] / 4


def test_squares_of_large_integers():
    x = np.array([[yinyang.LARGEST] * 64, [-yinyang.LARGEST] * 64, [3] * 64], np.int64)
    assert yinyang.squares(x, x[:1]).tolist() == [[0], [64 * 4 * yinyang.LARGEST**2], [64 * (yinyang.LARGEST - 3) ** 2]]
    assert yinyang.integers(np.array([[1e300, -1e300, -0.001]])).tolist() == [[yinyang.LARGEST, -yinyang.LARGEST, -1]]


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert yinyang.clustered(none).collect() == []
    huge = spark.createDataFrame([(k, [1e30] * 64 if k else [-1e30] * 64, k, "x", 1) for k in range(4)], SCHEMA + ", cluster string, x int")
    rows = yinyang.clustered(huge, clusters=2).collect()
    assert len(rows) == 4 and all(r.inertia >= 0 for r in rows)
    unnamed = spark.createDataFrame([(None, [0.1] * 64, 1), (None, [0.2] * 64, 1)], SCHEMA)
    assert sorted(r.distance for r in yinyang.clustered(unnamed).collect()) == [0, 0]


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    want = duck.execute(registry.oracles()["op11_centroid_clustering"]).df()
    have = registry.queries()["op11_centroid_clustering"](spark, folder).toPandas()[list(want.columns)]
    assert have.sort_values("vec_id").reset_index(drop=True).equals(want.sort_values("vec_id").reset_index(drop=True).astype(have.dtypes))
