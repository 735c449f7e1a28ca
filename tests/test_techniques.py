from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import cells, embed
from plumbline.operators import matching
from plumbline.operators import techniques as t

PARTIAL = ("exact_column_and_exact_cell", "exact_column_and_partial_cell", "no_column_and_partial_cell")


def score(df):
    r = df.first()
    return (r.ex, round(r.exp, 6), round(r.exr, 6), round(r.f1, 6))


def frame(spark, rows, names="a long, b string"):
    return spark.createDataFrame(rows, names)


def test_families_of_cells(spark):
    r = spark.sql("SELECT 1 AS i, 1.0D AS d, '1' AS s, true AS b, null AS z, 0.5D AS h, cast(1.50 AS decimal(5,2)) AS c, array(1) AS j, date'2024-01-02' AS t")
    got = r.select(cells.cells(r)).first()[0]
    assert got == ["n:1", "n:1", "s:1", "n:1", "z", "n:0.5", "n:1.5", "j:[1]", "d:2024-01-02T00:00:00.000000"]


def test_python_forms(spark):
    r = spark.sql("SELECT 1.0D AS a, 1e-5D AS b, 1e7D AS c, 1e16D AS d, true AS e, cast(null AS int) AS f, 'x' AS g, 3 AS h")
    got = r.select(F.array(*[cells.py_str(F.col(f.name), f.dataType) for f in r.schema.fields])).first()[0]
    assert got == [str(x) for x in (1.0, 1e-5, 1e7, 1e16, True, None, "x", 3)]


@pytest.mark.parametrize("name", PARTIAL)
def test_rules(spark, name):
    rng = random.Random(name)
    f = getattr(t, name)
    for _ in range(4):
        rows = [(rng.randrange(4), rng.choice(["x", "y", None])) for _ in range(8)]
        other = [(rng.randrange(4), rng.choice(["x", "y", None])) for _ in range(6)]
        g, p = frame(spark, rows), frame(spark, other)
        a, b = score(f(g, p)), score(f(p, g))
        assert all(0 <= x <= 1 for x in a) and a[1:3] == (b[2], b[1])
        assert score(f(frame(spark, rows[::-1]), p)) == a
        assert score(f(g, frame(spark, rows + rows[:3]))) == (1, 1.0, 1.0, 1.0)
    exact, part = (score(getattr(t, n)(g, p)) for n in PARTIAL[:2])
    assert part[1] >= exact[1] and part[2] >= exact[2]


@pytest.mark.parametrize("name", PARTIAL)
def test_empty_sides(spark, name):
    f, full = getattr(t, name), frame(spark, [(1, "x")])
    none = full.where("a < 0")
    assert score(f(none, none)) == (1, 1, 1, 1) and score(f(none, full)) == (0, 0, 1, 0) and score(f(full, none)) == (0, 1, 0, 0)


def greedy_by_hand(g, p, weight, gain):
    g, p, total = sorted(g), sorted(p), 0
    while True:
        best = max(((weight(a, b), -i, -j) for i, a in enumerate(g) for j, b in enumerate(p)), default=(0,))
        if best[0] <= 0:
            return total
        total += gain(g[-best[1]], p[-best[2]])
        g.pop(-best[1])
        p.pop(-best[2])


def test_greedy_equals_the_sequential_loop(spark):
    rng = random.Random(5)
    schema = "key array<string>, g long, p long"
    for _ in range(5):
        g, p = ([[rng.choice("abc") for _ in range(3)] for _ in range(rng.randrange(1, 7))] for _ in "gp")
        rest = {}
        for side, rows in ((0, g), (1, p)):
            for r in rows:
                rest.setdefault(tuple(r), [0, 0])[side] += 1
        rest = spark.createDataFrame([(list(k), *map(int, v)) for k, v in rest.items()], schema)
        equal = lambda a, b: sum(x == y for x, y in zip(a, b))
        edges = matching.cell_edges(rest)
        total = lambda d: d.agg(F.coalesce(F.sum(F.col("gain") * F.col("n")), F.lit(0))).first()[0]
        want = greedy_by_hand(g, p, equal, equal)
        assert total(matching.greedy(edges)) == want
        spark.sparkContext.setCheckpointDir("/tmp/plumbline-tests")
        assert total(matching.greedy_rounds(edges)) == want


def test_assignment_is_best():
    rng = np.random.default_rng(2)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (5, 3), (1, 1)):
        s = rng.random((n, m))
        got = sum(s[i, j] for i, j in embed.assignment(s))
        wide = s if n <= m else s.T
        assert np.isclose(got, max(sum(wide[i, c] for i, c in enumerate(o)) for o in permutations(range(wide.shape[1]), wide.shape[0])))
    assert embed.assignment(np.zeros((0, 3))) == []


def test_semantic_columns_and_rows(spark):
    g = spark.sql("SELECT id AS customer_id, concat('name', id) AS customer_name FROM range(5)")
    p = spark.sql("SELECT concat('name', id) AS customer_names, id AS customer_id FROM range(4)")
    assert sorted(t.semantic_pairs(g, p)) == [(0, 1), (1, 0)]
    assert score(t.semantic_column_and_exact_cell(g, p))[2] == 0.8
    assert score(t.semantic_column_and_partial_cell(g, p))[1] == 1.0
    u = score(t.unified_column_and_semantic_row(g, g.where("customer_id < 3")))
    assert u[0] == 0 and u[1] == 1.0 and u[2] == 0.6
    assert score(t.unified_column_and_semantic_row(spark.range(1100), spark.range(1100)))[1:3] == (1.0, 1.0)


def test_errors_are_scores(spark):
    r = t.evaluate(spark, "SELECT 1 AS a", "SELECT nothing FROM nowhere", "execution_accuracy").first()
    assert (r.ex, r.f1) == (0, 0.0) and "nowhere" in r.error
    with pytest.raises(ValueError):
        t.evaluate(spark, "SELECT 1", "SELECT 1", "no such technique")


def test_repeated_names(spark):
    df = cells.unique_names(spark.sql("SELECT 1 AS a, 2 AS a, 3 AS b"))
    assert df.columns == ["a", "a_1", "b"]
