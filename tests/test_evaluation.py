from __future__ import annotations

import random

import pytest

from plumbline.operators import evaluation, matching, mutation, techniques
from plumbline.plans import star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    star.register(spark, FOLDER)
    return spark


CASES = [
    ("same", "SELECT n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation"),
    ("fewer", "SELECT n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3"),
    ("shifted", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey + 1 AS n_nationkey, n_name, n_regionkey FROM nation"),
    ("wider", "SELECT n_name FROM nation", "SELECT n_name, n_regionkey FROM nation"),
    ("apart", "SELECT n_name FROM nation", "SELECT r_name FROM region"),
    ("renamed", "SELECT n_name FROM nation", "SELECT n_name AS x FROM nation"),
    ("none", "SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT n_name FROM nation WHERE n_nationkey < 0"),
    ("gold_none", "SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT n_name FROM nation"),
    ("pred_none", "SELECT n_name FROM nation", "SELECT n_name FROM nation WHERE n_nationkey < 0"),
    ("twice", "SELECT n_regionkey, n_regionkey FROM nation", "SELECT n_regionkey, n_regionkey FROM nation"),
]


@pytest.mark.parametrize("technique", evaluation.TOGETHER)
def test_one_plan_agrees_with_single_pairs(tables, technique):
    got = {r.case_id: r for r in evaluation.scores(tables, CASES, technique).collect()}
    for k, g, p in CASES:
        want = getattr(techniques, technique)(tables.sql(g), tables.sql(p)).select(*evaluation.SCORES).first()
        have = tuple(got[k][c] for c in evaluation.SCORES)
        assert got[k].status == "ok" and [x if x is None else round(x, 9) for x in have] == [x if x is None else round(x, 9) for x in want], (k, have, tuple(want))


def test_bad_queries_touch_no_other_case(tables):
    bad = [("raises", "SELECT n_name FROM nation", "SELECT CAST(concat('x', n_name) AS INT) AS n FROM nation"), ("unknown", "SELECT n_name FROM nation", "SELECT nope FROM nation"),
           ("slow", "SELECT 1 AS a", "SELECT count(*) AS a FROM range(3000000) a CROSS JOIN range(3000000) b WHERE a.id * b.id % 7 = 3"), ("empty", "SELECT 1 AS a", "")]
    got = {r.case_id: r for r in evaluation.scores(tables, [CASES[0], *bad, CASES[1]], "exact_column_and_exact_cell", seconds=6).collect()}
    assert [got[k].status for k in ("same", "raises", "unknown", "slow", "empty", "fewer")] == ["ok", "error", "error", "timeout", "error", "ok"]
    assert (got["same"].ex, got["same"].f1, got["fewer"].ex) == (1, 1.0, 0) and 0 < got["fewer"].f1 < 1
    assert all((r.ex, r.f1, r.latency) == (0, 0.0, -1.0) and r.error for k, r in got.items() if r.status != "ok")
    one = {r.case_id: r for r in techniques.evaluate_cases(tables, [bad[0], CASES[0]], "semantic_column_and_exact_cell").collect()}
    assert (one["raises"].status, one["same"].status, one["same"].ex) == ("error", "ok", 1)


def test_greedy_of_several_cases(spark, monkeypatch):
    rng = random.Random(5)
    rest = [(f"c{k % 3}", [rng.choice("ab"), rng.choice("xyz"), str(k % 4)], rng.randrange(3), rng.randrange(3)) for k in range(40)]
    df = spark.createDataFrame(rest, "case_id string, key array<string>, g long, p long").groupBy("case_id", "key").agg({"g": "sum", "p": "sum"}).toDF("case_id", "key", "g", "p")
    edges = matching.cell_edges(df, ("case_id",))
    want = sorted(map(str, matching.greedy(edges, ("case_id",)).collect()))
    single = [str(r) for c in ("c0", "c1", "c2") for r in matching.greedy(matching.cell_edges(df.where(f"case_id = '{c}'").drop("case_id"))).collect()]
    assert len(want) == len(single) > 5
    monkeypatch.setattr(matching, "EDGES_AT_ONCE", 4)
    assert sorted(map(str, matching.greedy(edges, ("case_id",)).collect())) == want


def test_sweeps(tables):
    mutants = mutation.mutants(tables, star.CORPUS[:4], 1)
    got = evaluation.mutant_scores(tables, mutants, ("execution_accuracy", "exact_column_and_exact_cell"))
    rows = got.collect()
    assert len(rows) == 2 * mutants.count() and {r.status for r in rows} <= {"ok", "error"} and {r.technique for r in rows} == {"execution_accuracy", "exact_column_and_exact_cell"}
    assert all((r.EX is None) == (r.status != "ok") for r in rows) and {r.EX for r in rows} >= {0}
    assert {r.operator for r in rows if r.question_id == 4} >= {"limit_increase", "limit_decrease", "join_break"}
    logs = tables.createDataFrame([(s, k, g, p) for s in ("a", "b") for k, (_, g, p) in enumerate(CASES[:2 if s == "a" else 3])], "system string, question_id int, gold_sql string, pred_sql string")
    got = {(r.system, r.question_id): r.EX for r in evaluation.system_scores(tables, logs).collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("b", 0): 1, ("b", 1): 0, ("b", 2): 0}
    with pytest.raises(ValueError, match="pred_sql"):
        evaluation.system_scores(tables, logs.drop("pred_sql"))
