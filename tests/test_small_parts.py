"""Functions that no registered query uses, each on a few rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import graph, reports
from plumbline.plans.queryspec import literals_of
from plumbline.sources import readers, sinks


def test_words(spark):
    df = spark.createDataFrame([(["a"], 0, "x → y"), (["a", "b"], 2, "x → y"), ([], 1, "x → y")], "ops array<string>, at int, pattern string")
    got = df.select(text.operator_of(F.col("ops"), F.col("at"), F.col("pattern")).alias("o")).collect()
    assert [r.o for r in got] == ["a", "b", "x"]
    r = spark.sql("SELECT 'Don''t, Étage_1!' AS t, 'c' AS n, 'int' AS k, array('1', '2') AS v").select(
        text.normalised_token(F.col("t")).alias("t"), text.column_text(F.col("n"), F.col("k"), F.col("v")).alias("c"), text.lower_tokens(F.col("t")).alias("w")).first()
    assert (r.t, r.c, r.w) == ("dont étage_1", "Column name: c Data type: int Sample values: 1, 2", ["don", "t", "étage_1"])
    assert literals_of("a = 'it''s' AND b > 2.5 AND c = d") == ["'it''s'", "2.5"]


def test_reports(spark):
    s = spark.createDataFrame([(1, 0.5, 0.2, 0.3), (0, 0.5, 0.2, 0.3)], "EX int, EXP double, EXR double, F1 double")
    assert [tuple(r) for r in reports.patched(s).collect()] == [(1, 1.0, 1.0, 1.0), (0, 0.5, 0.2, 0.3)]
    g = spark.createDataFrame([("b", 1, 0, 1.0, 2, 3), ("b", 2, 1, 2.0, 4, 3), ("c", 1, 0, 1.5, 1, 4)], "benchmark string, n_components int, n_cycles int, avg_degree double, diameter int, n_nodes int")
    got = {r.benchmark: r for r in reports.benchmark_summary(g).collect()}
    assert (got["b"].n, got["b"].connected_share, got["b"].cyclic_share, got["b"].degree_mean, got["b"].degree_max, got["b"].diameter_mean) == (2, 0.5, 0.5, 1.5, 2.0, 3.0)
    by = {r.n_nodes: r for r in graph.graph_groups(g).collect()}
    assert (by[3].n_graphs, round(by[3].share, 6), by[3].avg_degree, by[3].cyclic_share, by[4].n_graphs) == (2, 0.666667, 1.5, 0.5, 1)
    d = reports.degree_changes(spark.createDataFrame([(1.0, 1.5), (1.0, 1.5), (2.0, 2.0)], "degree_before double, degree_after double")).collect()
    assert {(r.delta, r.n, round(r.percent, 4)) for r in d} == {(0.5, 2, 66.6667), (0.0, 1, 33.3333)}
    h = spark.createDataFrame([(1.0,), (0.0,), (None,)], "score double")
    assert tuple(reports.hiding_average(h).first()) == (0.5, 2) and tuple(reports.hiding_average(h.where("score is null")).first()) == (None, 0)


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([("d", "orders", [("orders#sep#cust", "customer#sep#id"), ("orders#sep#x", "gone#sep#y")]), ("d", "customer", [])],
                              "db_id string, table_name string, foreign_keys array<struct<column:string,referenced:string>>")
    assert [tuple(r[c] for c in ("from_table", "from_column", "to_table", "to_column")) for r in readers.named_catalog(t).collect()] == [("orders", "cust", "customer", "id")]
    a, b = spark.createDataFrame([(2, "x")], "question_id int, sql string"), spark.createDataFrame([(1, "y", 5)], "question_id int, sql string, extra int")
    assert [(r.system, r.question_id, r.extra) for r in readers.tagged({"b": b, "a": a}).collect()] == [("a", 2, None), ("b", 1, 5)]
    m = spark.sql("SELECT array(named_struct('final_SQL', CAST(NULL AS STRING)), named_struct('final_SQL', 'q')) AS messages")
    assert m.select(readers.final_sql().alias("q")).first().q == "q"
    g = spark.createDataFrame([("d", 2, "g1"), ("d", 3, "g2")], "db_id string, num_tables int, graph string")
    sinks.append(g, f"{tmp_path}/graphs", ["db_id", "num_tables"])
    assert [r.graph for r in readers.graphs_of_size(spark, f"{tmp_path}/graphs", 3).collect()] == ["g2"]


def test_writers(spark, tmp_path):
    q = spark.createDataFrame([(3, "d", "c"), (1, "d", "a"), (2, "d", "b")], "question_id int, db_id string, sql string")
    sinks.csv_sorted(q, f"{tmp_path}/sorted", "question_id")
    assert [r.question_id for r in spark.read.csv(f"{tmp_path}/sorted", header=True).collect()] == ["1", "2", "3"]
    sinks.export_sampled(spark.createDataFrame([(3,), (1,)], "question_id int"), [q.where("question_id < 3"), q.where("question_id = 3")], f"{tmp_path}/sample")
    assert [r.value for r in spark.read.text(f"{tmp_path}/sample/sql").collect()] == ["a\td", "c\td"] and sinks.safe_name("a b/c") == "a_b_c"
