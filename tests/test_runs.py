from __future__ import annotations

import json
import logging

from pyspark.sql import functions as F

from plumbline import __main__ as main
from plumbline.operators import linking, naturalness
from plumbline.plans import star
from plumbline.plans.queryspec import RECORD, record
from plumbline.sources import readers, sinks

QUERIES = "question_id int, db_id string, question string, central_table string, literals array<string>, attributes array<string>"
COLUMNS = "db_id string, table_name string, column_name string"


def test_hiding(spark):
    rows = [(1, "a", "How many orders did Paris place?", "orders", ["Paris"], []), (2, "b", "List customer names", "customer", [], [])]
    found = naturalness.linked(spark.createDataFrame(rows, QUERIES))
    got = {r.question_id: r for r in naturalness.hidden_by(found, "synonym", synonyms={"orders": "purchases"}).collect()}
    assert (got[1].hidden_question, got[1].score) == ("How many purchases did Paris place?", 1.0) and got[2].hidden_question == "List item names"
    said = naturalness.hidden_by(found, "contextual", make=lambda: lambda ps: ["no table is named" if "Paris" in p else "still a customer" for p in ps]).collect()
    assert {(r.question_id, r.score) for r in said} == {(1, 1.0), (2, 0.0)}

    def raising(prompts):
        raise RuntimeError("no service")

    failed = naturalness.hidden_by(found, "back_translation", make=lambda: raising).collect()
    assert all(r.hidden_question == r.question and r.score == 0.0 for r in failed)
    shares = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.9, 0.1), ("c", 0.0, 1.0)], "db_id string, x double, y double")
    run = {r.db_id: r for r in naturalness.hiding_run(found, shares, ["x", "y"], [("test", 1)], "synonym", synonyms={}).collect()}
    assert run["a"].cluster == run["b"].cluster and sorted(r.split for r in run.values()) == ["test", "train"]


def test_rewritten_questions(spark):
    df = spark.createDataFrame([(1, "q1", "e1", "s"), (2, "q2", None, "s"), (3, "q3", "e3", "s")], "question_id int, question string, evidence string, schema string")
    answer = lambda p: '```json\n{"question": "new", "evidence": "also"}\n```' if "q1" in p else "no json" if "q2" in p else '{"question": "third"}'
    got = {r.question_id: (r.status, r.new_question, r.new_evidence) for r in naturalness.rewritten_questions(df, lambda: lambda ps: list(map(answer, ps))).collect()}
    assert got == {1: ("ok", "new", "also"), 2: ("malformed", "q2", None), 3: ("ok", "third", "e3")}


def test_schema_linking_methods(spark):
    columns = spark.createDataFrame([("d", "A", "x"), ("d", "A", "y"), ("d", "B", "z")], COLUMNS)
    questions = spark.createDataFrame([(1, "d", "needs x"), (2, "d", "needs z"), (3, "e", "other")], "question_id int, db_id string, question string")
    full = {r.question_id: r.predicted for r in linking.predicted_links(questions, columns, "full").collect()}
    assert full == {1: {"A": ["x", "y"], "B": ["z"]}, 2: {"A": ["x", "y"], "B": ["z"]}, 3: {}}
    yes = lambda: lambda ps: ["Yes." if f"needs {p.split()[1]}" in p else "no" for p in ps]
    assert {r.question_id: r.predicted for r in linking.predicted_links(questions, columns, "by_column", yes).collect()} == {1: {"A": ["x"]}, 2: {"B": ["z"]}}

    def two_steps():
        def ask(ps):
            return ['["b"]' if "Which tables" in p and "needs z" in p else "oops" if "Which tables" in p else json.dumps({"B": ["z"]}) if "Table B -> z" in p and "Table A" not in p else "?" for p in ps]

        return ask

    got = {r.question_id: (r.predicted, r.error) for r in linking.predicted_links(questions, columns, "tables_then_columns", two_steps).collect()}
    assert got == {1: ({}, "malformed"), 2: ({"B": ["z"]}, None)}
    done = spark.createDataFrame([(1, "OO", "full")], "question_id int, combo string, method string")
    swept = linking.sweep({"OO": (questions, columns), "LL": (questions, columns)}, ("full", "by_column"), yes, done)
    assert swept.groupBy("combo", "method").count().count() == 4 and swept.count() == 9


def test_overview_and_renamed_catalogue(spark):
    columns = spark.createDataFrame([("d", "A", "id"), ("d", "A", "n"), ("d", "B", "a_id"), ("d", "B", "m")], COLUMNS)
    pks = spark.createDataFrame([("d", "A", "id")], COLUMNS)
    fks = spark.createDataFrame([("d", "B", "a_id", "A", "id")], "db_id string, from_table string, from_column string, to_table string, to_column string")
    assert linking.overview(columns, pks, fks).first().text == "Table A: id (key), n\nTable B: a_id, m; a_id -> A.id"
    some = spark.createDataFrame([("d", "A", "n"), ("d", "B", "m")], COLUMNS)
    assert linking.overview(columns, pks, fks, some).first().text == "Table A: id (key), n\nTable B: a_id, m; a_id -> A.id"
    assert linking.overview(columns, pks, fks, some.where("table_name = 'A'")).first().text == "Table A: n"
    m = spark.createDataFrame([("d", "A", "id", "aa", "key"), ("d", "B", "m", "bb", "mm")], "db_id string, table_name string, column_name string, new_table_name string, new_column_name string")
    assert sorted(map(tuple, linking.renamed_catalog(columns, m).collect())) == [("d", "aa", "key"), ("d", "aa", "n"), ("d", "bb", "a_id"), ("d", "bb", "mm")]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([record(1, "d", "SELECT a FROM t"), record(2, "d", "SELECT a FROM t UNION SELECT 1")], RECORD)
    sinks.parsed_queries(rows, f"{tmp_path}/parsed")
    assert spark.read.json(f"{tmp_path}/parsed/flat").count() == 1 and spark.read.json(f"{tmp_path}/parsed/nested").first().question_id == 2
    sinks.consolidated(rows.selectExpr("question_id", "'a' AS mode", "'dev' AS split", "'ok' AS status"), f"{tmp_path}/all")
    sinks.splits(rows.selectExpr("question_id", "'dev' AS split"), f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/all").where("mode = 'a' AND split = 'dev'").count() == 2 and spark.read.parquet(f"{tmp_path}/splits").count() == 2
    sinks.linker_statistics(rows.where("question_id = 1"), f"{tmp_path}/links")
    assert spark.read.text(f"{tmp_path}/links/sql").first()[0] == "SELECT a FROM t\td"
    (tmp_path / "mutant_scores_exact.json").write_text(json.dumps([{"EX": 1, "error_pattern": "x"}, {"EX": 0, "error_pattern": "x"}]))
    (tmp_path / "mutant_scores_other.json").write_text(json.dumps([{"EX": 0, "error_pattern": None}]))
    s = readers.score_files(spark, f"{tmp_path}/mutant_scores_*.json", "EX int, error_pattern string")
    assert {(r.technique, r["count"]) for r in s.groupBy("technique").count().collect()} == {("exact", 2), ("other", 1)} and readers.error_patterns(s).count() == 1
    (tmp_path / "ask.txt").write_text("Say {word}\ntwice")
    p = readers.Prompts(spark, str(tmp_path))
    assert p.render("ask", word="it") == "Say it\ntwice" and p.text("ask") is p.text("ask")
    assert [m["role"] for m in readers.messages("s", [("q", "a")], "q2")] == ["system", "user", "assistant", "user"]
    line = json.loads(sinks.JsonLog().format(logging.LogRecord("n", logging.INFO, "f", 1, "said %s", ("é",), None)))
    assert (line["level"], line["message"]) == ("INFO", "said é")


def test_expansion_from_the_command_line(spark, tmp_path):
    for t in star.TABLES[:4]:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    (tmp_path / "corpus.json").write_text(json.dumps([{"question_id": k, "db_id": db, "SQL": q} for k, db, q in star.CORPUS[:4]]))
    (tmp_path / "keys.json").write_text(json.dumps([dict(zip(("from_table", "from_column", "to_table", "to_column"), fk)) for fk in star.FOREIGN_KEYS[:3]]))
    n = main.run(spark, main.arguments([str(tmp_path), "star", "2", "--out", f"{tmp_path}/out", "--iso", "2"]))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert n == got.count() > 2 and {r.mode for r in got.collect()} == {"query_first"} and got.where(F.col("is_redundant")).isEmpty()
