"""``python -m plumbline FOLDER TABLES...``: expansions of the corpus in FOLDER/corpus.json over FOLDER's Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from plumbline.operators import expansion, graph
from plumbline.session import session
from plumbline.sources import readers, sinks


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("folder", help="holds <table>.parquet, corpus.json (question_id, db_id, SQL) and keys.json (from_table, from_column, to_table, to_column)")
    p.add_argument("db_id")
    p.add_argument("num_tables", type=int, help="of the queries to extend")
    p.add_argument("--out", required=True)
    p.add_argument("--max", type=int, default=1000, help="valid expansions of a query at most")
    p.add_argument("--iso", type=int, default=1, help="expansions of a query with isomorphic graphs that are kept")
    p.add_argument("--seconds", type=float, default=60.0)
    return p.parse_args(given)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Writes the expansions of a database's flat queries with so many tables; how many there are."""
    from plumbline.plans.queryspec import is_nested, parse

    keys = readers.json_array(spark, f"{a.folder}/keys.json", "from_table string, from_column string, to_table string, to_column string")
    for t in {r[c] for r in keys.collect() for c in ("from_table", "to_table")}:
        spark.read.parquet(f"{a.folder}/{t}.parquet").createOrReplaceTempView(t)
    corpus = [(r["question_id"], r["SQL"]) for r in readers.json_array(spark, f"{a.folder}/corpus.json").where(f"db_id = '{a.db_id}'").orderBy("question_id").collect()]
    chosen = [(k, q) for k, q in corpus if not is_nested(q) and len(parse(q).tables()) == a.num_tables]
    found = graph.cut(expansion.expand(spark, chosen, expansion.schema_of(graph.schema_edges(keys)), a.max, a.iso, a.seconds))
    sinks.consolidated(found.selectExpr("*", "'query_first' AS mode", f"'{a.db_id}' AS split"), a.out)
    return found.count()


if __name__ == "__main__":
    given = arguments()
    print(run(session(), given))
