"""Identifiers made less natural: mappings applied to tables and to queries, and proof that results stay."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import techniques

_STRING = re.compile(r"'(?:[^']|'')*'")


def mapping_of(mapping: DataFrame, db_id: str) -> dict[str, tuple[str, dict[str, str]]]:
    """A database's mapping as a value: table to (new table, column to new column)."""
    out: dict = {}
    for r in mapping.where(F.col("db_id") == db_id).collect():  # a schema's size
        out.setdefault(r["table_name"], (r["new_table_name"], {}))[1][r["column_name"]] = r["new_column_name"]
    return out


def duplicate_names(mapping: DataFrame) -> DataFrame:
    """``(db_id, scope, new_name, n)``: new names that several tables of a database, or several columns of a table, got."""
    tables = mapping.groupBy("db_id", F.lit("table").alias("scope"), F.lower("new_table_name").alias("new_name")).agg(F.count_distinct("table_name").alias("n"))
    columns = mapping.groupBy("db_id", F.concat(F.lit("column of "), F.col("table_name")).alias("scope"), F.lower("new_column_name").alias("new_name")).agg(F.count_distinct("column_name").alias("n"))
    return tables.union(columns).where("n > 1")


def apply_renames(spark: SparkSession, mapping: dict) -> list[tuple[str, str]]:
    """Views of the new names over the tables, whose data stay; returns (table, what is missing)."""
    missing = []
    for table, (new, columns) in mapping.items():
        if not spark.catalog.tableExists(table):
            missing.append((table, "table"))
            continue
        df = spark.table(table)
        missing += [(table, c) for c in columns if c not in df.columns]
        df.withColumnsRenamed(columns).createOrReplaceTempView(new)
    return missing


def validate_renames(spark: SparkSession, mapping: DataFrame) -> DataFrame:
    """Rows of the mapping whose new table or column doesn't exist."""
    names = [r["new_table_name"] for r in mapping.select("new_table_name").distinct().collect()]
    there = [(t.lower(), c.lower()) for t in names if spark.catalog.tableExists(t) for c in spark.table(t).columns]
    found = spark.createDataFrame(there, "t string, c string")
    return mapping.join(found, (F.lower("new_table_name") == F.col("t")) & (F.lower("new_column_name") == F.col("c")), "left_anti")


def rewrite(sql: str, mapping: dict) -> str:
    """A query with tables and columns renamed outside its strings, whole words in any case; names before
    a parenthesis are functions and stay.  Qualified columns take their own table's name."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"\0{len(kept) - 1}\0"

    out = _STRING.sub(hide, sql)
    tables = {t.lower(): (new, {c.lower(): x for c, x in cols.items()}) for t, (new, cols) in mapping.items()}
    alias = {t: t for t in tables}
    for m in re.finditer(r"\b(?:FROM|JOIN|,)\s*`?(\w+)`?(?:\s+AS)?\s+`?(\w+)`?|,\s*`?(\w+)`?\s+AS\s+`?(\w+)`?", out, re.I):
        t, a = (m[1], m[2]) if m[1] else (m[3], m[4])
        if t.lower() in tables and a.upper() not in {"WHERE", "ON", "GROUP", "ORDER", "INNER", "LEFT", "JOIN", "LIMIT", "HAVING", "CROSS"}:
            alias[a.lower()] = t.lower()
    out = re.sub(r"\b(\w+)(\s*\.\s*)`?(\w+)`?", lambda m: m[1] + m[2] + tables[alias[m[1].lower()]][1].get(m[3].lower(), m[3]) if m[1].lower() in alias else m[0], out)
    bare = {c: x for t, cols in tables.values() for c, x in cols.items()}

    def name(m: re.Match) -> str:
        low = m[1].lower()
        if low in tables:
            return tables[low][0]
        return bare.get(low, m[0]) if not re.match(r"\s*\.", out[m.end() :]) and out[: m.start()].rstrip()[-1:] != "." else m[0]

    out = re.sub(r"`?\b([A-Za-z_]\w*)\b`?(?!\s*\()", name, out)
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], out)


def validate_rewritten(spark: SparkSession, corpus: list[tuple[int, str]], mapping: dict) -> DataFrame:
    """``(case_id, status, ex, error)``: each query on the tables against its rewriting on the renamed views."""
    cases = [(str(k), sql, rewrite(sql, mapping)) for k, sql in corpus]
    return techniques.evaluate_cases(spark, cases, "execution_accuracy").select("case_id", "status", "ex", "error")


def variants(corpus: DataFrame) -> DataFrame:
    """Four versions of each row: original or new wording with original or new SQL."""
    out = None
    for name, question, sql in (("original_nl_original_sql", "question", "sql"), ("original_nl_new_sql", "question", "new_sql"),
                                ("new_nl_original_sql", "new_question", "sql"), ("new_nl_new_sql", "new_question", "new_sql")):
        part = corpus.select("question_id", "db_id", F.lit(name).alias("variant"), F.col(question).alias("question"), F.col(sql).alias("sql"))
        out = part if out is None else out.unionAll(part)
    return out
