"""Schema linking: predicted tables and columns held against those a query uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import providers
from plumbline.operators.reports import rounded


def links(schema: Column) -> Column:
    """The set of ``table_column`` (lower case) of a map from tables to columns."""
    return F.array_distinct(F.flatten(F.transform(F.map_entries(schema), lambda e: F.transform(e["value"], lambda c: F.concat(F.lower(e["key"]), F.lit("_"), F.lower(c))))))


def scores(df: DataFrame, gold: str, pred: str, total: str | None = None) -> DataFrame:
    """``df`` with precision, recall, f1, fpr and slr of the maps in two columns.

    A zero denominator gives 0; slr is 1 if nothing is missed (so also if nothing is wanted);
    ``total`` is the column with the number of columns in the whole schema, for fpr.
    """
    g, p = links(F.col(gold)), links(F.col(pred))
    tp, fp, fn = F.size(F.array_intersect(g, p)), F.size(F.array_except(p, g)), F.size(F.array_except(g, p))
    part = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tn = F.greatest(F.col(total) - tp - fp - fn, F.lit(0)) if total else F.lit(0)
    return df.withColumns({
        "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2.0 * tp, 2 * tp + fp + fn), "fpr": part(fp, fp + tn), "slr": (fn == 0).cast("int")})


def report(df: DataFrame, base: str = "OO") -> DataFrame:
    """``(combo, method, n, each score as an average in percent, and its difference from the base combo)``; rows with an error don't count."""
    names = ["precision", "recall", "f1", "slr"]
    good = df.where("error is null").groupBy("combo", "method").agg(F.count("*").alias("n"), *[rounded(F.avg(c) * 100, 1).alias(c) for c in names])
    first = good.where(F.col("combo") == base).select("method", *[F.col(c).alias(f"base_{c}") for c in names])
    return good.join(F.broadcast(first), "method", "left").select(  # a row for each method
        "combo", "method", "n", *names, *[F.round(F.col(c) - F.col(f"base_{c}"), 1).alias(f"delta_{c}") for c in names])


def improvements(df: DataFrame) -> DataFrame:
    """``(system, db_id, question_id, method, over_ol, over_lo)``: rows where both sides renamed (LL) link fully and one side alone doesn't."""
    wide = df.groupBy("system", "db_id", "question_id", "method").pivot("combo", ["LL", "OL", "LO"]).agg(F.max("slr"))
    ll = F.col("LL") == 1
    return wide.select("system", "db_id", "question_id", "method", F.coalesce(ll & (F.col("OL") == 0), F.lit(False)).alias("over_ol"), F.coalesce(ll & (F.col("LO") == 0), F.lit(False)).alias("over_lo"))


def translated(schema: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(question_id, schema)`` with tables and columns of a map renamed; what the mapping doesn't have stays."""
    one = schema.select("question_id", "db_id", F.explode("schema").alias("table_name", "columns")).select("*", F.explode_outer("columns").alias("column_name")).drop("columns")
    tables = mapping.select("db_id", "table_name", "new_table_name").distinct()
    named = one.join(tables, ["db_id", "table_name"], "left").join(mapping.select("db_id", "table_name", "column_name", "new_column_name"), ["db_id", "table_name", "column_name"], "left")
    rows = named.select("question_id", F.coalesce("new_table_name", "table_name").alias("t"), F.coalesce("new_column_name", "column_name").alias("c"))
    by_table = rows.groupBy("question_id", "t").agg(F.array_sort(F.collect_set("c")).alias("c"))
    return by_table.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "c")))).alias("schema"))


def schema_text(schema: Column) -> Column:
    """A map from tables to columns as lines ``Table a -> b, c``."""
    return F.array_join(F.transform(F.map_entries(schema), lambda e: F.concat(F.lit("Table "), e["key"], F.lit(" -> "), F.array_join(e["value"], ", "))), "\n")


def full_schema(columns: DataFrame) -> DataFrame:
    """``(db_id, schema)`` of catalogue rows (db_id, table_name, column_name)."""
    t = columns.groupBy("db_id", "table_name").agg(F.array_sort(F.collect_list("column_name")).alias("c"))
    return t.groupBy("db_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "c")))).alias("schema"))


def renamed_catalog(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Catalogue rows (db_id, table_name, column_name, ...) under the new names, each column by its own table; what the mapping doesn't have stays."""
    new = mapping.select("db_id", "table_name", "column_name", "new_column_name")
    tables = mapping.select("db_id", "table_name", "new_table_name").distinct()
    rows = columns.join(tables, ["db_id", "table_name"], "left").join(new, ["db_id", "table_name", "column_name"], "left")
    named = {"table_name": F.coalesce("new_table_name", "table_name"), "column_name": F.coalesce("new_column_name", "column_name")}
    return rows.select(*[named[c].alias(c) if c in named else F.col(c) for c in columns.columns])


def overview(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(db_id, text)``: a line for each table with its columns, and its keys; ``only`` (db_id, table_name, column_name) leaves others out,
    but for columns of keys between tables that stay."""
    named = lambda d, t, c: d.select("db_id", F.col(t).alias("table_name"), F.col(c).alias("column_name"))
    fks = foreign_keys
    if only is not None:
        tables = only.select("db_id", "table_name").distinct()
        for side in ("from", "to"):
            fks = fks.join(tables.withColumnRenamed("table_name", f"{side}_table"), ["db_id", f"{side}_table"], "left_semi")
        keys = named(fks, "from_table", "from_column").union(named(fks, "to_table", "to_column"))
        columns = columns.join(only.select("db_id", "table_name", "column_name").union(keys).distinct(), ["db_id", "table_name", "column_name"], "left_semi")
    pk = primary_keys.select("db_id", "table_name", "column_name", F.lit(" (key)").alias("mark"))
    each = columns.join(pk, ["db_id", "table_name", "column_name"], "left").groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.concat("column_name", F.coalesce("mark", F.lit(""))))).alias("c"))
    refs = fks.groupBy("db_id", F.col("from_table").alias("table_name")).agg(F.array_sort(F.collect_list(F.concat("from_column", F.lit(" -> "), "to_table", F.lit("."), "to_column"))).alias("r"))
    line = F.concat(F.lit("Table "), "table_name", F.lit(": "), F.array_join("c", ", "), F.when(F.col("r").isNotNull(), F.concat(F.lit("; "), F.array_join("r", ", "))).otherwise(""))
    return each.join(refs, ["db_id", "table_name"], "left").groupBy("db_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


METHODS = ("full", "tables_then_columns", "by_column")
#: What a model is asked for; an application may pass its own texts.
REQUESTS = {
    "tables": "Schema:\n{text}\nQuestion: {question}\nWhich tables does it need? Answer in JSON: [\"table\", ...]",
    "columns": "Schema:\n{text}\nQuestion: {question}\nWhich columns does it need? Answer in JSON: {\"table\": [\"column\", ...]}",
    "column": "Column {column} of table {table}\nQuestion: {question}\nDoes it need this column? Answer yes or no.",
}


def _asked(df: DataFrame, request: str, make, answer: str, **columns: str) -> DataFrame:
    prompt = F.lit(request)
    for name, column in columns.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
    return providers.completed(df.withColumn("_ask", prompt), "_ask", answer, make).drop("_ask")


def predicted_links(questions: DataFrame, columns: DataFrame, method: str, make=None, requests: dict[str, str] = REQUESTS) -> DataFrame:
    """``questions`` (question_id, db_id, question) with ``predicted``, a map from tables to columns, and ``error``.

    ``full`` takes the whole schema; ``tables_then_columns`` asks for tables and then for columns of these;
    ``by_column`` asks once for every column.  An answer that fails or can't be read gives the error and no links."""
    links_type = "map<string,array<string>>"
    schema = full_schema(columns)
    if method == "full":
        return questions.join(schema, "db_id", "left").select(*questions.columns, F.coalesce("schema", F.create_map().cast(links_type)).alias("predicted"), F.lit(None).cast("string").alias("error"))
    if method == "by_column":
        rows = questions.join(columns.select("db_id", "table_name", "column_name"), "db_id")  # as many as questions times a schema's columns: the method asks so often
        rows = _asked(rows, requests["column"], make, "_yes", column="column_name", table="table_name", question="question")
        yes = rows.groupBy(*questions.columns, "table_name").agg(F.array_sort(F.collect_list(F.when(F.lower(F.trim("_yes")).startswith("yes"), F.col("column_name")))).alias("c"), F.max(F.when(F.col("_yes") == "error", "error")).alias("e"))
        return yes.groupBy(*questions.columns).agg(
            F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("table_name", "c"))), lambda x: F.size(x["c"]) > 0)).alias("predicted"), F.max("e").alias("error"))
    if method != "tables_then_columns":
        raise ValueError(f"unknown method {method}")
    told = questions.join(schema, "db_id").withColumn("_text", schema_text(F.col("schema")))
    first = _asked(told, requests["tables"], make, "_tables", text="_text", question="question")
    names = F.transform(F.from_json("_tables", "array<string>"), F.lower)
    first = first.withColumn("_some", F.map_filter("schema", lambda t, c: F.array_contains(names, F.lower(t)))).withColumn("_text", schema_text(F.col("_some")))
    second = _asked(first, requests["columns"], make, "_columns", text="_text", question="question").withColumn("_p", F.from_json("_columns", links_type))
    bad = F.when((F.col("_tables") == "error") | (F.col("_columns") == "error"), "error").when(F.col("_p").isNull() | names.isNull(), "malformed")
    return second.select(*questions.columns, F.when(bad.isNull(), F.col("_p")).otherwise(F.create_map().cast(links_type)).alias("predicted"), bad.alias("error"))


def sweep(variants: dict[str, tuple[DataFrame, DataFrame]], methods: tuple[str, ...], make=None, done: DataFrame | None = None) -> DataFrame:
    """Links by every method for every combination of wording and schema (OO, OL, LO, LL: questions, columns), with ``combo`` and ``method``;
    rows of ``done`` (question_id, combo, method) are left out."""
    out = None
    for combo, (questions, columns) in variants.items():
        for method in methods:
            todo = questions
            if done is not None:
                todo = questions.join(done.where((F.col("combo") == combo) & (F.col("method") == method)).select("question_id"), "question_id", "left_anti").select(*questions.columns)
            part = predicted_links(todo, columns, method, make).withColumns({"combo": F.lit(combo), "method": F.lit(method)})
            out = part if out is None else out.unionByName(part)
    return out
