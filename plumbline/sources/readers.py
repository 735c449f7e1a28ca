"""Readers of the artefacts that experiments leave: JSON, JSON lines, CSV, and keys in file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "question_id int, db_id string, question string, evidence string, SQL string, difficulty string"
CATALOG = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, foreign_keys array<array<int>>, primary_keys array<string>"


def require(spark: SparkSession, *paths: str) -> None:
    """Raises FileNotFoundError with all paths, on any file system that Spark reads, that don't exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def json_array(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; bad ones are left out."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def json_by_file_name(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of ``<question_id>_<db_id>.json``: its rows with both keys from the name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = spark.read.json(folder, schema=schema, multiLine=True).withColumn("_f", name)
    return rows.withColumns({"question_id": F.regexp_extract("_f", r"^(\d+)_", 1).cast("int"), "db_id": F.regexp_extract("_f", r"^\d+_([^.]+)", 1)}).drop("_f")


def final_sql(messages: str = "messages") -> F.Column:
    """Of an array of structs the first ``final_SQL`` that isn't null."""
    return F.try_element_at(F.filter(F.transform(messages, lambda m: m["final_SQL"]), lambda x: x.isNotNull()), F.lit(1))


def csv_rows(spark: SparkSession, path: str, schema: str, key: str = "question_id", multiline: bool = True) -> DataFrame:
    """A CSV file, or a folder of them by name, with a row's place as its key.

    Spark reads a file's pieces in tasks of its choice, so places are told by the piece: a first pass counts the rows of
    each, the second adds what comes before, by file and place in it; no rows move.  With ``multiline`` cells may hold
    line ends, and a file is one piece.
    """
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=multiline, escape='"')
    rows = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s")).withColumn("_m", F.monotonically_increasing_id())
    sizes = rows.groupBy("_f", "_s").agg(F.count("*").alias("n"), F.min("_m").alias("first")).orderBy("_f", "_s").collect()  # a row for each piece
    before, total = [], 0
    for r in sizes:
        before.append((r["_f"], r["_s"], total - r["first"]))
        total += r["n"]
    placed = rows.join(spark.createDataFrame(before, "_f string, _s long, _before long"), ["_f", "_s"], "left")
    return placed.withColumn(key, (F.col("_before") + F.col("_m")).cast("int")).drop("_f", "_s", "_m", "_before")


def column_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """``(table_name, column_name, description, data_format)`` of a folder of CSV files, one a table.

    White space is squeezed; ``nan`` and ``none``, and a description that is the name, are null.
    """
    raw = spark.read.csv(folder, header=True, schema="original_column_name string, column_name string, column_description string, data_format string, value_description string")
    clean = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan", "none"), None).otherwise(F.trim(F.regexp_replace(c, r"\s+", " ")))
    name = clean("original_column_name")
    text = F.coalesce(clean("column_description"), clean("column_name"))
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("table_name"), name.alias("column_name"),
                      F.when(F.lower(text) != F.lower(name), text).alias("description"), clean("data_format").alias("data_format"))


def catalog(schemas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, primary keys, foreign keys) of schema descriptions whose columns are pairs (table's place, name).

    Keys refer to columns by place; a primary key is a place or a JSON list of places.
    """
    cols = schemas.select("db_id", "table_names_original", "column_types", F.posexplode("column_names_original").alias("at", "c"))
    cols = cols.where(F.col("c")[0].cast("int") >= 0).select(
        "db_id", "at", F.col("table_names_original")[F.col("c")[0].cast("int")].alias("table_name"), F.col("c")[1].alias("column_name"), F.try_element_at("column_types", F.col("at") + 1).alias("data_type"))
    key = schemas.select("db_id", F.explode("primary_keys").alias("k")).select(
        "db_id", F.explode(F.when(F.col("k").startswith("["), F.from_json("k", "array<int>")).otherwise(F.array(F.col("k").try_cast("int")))).alias("at"))
    pks = key.join(cols, ["db_id", "at"]).select("db_id", "table_name", "column_name")
    pair = schemas.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))
    a, b = (cols.select("db_id", F.col("at").alias(x), F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}_column")) for x, p in (("a", "from"), ("b", "to")))
    fks = pair.join(a, ["db_id", "a"]).join(b, ["db_id", "b"]).select("db_id", "from_table", "from_column", "to_table", "to_column")
    return cols.drop("at"), pks, fks


def named_catalog(tables: DataFrame) -> DataFrame:
    """Foreign keys of (db_id, table_name, foreign_keys array<struct<column, referenced>>) where the referenced
    name is ``table#sep#column``; those of unknown tables are left out."""
    one = tables.select("db_id", F.col("table_name").alias("from_table"), F.explode("foreign_keys").alias("k"))
    cut = F.split(F.col("k")["referenced"], "#sep#")
    fks = one.select("db_id", "from_table", F.element_at(F.split(F.col("k")["column"], "#sep#"), -1).alias("from_column"), cut[0].alias("to_table"), F.element_at(cut, -1).alias("to_column"))
    return fks.join(tables.select("db_id", F.col("table_name").alias("to_table")), ["db_id", "to_table"], "left_semi")


def with_extra_keys(fks: DataFrame, extra: DataFrame) -> DataFrame:
    """More keys for a schema: not those of a table to itself, nor those known in either direction."""
    ends = ["from_table", "from_column", "to_table", "to_column"]
    side = lambda t, c: F.struct(F.col(t).alias("t"), F.col(c).alias("c"))
    both = F.array_sort(F.array(side("from_table", "from_column"), side("to_table", "to_column")))
    new = extra.where("from_table <> to_table").withColumn("_k", both).dropDuplicates(["_k"]).join(fks.withColumn("_k", both).select("_k"), "_k", "left_anti")
    return fks.select(*ends).unionByName(new.select(*ends))


def tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """Several systems' logs as one, with the system's name."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("system", "question_id")


def graphs_of_size(spark: SparkSession, path: str, tables: int) -> DataFrame:
    """Query graphs with so many tables, from Parquet partitioned by that number: only their folder is read."""
    return spark.read.parquet(path).where(F.col("num_tables") == tables)


def score_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Score files ``..._<technique>.json`` that a pattern finds, as one table with the technique from the name."""
    name = F.regexp_extract(F.input_file_name(), r"scores_([^/]+?)\.json$", 1)
    return spark.read.json(pattern, schema=schema, multiLine=True).withColumn("technique", name)


def error_patterns(scores: DataFrame) -> DataFrame:
    """The different error patterns of some scores."""
    return scores.where("error_pattern is not null").select("error_pattern").distinct()


class Prompts:
    """Prompt texts by name from a folder on any file system that Spark reads; each is read once.  Values go into ``{name}``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.known = spark, folder, {}

    def text(self, name: str) -> str:
        if name not in self.known:
            path = f"{self.folder}/{name}.txt"
            require(self.spark, path)
            self.known[name] = self.spark.read.text(path, wholetext=True).first()[0]
        return self.known[name]

    def render(self, name: str, **values: object) -> str:
        return self.text(name).format(**values)


def messages(system: str, examples: list[tuple[str, str]], question: str) -> list[dict[str, str]]:
    """A chat: the system's text, examples as turns of user and assistant, and the question."""
    turns = [m for q, a in examples for m in ({"role": "user", "content": q}, {"role": "assistant", "content": a})]
    return [{"role": "system", "content": system}] * bool(system) + turns + [{"role": "user", "content": question}]
