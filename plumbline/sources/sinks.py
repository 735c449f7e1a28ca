"""Writers of logs, corpora and reports, and runs that go on where they stopped."""

from __future__ import annotations

import json
import logging
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.graph import cut


def evaluation_log(scores: DataFrame, path: str) -> None:
    """Scores as JSON, a folder for each technique."""
    scores.write.mode("append").partitionBy("technique").json(path)


def query_files(queries: DataFrame, path: str) -> None:
    """Queries as JSON, and as lines of SQL, a tab and the database."""
    queries.write.mode("overwrite").json(f"{path}/json")
    queries.select(F.concat_ws("\t", F.regexp_replace("sql", r"[\n\t]+", " "), "db_id")).write.mode("overwrite").text(f"{path}/sql")


def extension_files(extended: DataFrame, originals: DataFrame, path: str) -> None:
    """Extended queries beside those they come from (by ``ext_id``), as ``query_files`` writes them."""
    extended.join(originals.select(F.col("question_id").alias("ext_id"), F.col("sql").alias("original_sql")), "ext_id", "left").write.mode("overwrite").json(f"{path}/aug")
    originals.join(extended.select(F.col("ext_id").alias("question_id")), "question_id", "left_semi").write.mode("overwrite").json(f"{path}/ori")
    query_files(extended, path)


def append(df: DataFrame, path: str, by: list[str]) -> None:
    """More rows for a partitioned Parquet table; what is there isn't rewritten."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def csv_sorted(df: DataFrame, path: str, key: str) -> None:
    df.orderBy(key).write.mode("overwrite").csv(path, header=True)


def export_sampled(sample: DataFrame, sources: list[DataFrame], path: str) -> None:
    """The sampled ids' queries out of several lists, by id."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    query_files(rows.join(sample.select("question_id"), "question_id", "left_semi").orderBy("question_id"), path)


def cells(todo: DataFrame, keys: list[str], columns: list[str], name: str = "column") -> DataFrame:
    """Work by cell: each row of ``todo`` once for each of ``columns``, which with ``keys`` is its key."""
    return todo.select(*keys, F.explode(F.lit(columns)).alias(name), *[c for c in todo.columns if c not in keys])


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """What a run has published at ``path``, or a plain Parquet table there; None if there is nothing.

    A run publishes epochs, folders of their own.  Spark marks a folder when its last file is in place; one without the
    mark is what a killed run has left, and isn't read.
    """
    if not exists(spark, path):
        return None
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    epochs = [f.getPath().toString() for f in files.listStatus(top) if f.getPath().getName().startswith("epoch=")]
    if not epochs:
        return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None
    done = [e for e in epochs if exists(spark, f"{e}/_SUCCESS")]
    return spark.read.parquet(*done) if done else None


def pending(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of ``todo`` whose keys aren't among those ``finished`` at ``path``.

    Keys are compared column by column, nulls as equal."""
    found = finished(todo.sparkSession, path)
    if found is None:
        return todo
    done = found.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    return todo.join(done, same, "left_anti")


def resume(todo: DataFrame, path: str, keys: list[str], work, at_once: int = 1000) -> int:
    """Does ``work`` (rows to rows) on what is pending, about ``at_once`` rows at a time; how many rows there were to do.

    Rows are dealt to epochs by a hash of their keys, and each epoch is published when it is whole.  A run that is killed
    loses what it was at, no more; the next one finds the rest pending.
    """
    left = cut(pending(todo, path, keys))
    n = left.count()
    epochs = -(-n // at_once)
    turn = F.pmod(F.xxhash64(*keys), F.lit(max(1, epochs)))
    for k in range(epochs):
        work(left.where(turn == k)).write.parquet(f"{path}/epoch={uuid.uuid4().hex}")
    return n


def exists(spark: SparkSession, path: str) -> bool:
    h = spark._jvm.org.apache.hadoop.fs.Path(path)
    return h.getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)


def parsed_queries(records: DataFrame, path: str) -> None:
    """Parsed queries (``queryspec.record``) as JSON, a folder for each database, those that are nested in one of their own."""
    records.where("not is_nested").write.mode("overwrite").partitionBy("db_id").json(f"{path}/flat")
    records.where("is_nested").select("question_id", "db_id", "sql").write.mode("overwrite").json(f"{path}/nested")


def consolidated(rows: DataFrame, path: str) -> None:
    """Generated queries as one table with folders by mode, split and status, which readers filter by."""
    rows.write.mode("append").partitionBy("mode", "split", "status").parquet(path)


def linker_statistics(rows: DataFrame, path: str) -> None:
    """Linked questions as JSON with their components, and their queries as lines of SQL."""
    rows.write.mode("overwrite").json(f"{path}/statistics")
    rows.orderBy("question_id").select(F.concat_ws("\t", F.regexp_replace("sql", r"[\n\t]+", " "), "db_id")).write.mode("overwrite").text(f"{path}/sql")


def splits(rows: DataFrame, path: str) -> None:
    """Rows with their split as Parquet, a folder for each of train, dev and test."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


class JsonLog(logging.Formatter):
    """Records of the standard logging as one line of JSON each: time, level, name, message, and the error if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)
