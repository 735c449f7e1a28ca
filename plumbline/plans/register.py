"""The registered queries, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of the session (with the tables as views) under its name."""

    def add(fn: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            star.register(spark, sf_dir)
            for t in ("documents", "embeddings", "conversations"):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            return fn(spark)

        key = name or fn.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return add
