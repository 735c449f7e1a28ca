"""Evaluation of cases as they arrive in a folder, each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.sinks import pending


def evaluate_arrivals(spark: SparkSession, folder: str, schema: str, keys: list[str], work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on new rows of the JSON files in a folder and appends results to Parquet at ``out``.

    A batch that is repeated after a failure finds its keys in ``out`` and isn't done again; keys
    that come twice are done once.  The query ends when what is there is done.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = pending(rows.dropDuplicates(keys), out, keys)
        if not new.isEmpty():
            work(new).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
