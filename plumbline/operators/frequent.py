"""The commonest values of each column, without a shuffle of all values of all columns.

Each task keeps a summary of a bounded number of counters a column (Misra and Gries, 1982, in its mergeable form): what a
counter has is at most the value's count, and all values together miss no more than the summary's error.  Where
nothing was cut off, the summaries are the counts.  Where the error is below the last wanted count, no other value can
come up to it, and only those that may are counted again.  Columns that neither holds for, such as keys, are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.graph import cut

#: Counters of a column that a task keeps.
CAPACITY = 1000


class Summary:
    """Lower bounds of values' counts, and how much any value may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.error = capacity, {}, 0

    def add(self, values: list, counts: list[int]) -> None:
        for v, n in zip(values, counts):
            self.counts[v] = self.counts.get(v, 0) + n
        if len(self.counts) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        """Takes the largest count that doesn't fit from all, and leaves out what has nothing then."""
        if len(self.counts) > self.capacity:
            least = sorted(self.counts.values(), reverse=True)[self.capacity]
            self.counts = {v: n - least for v, n in self.counts.items() if n > least}
            self.error += least


def summaries(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(place, value, n)``: each task's summary of each column of strings; the row without a value has its error."""
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Summary(capacity) for _ in range(width)]
        for batch in batches:
            for s, column in zip(held, batch.columns):
                found = pc.value_counts(column.drop_null())
                s.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        for k, s in enumerate(held):
            s.shrink()
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(s.counts) + 1), pa.int32()), pa.array([*s.counts, None], pa.string()), pa.array([*s.counts.values(), s.error], pa.int64())], ["place", "value", "n"])

    return df.mapInArrow(run, "place int, value string, n long")


def commonest(df: DataFrame, top: int = 10, capacity: int = CAPACITY) -> DataFrame:
    """``(column_name, value, n, rank)``: the ``top`` most frequent values of each column, as strings, without nulls; ties by value.

    Columns without a value have no row.
    """
    names = df.columns
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(names)])
    found = cut(summaries(rows, capacity))
    low = found.where("value IS NOT NULL").groupBy("place", "value").agg(F.sum("n").alias("n"))
    best = low.withColumn("r", F.row_number().over(W.partitionBy("place").orderBy(F.desc("n")))).where(F.col("r") <= top).groupBy("place").agg(F.min("n").alias("last"), F.count("*").alias("k"))
    errors = found.where("value IS NULL").groupBy("place").agg(F.sum("n").alias("error"))
    told = errors.join(best, "place", "left").collect()  # a row for each column
    sure = [r["place"] for r in told if r["error"] == 0]
    near = {r["place"]: r["last"] - r["error"] for r in told if r["error"] and r["k"] == top and r["error"] < r["last"]}
    whole = [k for k in range(len(names)) if k not in near and k not in sure and told]
    counted = low.where(F.col("place").isin(sure))
    for places, some in ((list(near), True), (whole, False)):
        if not places:
            continue
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"c{k}").alias("value")) for k in places])).alias("x")).select("x.*").where("value IS NOT NULL")
        if some:
            least = F.coalesce(*[F.when(F.col("place") == k, n) for k, n in near.items()])
            long = long.join(low.where(F.col("place").isin(places) & (F.col("n") >= least)).select("place", "value"), ["place", "value"], "left_semi")
        counted = counted.unionByName(long.groupBy("place", "value").agg(F.count("*").alias("n")))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)
    return ranked.select(F.element_at(F.lit(list(names)), F.col("place") + 1).alias("column_name"), "value", "n", "rank")
