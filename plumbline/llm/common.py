"""What several operators of this package share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name, wherever Spark can read it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, label: str) -> str:
    """The folder, on the shared one, to which the rows are written as Parquet."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again (columnar, with sizes)."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a folder that ``written`` made and nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a value, with its class, and gives the function that opens it in a task.

    Spark pickles broadcast values by reference to their module, which an executor may not have.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def free(names: list[str], wanted: str) -> str:
    """A column name that is like none of ``names``: the wanted one, with as many underscores before it as it takes."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def mapped(df: DataFrame, columns: list, fn: Callable[[list], dict], schema: str) -> DataFrame:
    """``fn`` over Arrow batches: it gets one Python list per column and gives lists by name.

    Batches are bounded by rows and by bytes (``spark.sql.execution.arrow.max*PerBatch``).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)

    return df.select(*columns).mapInArrow(run, schema)
