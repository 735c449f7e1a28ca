"""Where queries run: Spark itself over views of files, of database files, or of tables of another database over JDBC."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import Filter

from plumbline.sources import databases


class Backend:
    """Runs SQL; subclasses provide the tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.connect()

    def connect(self) -> None:
        """Makes the tables available."""

    def run_query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def is_alive(self) -> bool:
        return self.spark.sql("SELECT 1 AS one").first()["one"] == 1

    def catalog(self) -> DataFrame:
        """``(table_name, column_name, data_type, position)`` of its tables."""
        rows = [(t, f.name, f.dataType.simpleString(), k) for t in self.tables() for k, f in enumerate(self.spark.table(t).schema.fields)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def cardinalities(self) -> DataFrame:
        """Rows of each table, counted in one plan."""
        out = None
        for t in self.tables():
            n = self.spark.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
            out = n if out is None else out.unionAll(n)
        return out if out is not None else self.spark.createDataFrame([], "table_name string, n long")

    def close(self) -> None:
        """Nothing is held between queries."""


class Parquet(Backend):
    """Views over a folder of ``<table>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str]):
        self.folder, self.names = folder, names
        super().__init__(spark)

    def connect(self) -> None:
        for t in self.names:
            self.spark.read.parquet(f"{self.folder}/{t}.parquet").createOrReplaceTempView(t)

    def tables(self) -> list[str]:
        return sorted(self.names)


class Database(Backend):
    """Views over the tables of a SQLite or DuckDB file, read by ranges of rows (see ``databases``)."""

    def __init__(self, spark: SparkSession, kind: str, path: str, names: list[str] | None = None, partitions: int | None = None, keys: dict[str, str] | None = None):
        self.engine, self.kind, self.path, self.names = databases.ENGINES[kind], kind, path, names
        self.partitions, self.keys = partitions or spark.sparkContext.defaultParallelism, keys or {}
        super().__init__(spark)

    def connect(self) -> None:
        self.spark.dataSource.register(databases.TableSource)
        with closing(self.engine.connect(self.path)) as con:
            self.names = self.names or self.engine.tables(con)
        for t in self.names:
            self.table(t).createOrReplaceTempView(t)

    def table(self, name: str, columns: list[str] | None = None, where: Sequence[Filter] = ()) -> DataFrame:
        """A table, or those of its columns and rows that are named (``pyspark.sql.datasource`` filters): no others leave the database."""
        reader = self.spark.read.format(databases.TableSource.name()).options(kind=self.kind, path=self.path, table=name, partitions=self.partitions)
        if name in self.keys:
            reader = reader.option("key", self.keys[name])
        if columns is not None or where:
            with closing(self.engine.connect(self.path)) as con:
                known = self.engine.columns(con, name)
            kinds = {c.name: c.kind for c in known}
            reader = reader.schema(T.StructType([T.StructField(c, kinds[c]) for c in (kinds if columns is None else columns)])).option("where", databases.conditions(list(where), known, self.engine.exact))
        return reader.load()

    def tables(self) -> list[str]:
        return sorted(self.names)

    def catalog(self) -> DataFrame:
        """``(table_name, column_name, data_type, position, key)`` from the database itself; ``key``: place in the primary key, 0 outside."""
        with closing(self.engine.connect(self.path)) as con:
            rows = [(t, c.name, c.kind.simpleString(), k, c.key) for t in self.tables() for k, c in enumerate(self.engine.columns(con, t))]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int, key int")

    def foreign_keys(self) -> DataFrame:
        """``(from_table, from_column, to_table, to_column)`` as declared, for the schema graph."""
        with closing(self.engine.connect(self.path)) as con:
            rows = [r for t in self.tables() for r in self.engine.foreign_keys(con, t)]
        return self.spark.createDataFrame(rows, _KEYS)


class Jdbc(Backend):
    """Views over tables of a database with a JDBC driver on the class path; predicates and columns are pushed to it.

    Tables with a column of whole numbers in ``keys`` are read in ``partitions`` ranges of it.
    """

    def __init__(self, spark: SparkSession, url: str, names: list[str], keys: dict[str, str] | None = None, partitions: int | None = None, **options: str):
        self.url, self.names, self.keys, self.options = url, names, keys or {}, options
        self.partitions = partitions or spark.sparkContext.defaultParallelism
        super().__init__(spark)

    def connect(self) -> None:
        for t in self.names:
            self.table(t).createOrReplaceTempView(t)

    def _reader(self):
        return self.spark.read.format("jdbc").options(url=self.url, **self.options)

    def table(self, name: str) -> DataFrame:
        reader, key = self._reader().option("dbtable", name), self.keys.get(name)
        if key:
            low, high = self._reader().option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").load().first()
            if low is not None:
                reader = reader.options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=self.partitions)
        return reader.load()

    def tables(self) -> list[str]:
        return sorted(self.names)

    def foreign_keys(self) -> DataFrame:
        """``(from_table, from_column, to_table, to_column)`` from the driver's metadata."""
        con = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, self.options.get("user"), self.options.get("password"))
        try:
            rows = []
            for t in self.tables():
                found = con.getMetaData().getImportedKeys(None, None, t.upper() if con.getMetaData().storesUpperCaseIdentifiers() else t)
                while found.next():
                    rows.append(tuple(found.getString(c) for c in ("FKTABLE_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")))
        finally:
            con.close()
        return self.spark.createDataFrame(sorted(rows), _KEYS)


_KEYS = "from_table string, from_column string, to_table string, to_column string"
BACKENDS = {"parquet": Parquet, "jdbc": Jdbc}


def open_backend(kind: str, spark: SparkSession, *args, **options) -> Backend:
    if kind in databases.ENGINES:
        return Database(spark, kind, *args, **options)
    if kind not in BACKENDS:
        raise ValueError(f"unknown backend {kind}")
    return BACKENDS[kind](spark, *args, **options)
