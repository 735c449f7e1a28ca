"""Tables of database files as DataFrames: ranges of row numbers are partitions, filters are the database's work.

A data source for SQLite and DuckDB files that all executors see under one path.  Each task opens the file for
reading and asks for one range of row numbers (or of a key that is named), with the columns of its schema and the
filters it was made with.  Filters are named when a table is opened: what Spark 4.1 itself hands to a source in Python is
kept with the relation, so that a view used twice in a query would read one use's rows for the other.
"""

from __future__ import annotations

import datetime
import json
import math
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Rows that a task fetches at a time, and values of a list that is still handed to the database.
FETCH, LISTED = 8192, 500


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Column:
    name: str
    kind: T.DataType
    key: int  # place in the primary key, from 1; 0 if it isn't of it


class Sqlite:
    """What SQLite says about its tables."""

    def connect(self, path: str):
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def tables(self, con) -> list[str]:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]

    def columns(self, con, table: str) -> list[Column]:
        return [Column(r[1], self._kind((r[2] or "").upper()), r[5]) for r in con.execute(f"PRAGMA table_info({quoted(table)})")]

    def _kind(self, said: str) -> T.DataType:
        """By the declared type, as SQLite itself derives affinities."""
        rules = (("INT", T.LongType()), ("CHAR|CLOB|TEXT|DATE|TIME", T.StringType()), ("BLOB", T.BinaryType()), ("REAL|FLOA|DOUB|DEC|NUM", T.DoubleType()), ("BOOL", T.BooleanType()))
        return next((kind for words, kind in rules if re.search(words, said)), T.StringType())

    def foreign_keys(self, con, table: str) -> list[tuple[str, str, str, str]]:
        out = []
        for r in con.execute(f"PRAGMA foreign_key_list({quoted(table)})").fetchall():
            to = r[4] or next((c.name for c in self.columns(con, r[2]) if c.key == r[1] + 1), None)  # none named: the primary key
            out.append((table, r[3], r[2], to))
        return sorted(out)

    def value(self, v, kind: T.DataType, column: str):
        """A stored value as its column's type; SQLite keeps whatever was put in, so one of another type raises ValueError."""
        if v is None:
            return None
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else str(v)
        try:
            if isinstance(kind, T.BooleanType):
                return bool(int(v))
            if isinstance(kind, T.BinaryType):
                return v.encode() if isinstance(v, str) else bytes(v)
            if isinstance(kind, T.LongType) and isinstance(v, float) and v != int(v):
                raise ValueError
            return int(v) if isinstance(kind, T.LongType) else float(v)
        except (TypeError, ValueError):
            raise ValueError(f"column {column} has {v!r}, which is no {kind.simpleString()}") from None

    exact = " COLLATE BINARY"  # text is compared by its bytes, as in Spark, whatever order a column declares


class DuckDb:
    """What DuckDB says about its tables."""

    exact = ""

    def connect(self, path: str):
        import duckdb

        return duckdb.connect(path, read_only=True)

    def tables(self, con) -> list[str]:
        return [r[0] for r in con.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' ORDER BY 1").fetchall()]

    def columns(self, con, table: str) -> list[Column]:
        keys = con.execute("SELECT constraint_column_names FROM duckdb_constraints() WHERE table_name = ? AND constraint_type = 'PRIMARY KEY'", [table]).fetchone()
        place = {c: k + 1 for k, c in enumerate(keys[0] if keys else [])}
        rows = con.execute("SELECT column_name, data_type FROM information_schema.columns WHERE table_schema = 'main' AND table_name = ? ORDER BY ordinal_position", [table]).fetchall()
        return [Column(n, self._kind(t), place.get(n, 0)) for n, t in rows]

    def _kind(self, said: str) -> T.DataType:
        plain = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
                 "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "BLOB": T.BinaryType()}
        if m := re.fullmatch(r"DECIMAL\((\d+),\s*(\d+)\)", said):
            return T.DecimalType(int(m[1]), int(m[2]))
        return plain.get(said, T.StringType())  # whatever else there is, as text

    def foreign_keys(self, con, table: str) -> list[tuple[str, str, str, str]]:
        rows = con.execute("SELECT constraint_text FROM duckdb_constraints() WHERE table_name = ? AND constraint_type = 'FOREIGN KEY'", [table]).fetchall()
        out = []
        for (said,) in rows:
            m = re.search(r"FOREIGN KEY\s*\((.*?)\)\s*REFERENCES\s+(\S+?)\s*\((.*?)\)", said, re.I)
            names = [[x.strip().strip('"') for x in m[k].split(",")] for k in (1, 3)]
            out += [(table, a, m[2].strip('"'), b) for a, b in zip(*names)]
        return sorted(out)

    def value(self, v, kind: T.DataType, column: str):
        return v if v is None or not isinstance(kind, T.StringType) or isinstance(v, str) else str(v)


ENGINES = {"sqlite": Sqlite(), "duckdb": DuckDb()}


def condition(f: D.Filter, kinds: dict[str, T.DataType], exact: str) -> tuple[str, list] | None:
    """A filter as SQL with its parameters; None if the database might decide it otherwise than Spark."""
    if isinstance(f, D.Not):
        inner = condition(f.child, kinds, exact)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1 or f.attribute[0] not in kinds:
        return None
    name, kind = quoted(f.attribute[0]), kinds[f.attribute[0]]
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, D.IsNotNull)}NULL", []
    text = isinstance(kind, T.StringType)

    def fits(v) -> bool:
        if text:
            return isinstance(v, str) and "\0" not in v
        if isinstance(kind, T.BooleanType):
            return isinstance(v, bool)
        if isinstance(kind, (T.DateType, T.TimestampNTZType)):
            return isinstance(v, datetime.date) and isinstance(v, datetime.datetime) == isinstance(kind, T.TimestampNTZType)
        if isinstance(kind, T.IntegralType):
            return isinstance(v, int) and not isinstance(v, bool)
        return isinstance(kind, T.DoubleType) and isinstance(v, float) and math.isfinite(v)

    if isinstance(f, D.In):
        ok = 0 < len(f.value) <= LISTED and all(map(fits, f.value))
        return (f"{name}{exact if text else ''} IN ({', '.join('?' * len(f.value))})", list(f.value)) if ok else None
    if not fits(f.value):
        return None
    if isinstance(f, (D.StringStartsWith, D.StringEndsWith, D.StringContains)):
        n = len(f.value)
        if not n:
            return None
        if isinstance(f, D.StringContains):
            return f"instr({name}, ?) > 0", [f.value]
        return (f"substr({name}, 1, {n})" if isinstance(f, D.StringStartsWith) else f"substr({name}, -{n})") + f"{exact} = ?", [f.value]
    signs = {D.EqualTo: "=", D.EqualNullSafe: "IS NOT DISTINCT FROM", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
    sign = signs.get(type(f))
    return sign and (f"{name}{exact if text else ''} {sign} ?", [f.value])


def conditions(filters: list[D.Filter], columns: list[Column], exact: str) -> str:
    """Filters, all of which must hold, as the option ``where``; one that the database might decide otherwise than Spark raises ValueError."""
    kinds, out = {c.name: c.kind for c in columns}, []
    for f in filters:
        found = condition(f, kinds, exact)
        if found is None:
            raise ValueError(f"{f} can't be left to the database")
        out.append((found[0], [v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat() if isinstance(v, datetime.date) else v for v in found[1]]))
    return json.dumps(out)


class Range(D.InputPartition):
    """Row numbers or keys from ``low`` up to, without, ``high``; without bounds the whole table."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))


class TableReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.kind, self.path, self.table = options["kind"], options["path"], options["table"]
        self.wanted, self.key, self.schema = int(options.get("partitions", 8)), options.get("key"), schema
        self.where: list[tuple[str, list]] = json.loads(options.get("where", "[]"))

    def partitions(self) -> list[Range]:
        """Equal ranges of the key, or of row numbers; a view or table without either is one."""
        engine = ENGINES[self.kind]
        with closing(engine.connect(self.path)) as con:
            columns = engine.columns(con, self.table)
            name = quoted(self.key) if self.key else "rowid"
            if self.key and not any(c.name == self.key and isinstance(c.kind, T.IntegralType) for c in columns):
                raise ValueError(f"{self.key} is no column of whole numbers")
            try:
                low, high = con.execute(f"SELECT min({name}), max({name}) FROM {quoted(self.table)}").fetchone()
            except Exception:  # no row numbers: each engine has its own error
                keys = [c for c in columns if c.key]
                if len(keys) != 1 or not isinstance(keys[0].kind, T.IntegralType):
                    return [Range(None, None)]
                self.key, name = keys[0].name, quoted(keys[0].name)
                low, high = con.execute(f"SELECT min({name}), max({name}) FROM {quoted(self.table)}").fetchone()
        if not isinstance(low, int):
            return [Range(None, None)]
        n = max(1, min(self.wanted, high - low + 1))
        ends = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [Range(a, b) for a, b in zip([None, *ends[1:-1]], [*ends[1:-1], None])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        engine, (low, high) = ENGINES[self.kind], partition.value
        key = quoted(self.key) if self.key else "rowid"
        bounds = ([(f"({key} >= ?)", [low])] if low is not None else []) + ([(f"({key} < ?" + (f" OR {key} IS NULL)" if low is None else ")"), [high])] if high is not None else [])
        where = [*bounds, *self.where]
        fields = self.schema.fields
        sql = f"SELECT {', '.join(quoted(f.name) for f in fields) or '1'} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(f"({s})" for s, _ in where) if where else "")
        arrow = to_arrow_schema(self.schema)
        with closing(engine.connect(self.path)) as con:
            cursor = con.execute(sql, [v for _, values in where for v in values])
            while rows := cursor.fetchmany(FETCH):
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([engine.value(v, f.dataType, f.name) for v in c], a.type) for f, a, c in zip(fields, arrow, columns)], schema=arrow)


class TableSource(D.DataSource):
    """``spark.read.format("plumbline_table")`` with the options kind, path, table, partitions, key and where (see ``conditions``)."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_table"

    def schema(self) -> T.StructType:
        engine = ENGINES[self.options["kind"]]
        with closing(engine.connect(self.options["path"])) as con:
            columns = engine.columns(con, self.options["table"])
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(c.name, c.kind) for c in columns])

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(dict(self.options), schema)
