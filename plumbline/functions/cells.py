"""Cells of result rows in forms that compare as values do, whatever their types."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(c: Column, kind: T.DataType) -> Column:
    """A text that is equal for equal cells: a letter for the family (z null, n number, s text,
    b bytes, d time, j nested) and the value.  ``'1'`` and ``1`` differ, ``1``, ``1.0`` and true don't."""
    if isinstance(kind, T.NullType):
        return F.lit("z")
    if isinstance(kind, T.BooleanType):
        v = F.concat(F.lit("n:"), c.cast("int").cast("string"))
    elif isinstance(kind, T.IntegralType):
        v = F.concat(F.lit("n:"), c.cast("string"))
    elif isinstance(kind, T.FractionalType):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0**53)
        v = F.concat(F.lit("n:"), F.when(whole, F.when(whole, d).cast("long").cast("string")).otherwise(d.cast("string")))
    elif isinstance(kind, T.StringType):
        v = F.concat(F.lit("s:"), c)
    elif isinstance(kind, T.BinaryType):
        v = F.concat(F.lit("b:"), F.hex(c))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        v = F.concat(F.lit("d:"), F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        v = F.concat(F.lit("j:"), F.to_json(c))
    else:
        v = F.concat(F.lit("s:"), c.cast("string"))
    return F.coalesce(v, F.lit("z"))


def cells(df: DataFrame, columns: list[int] | None = None) -> Column:
    """``array<string>`` of a row's cells, of the columns at the given positions or all of them."""
    fields = df.schema.fields
    chosen = range(len(fields)) if columns is None else columns
    out = [cell(F.col(f"`{df.columns[k]}`"), fields[k].dataType) for k in chosen]
    return F.array(*out) if out else F.array().cast("array<string>")


def py_str(c: Column, kind: T.DataType) -> Column:
    """A cell as Python's ``str`` writes it: None, True, 1.0, 1e-05."""
    if isinstance(kind, T.BooleanType):
        v = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):

        @F.pandas_udf("string")
        def written(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None or x != x else str(float(x)))

        v = written(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        v = F.to_json(c)
    else:
        v = c.cast("string")
    return F.coalesce(v, F.lit("None"))


def tokens(df: DataFrame) -> Column:
    """The set of a row's cells, as Python writes them."""
    return F.array_sort(F.array_distinct(F.array(*[py_str(F.col(f"`{n}`"), f.dataType) for n, f in zip(df.columns, df.schema.fields)])))


def unique_names(df: DataFrame) -> DataFrame:
    """``df`` with a repeated column name told apart by its position."""
    seen: set = set()
    names = []
    for k, n in enumerate(df.columns):
        names.append(f"{n}_{k}" if n in seen else n)
        seen.add(n)
    return df.toDF(*names)


def padded_row(df: DataFrame, names: list[str]) -> Column:
    """Cells of the given names, ``N/A`` where ``df`` has none, joined by a bar."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws(" | ", *[py_str(F.col(f"`{n}`"), kinds[n]) if n in kinds else F.lit("N/A") for n in names])
