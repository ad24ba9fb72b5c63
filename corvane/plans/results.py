"""Results: typed rows with true counts, tab-separated text, response masks and budgeted rendering."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import json_text

#: Rows that a query returns when it does not say.
MAX_ROWS = 200
#: External names of types.
NAMES = {
    T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BLOB",
}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)}[]"
    if isinstance(kind, T.MapType):
        return f"MAP({type_name(kind.keyType)}, {type_name(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in kind) + ")"
    return NAMES.get(type(kind), kind.simpleString().upper())


def _plain(column: Column, kind: T.DataType) -> Column:
    """Binary as base64, at any depth."""
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_plain(column[f.name], f.dataType).alias(f.name) for f in kind)))
    return column


def cell(column: Column, kind: T.DataType) -> Column:
    """A value as text; null stays null, which is not the empty string. Nested values are compact JSON."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return json_text(_plain(column, kind))
    return _plain(column, kind).cast("string")


def cells(rows: DataFrame) -> DataFrame:
    """rows with every column as text."""
    return rows.select(*(cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema))


@dataclass
class Result:
    """Columns with external types, text cells of at most max_rows rows, and the true count."""

    columns: list[tuple[str, str]]
    rows: list[tuple]
    total_rows: int
    truncated: bool
    elapsed_ms: int
    frame: DataFrame = field(repr=False)

    def tokens(self) -> int:
        return sum(-(-len(c or "") // 4) for r in self.rows for c in r)

    def footer(self) -> str:
        return f"[{len(self.rows)} rows | {self.tokens()} tok | {self.elapsed_ms} ms]"

    def tsv(self) -> Iterator[str]:
        """A summary line, the header, the rows, and a blank line. Tabs and line ends in cells are blanks; null is empty."""
        yield self.footer()
        yield "\t".join(n for n, _ in self.columns)
        for row in self.rows:
            yield "\t".join((c or "").translate({9: " ", 10: " ", 13: " "}) for c in row)
        yield ""


def typed(rows: DataFrame, max_rows: int = 0) -> Result:
    """The delivered rows and the count of all of them; a result that fits is not counted twice."""
    began, most = time.monotonic(), max_rows or MAX_ROWS
    held = [tuple(r) for r in cells(rows).limit(most + 1).collect()]  # at most one row more than is delivered
    total = len(held) if len(held) <= most else rows.count()
    return Result([(f.name, type_name(f.dataType)) for f in rows.schema], held[:most], total, total > most, int((time.monotonic() - began) * 1000), rows)


def tsv_lines(rows: DataFrame) -> DataFrame:
    """rows as lines of tab-separated text, made by the engine: for results that are written, not shown."""
    clean = [F.translate(F.coalesce(c, F.lit("")), "\t\n\r", "   ") for c in (cell(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema)]
    return rows.select(F.concat_ws("\t", *clean).alias("line"))


def masked(rows: DataFrame, mask: list[str]) -> DataFrame:
    """The wanted top-level fields; an unknown one is an error. What is not wanted is never computed."""
    unknown = [m for m in mask if m not in rows.columns]
    if unknown:
        raise ValueError(f"INVALID_ARGUMENT: unknown fields {', '.join(unknown)}; known: {', '.join(rows.columns)}")
    return rows.select(*(F.col(f"`{m}`") for m in mask)) if mask else rows
