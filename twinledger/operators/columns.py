"""Whole-table column operators: extract, square, union of headers, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, names


def extract_column(df: DataFrame, column: str | int) -> DataFrame:
    """One column as a table of its own."""
    return df.select(names.col(names.resolve(df, column)))


def strip_cells(df: DataFrame) -> DataFrame:
    """Trim every text cell of a table."""
    return df.select(*[
        cells.strip(names.col(f.name)).alias(f.name) if cells.is_text(f.dataType) else names.col(f.name)
        for f in df.schema.fields
    ])


def square_rows(df: DataFrame, column: str | int, width: int, fill: str = "") -> DataFrame:
    """Pad short and cut long arrays of cells to one width."""
    name = names.resolve(df, column)
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        raise TypeError(f"column {name!r} must be an array of cells")
    padded = F.concat(names.col(name), F.array_repeat(F.lit(fill), width))
    return df.withColumn(name, F.slice(padded, 1, width))


def spread_cells(df: DataFrame, column: str | int, header: list[str], fill: str = "") -> DataFrame:
    """Turn an array of cells into columns, squaring it to the header's width."""
    name = names.resolve(df, column)
    squared = square_rows(df, name, len(header), fill)
    return squared.select(*[
        F.get(names.col(name), F.lit(i)).alias(h) for i, h in enumerate(names.unique_names(header))
    ])


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of several tables under the union of their headers, in order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_columns(df: DataFrame, limit: int | None) -> DataFrame:
    """At most ``limit`` columns, from the left."""
    return df if limit is None else df.select(*[names.col(c) for c in df.columns[:limit]])
