"""Profiles and previews of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, names

PREVIEW_CHARS = 50
SNAPSHOT_ROWS = SNAPSHOT_COLUMNS = 250


def column_uniqueness(df: DataFrame, column: str | int) -> tuple[DataFrame, DataFrame]:
    """Values occurring once, and values occurring more often, with their counts."""
    name = names.resolve(df, column)
    counted = df.groupBy(names.col(name).alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.where(F.col("occurrences") == 1), counted.where(F.col("occurrences") > 1)


def profile(df: DataFrame, order_by: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """One row per column: position, letters, name, type, filled cells, first value, smallest, largest.

    One aggregate pass over the table. The first value is that of the row smallest in ``order_by``;
    without an order it is that of any row. ``distinct`` adds an approximate distinct count.
    """
    fields = df.schema.fields
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    shown = []
    order = F.struct(*[names.col(names.resolve(df, c)) for c in order_by]) if order_by else None
    for i, f in enumerate(fields):
        c = names.col(f.name)
        preview = F.left(cells.render(c, f.dataType, "None"), F.lit(PREVIEW_CHARS))
        shown.append(preview.alias(f"p{i}"))
        aggregates.append(F.count(c).alias(f"filled{i}"))
        comparable = "map" not in f.dataType.simpleString()
        aggregates.append((F.min(c) if comparable else F.lit(None)).alias(f"min{i}"))
        aggregates.append((F.max(c) if comparable else F.lit(None)).alias(f"max{i}"))
        if distinct:
            aggregates.append((F.approx_count_distinct(c) if comparable else F.lit(None)).alias(f"distinct{i}"))
    first_row = F.struct(*shown)
    aggregates.append((F.min_by(first_row, order) if order is not None else F.any_value(first_row)).alias("first"))
    totals = df.agg(*aggregates)
    per_column = []
    for i, f in enumerate(fields):
        entry = [
            F.lit(i).alias("position"),
            F.lit(names.excel_column(i)).alias("letters"),
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows").alias("row_count"),
            F.col(f"filled{i}").alias("filled"),
            F.col("first")[f"p{i}"].alias("first_value"),
            cells.render(F.col(f"min{i}"), f.dataType).alias("smallest"),
            cells.render(F.col(f"max{i}"), f.dataType).alias("largest"),
        ]
        if distinct:
            entry.append(F.col(f"distinct{i}").cast("bigint").alias("approx_distinct"))
        per_column.append(F.struct(*entry))
    return totals.select(F.inline(F.array(*per_column)))


@dataclass(frozen=True)
class Snapshot:
    """A bounded, text-only view of a table."""

    row_count: int
    col_count: int
    truncated_rows: bool
    truncated_cols: bool
    column_labels: list[str]
    rows: DataFrame


def snapshot_rows(df: DataFrame, max_rows: int = SNAPSHOT_ROWS, max_cols: int = SNAPSHOT_COLUMNS,
                  order_by: list[str] | None = None) -> DataFrame:
    """The first rows and columns as text."""
    kept = df.orderBy(*[names.col(names.resolve(df, c)) for c in order_by]) if order_by else df
    return kept.limit(max_rows).select(*[
        cells.render(names.col(f.name), f.dataType, "None").alias(f.name) for f in df.schema.fields[:max_cols]
    ])


def snapshot(df: DataFrame, max_rows: int = SNAPSHOT_ROWS, max_cols: int = SNAPSHOT_COLUMNS,
             order_by: list[str] | None = None) -> Snapshot:
    """Table size, whether it was cut, column letters, and at most ``max_rows`` x ``max_cols`` cells."""
    total, width = df.count(), len(df.columns)
    return Snapshot(
        row_count=total,
        col_count=width,
        truncated_rows=total > max_rows,
        truncated_cols=width > max_cols,
        column_labels=[names.excel_column(i) for i in range(min(width, max_cols))],
        rows=snapshot_rows(df, max_rows, max_cols, order_by),
    )
