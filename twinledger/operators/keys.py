"""Key analysis: how often does each key occur on either side?

Category letters, by (rows on the left, rows on the right)::

    A 1/1   B 1/0   C 0/1   D n/1   E 1/n   F n/n   G n/0   H 0/n

Each side is counted with map-side partial aggregates, so a hot key leaves every map task as one
row. The two counts are co-partitioned by key and merged without a third exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, names

KEY, LEFT_ROWS, RIGHT_ROWS = "__key", "__left_rows", "__right_rows"

# The category letters and their descriptions are output of the operators.
CATEGORIES = {
    "A": "1:1 found in original and new tables",
    "B": "unique in original; not found in new table",
    "C": "not found in original; unique in new table",
    "D": "non-unique in original; unique in new table",
    "E": "unique in original; non-unique in new table",
    "F": "non-unique in both original and new tables",
    "G": "non-unique in original; not found in new table",
    "H": "not found in original; non-unique in new table",
}


def category(left_rows: Column, right_rows: Column) -> Column:
    """Category letter from the two row counts."""
    return (
        F.when((left_rows == 1) & (right_rows == 1), "A")
        .when((left_rows == 1) & (right_rows == 0), "B")
        .when((left_rows == 0) & (right_rows == 1), "C")
        .when((left_rows > 1) & (right_rows == 1), "D")
        .when((left_rows == 1) & (right_rows > 1), "E")
        .when((left_rows > 1) & (right_rows > 1), "F")
        .when((left_rows > 1) & (right_rows == 0), "G")
        .when((left_rows == 0) & (right_rows > 1), "H")
    )


def common_key_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """Type both keys are compared in. Text never equals a number, so mixing them is an error."""
    if left == right or (cells.is_text(left) and cells.is_text(right)):
        return left
    if cells.is_number(left) and cells.is_number(right):
        whole = (T.IntegralType, T.BooleanType)
        if isinstance(left, whole) and isinstance(right, whole):
            return T.LongType()
        if isinstance(left, (T.DecimalType, *whole)) and isinstance(right, (T.DecimalType, *whole)):
            scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (left, right))
            return T.DecimalType(38, scale)
        # Not every 64-bit number has a DOUBLE of its own; against one it is compared as text.
        return T.StringType() if isinstance(left, T.LongType) or isinstance(right, T.LongType) else T.DoubleType()
    if cells.is_date(left) and cells.is_date(right):
        return T.TimestampType()
    raise TypeError(
        f"key types {left.simpleString()} and {right.simpleString()} never match; cast one side or use numeric keys"
    )


def as_key(c: Column, dtype: T.DataType, target: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType) and not isinstance(target, T.BooleanType):
        c = c.cast("int")
    if isinstance(dtype, (T.FloatType, T.DoubleType)) and cells.is_text(target):
        # Whole values read as the whole number they are, so that they find it.
        whole = (c == F.floor(c)) & (F.abs(c) < float(2**63))
        return F.when(whole, F.when(whole, c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c if dtype == target else c.cast(target)


def key_columns(left: DataFrame, right: DataFrame, left_key: str | int, right_key: str | int,
                numeric: bool = False) -> tuple[Column, Column]:
    """The two key expressions, brought to one type."""
    lname, rname = names.resolve(left, left_key), names.resolve(right, right_key)
    ltype, rtype = left.schema[lname].dataType, right.schema[rname].dataType
    lcol, rcol = names.col(lname), names.col(rname)
    if numeric and not (cells.is_number(ltype) and cells.is_number(rtype)):
        return cells.numeric_key(lcol, ltype), cells.numeric_key(rcol, rtype)
    target = common_key_type(ltype, rtype)
    return as_key(lcol, ltype, target), as_key(rcol, rtype, target)


def negative_column(left: DataFrame, negative: DataFrame, left_key: str | int, negative_key: str | int,
                    numeric: bool, key_type: T.DataType) -> Column:
    """Key of the negative list, brought to the type the two tables are compared in."""
    _, nkey = key_columns(left, negative, left_key, negative_key, numeric)
    dtype = negative.select(nkey).schema[0].dataType
    if cells.is_text(dtype) and not cells.is_text(key_type):
        return nkey.try_cast(key_type)
    return as_key(nkey, dtype, key_type)


def tally(df: DataFrame, key: Column, rows_name: str, payload: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: how many rows it has and, for each payload, any one of its values.

    The payload only means something where the count is 1.
    """
    aggregates = [F.count(F.lit(1)).alias(rows_name)]
    aggregates += [F.any_value(value).alias(name) for name, value in (payload or {}).items()]
    return df.groupBy(key.alias(KEY)).agg(*aggregates)


def merge_tallies(tallies: list[DataFrame]) -> DataFrame:
    """Merge several :func:`tally` results over the same key type into one row per key."""
    merged = tallies[0]
    for other in tallies[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    counts = [c for c in (LEFT_ROWS, RIGHT_ROWS, NEGATIVE_ROWS) if c in merged.columns]
    payloads = [c for c in merged.columns if c != KEY and c not in counts]
    return merged.groupBy(KEY).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        *[F.any_value(F.col(c), F.lit(True)).alias(c) for c in payloads],
    )


NEGATIVE_ROWS = "__negative_rows"


def finds(stream_key: Column) -> Column:
    """Join condition from a streamed table to a key table that still has its row counts.

    NULL finds NULL. The key goes through a condition that always holds, so that the join hashes on
    something else than the aggregate that made the key table. Both inputs are then exchanges made for
    the join, which is what adaptive execution needs to split the partition of a hot key.
    """
    return stream_key.eqNullSafe(F.when(F.col(LEFT_ROWS) >= 0, F.col(KEY)))


def explained(cat: Column, negative_rows: Column) -> Column:
    """Yes / No for keys missing on the right, n/a for all others."""
    return F.when(~cat.isin("B", "G"), "n/a").when(negative_rows > 0, "Yes").otherwise("No")


def key_analysis(left: DataFrame, right: DataFrame, left_key: str | int, right_key: str | int,
                 negative: DataFrame | None = None, negative_key: str | int = 0,
                 numeric: bool = False) -> DataFrame:
    """Every key of either side with its category.

    Columns ``key, category, left_rows, right_rows`` and, with a negative list, ``explained``
    (Yes/No for the keys in B and G). NULL is a key like any other. Empty sides are fine.
    """
    lkey, rkey = key_columns(left, right, left_key, right_key, numeric)
    parts = [tally(left, lkey, LEFT_ROWS), tally(right, rkey, RIGHT_ROWS)]
    if negative is not None:
        nkey = negative_column(left, negative, left_key, negative_key, numeric, parts[0].schema[KEY].dataType)
        parts.append(tally(negative, nkey, NEGATIVE_ROWS))
    merged = merge_tallies(parts)
    cat = category(F.col(LEFT_ROWS), F.col(RIGHT_ROWS))
    out = [
        F.col(KEY).alias("key"),
        cat.alias("category"),
        F.col(LEFT_ROWS).alias("left_rows"),
        F.col(RIGHT_ROWS).alias("right_rows"),
    ]
    if negative is not None:
        merged = merged.where((F.col(LEFT_ROWS) > 0) | (F.col(RIGHT_ROWS) > 0))
        out.append(explained(cat, F.col(NEGATIVE_ROWS)).alias("explained"))
    return merged.select(*out)


def key_set(left: DataFrame, right: DataFrame, left_key: str | int, right_key: str | int,
            categories: str | list[str], numeric: bool = False) -> DataFrame:
    """Keys of the given categories, e.g. ``'ADEF'`` for the intersection or ``'BG'`` for left minus right."""
    wanted = list(categories)
    unknown = sorted(set(wanted) - set(CATEGORIES))
    if unknown:
        raise ValueError(f"unknown key categories {unknown}; known are {list(CATEGORIES)}")
    found = key_analysis(left, right, left_key, right_key, numeric=numeric)
    return found.where(F.col("category").isin(wanted)).select("key", "category")


def summarize_keys(keys: DataFrame) -> DataFrame:
    """One row per category, also those without keys: description and number of keys.

    The keys themselves are the rows of ``keys``; a cell cannot hold them.
    """
    letters = keys.sparkSession.createDataFrame(list(CATEGORIES.items()), "category string, description string")
    counted = keys.groupBy("category").agg(F.count(F.lit(1)).alias("keys_found"))
    return letters.join(F.broadcast(counted), "category", "left").select(
        "category", "description", F.coalesce("keys_found", F.lit(0)).alias("keys_found")
    )
