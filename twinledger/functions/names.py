"""Column names: spreadsheet letters, name/position lookup, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SHEET_COLUMNS = 16384  # A .. XFD


def excel_column(index: int) -> str:
    """Spreadsheet letters of a zero-based column position (0 -> A, 16383 -> XFD)."""
    if isinstance(index, bool) or not isinstance(index, (int, float)) or int(index) != index:
        raise TypeError("column position must be a whole number")
    if not 0 <= index < MAX_SHEET_COLUMNS:
        raise IndexError(f"column position must be between 0 and {MAX_SHEET_COLUMNS - 1}")
    number, letters = int(index) + 1, ""
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(ord("A") + rest) + letters
    return letters


def quoted(name: str) -> str:
    """Back-tick a name so dots and back-ticks in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name contains."""
    return F.col(quoted(name))


def position(df: DataFrame, column: str | int) -> int:
    """Zero-based position of a column given by name or by position; a name must occur once."""
    names = df.columns
    if isinstance(column, bool) or not isinstance(column, (str, int)):
        raise TypeError(f"column must be a name or a position, not {column!r}")
    if isinstance(column, int):
        if not 0 <= column < len(names):
            raise IndexError(f"column position {column} is out of range (table has {len(names)} columns)")
        return column
    hits = names.count(column)
    if hits != 1:
        state = "not found" if not hits else "not unique"
        raise KeyError(f"column {column!r} {state} in table with columns {names}")
    return names.index(column)


def resolve(df: DataFrame, column: str | int) -> str:
    """Name of a column given by name or by position; the name must occur once."""
    name = df.columns[position(df, column)]
    position(df, name)
    return name


def unique_names(names: list[str], reserved: tuple[str, ...] = ()) -> list[str]:
    """Make names distinct (also ignoring case, as Spark does) by adding ``_2``, ``_3``, ..."""
    taken = {n.lower() for n in reserved}
    result = []
    for name in names:
        candidate, n = name, 1
        while candidate.lower() in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result
