"""strptime formats and spreadsheet serial dates as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import is_date, is_number, is_text, strip

DEFAULT_FORMAT = "%Y-%m-%d %H:%M:%S.%f"

# Strptime directives and the pattern letters that mean the same. The first form
# accepts one or two digits, the second is for digits that touch a neighbouring directive.
_LENIENT = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS",
            "b": "MMM", "B": "MMMM", "p": "a", "j": "D", "z": "xx"}
_FIXED = {"m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD"}

# Serial day numbers that fall in the years 1 to 9999, counted from 1899-12-30.
_SERIAL_MIN, _SERIAL_MAX = -693593, 2958465


def _pattern(date_format: str, padded: bool) -> str:
    parts: list[tuple[str, str]] = []
    i = 0
    while i < len(date_format):
        ch = date_format[i]
        if ch == "%" and i + 1 < len(date_format):
            code = date_format[i + 1]
            if code == "%":
                parts.append(("text", "%"))
            elif code in _LENIENT:
                parts.append(("code", code))
            else:
                raise ValueError(f"date format directive %{code} is not supported")
            i += 2
        else:
            parts.append(("text", ch))
            i += 1
    out = []
    for n, (kind, value) in enumerate(parts):
        if kind == "text":
            out.append("''" if value == "'" else f"'{value}'" if value.isalpha() or value in "[]{}#" else value)
            continue
        touching = any(0 <= m < len(parts) and parts[m][0] == "code" and parts[m][1] not in "bBp" for m in (n - 1, n + 1))
        out.append(_FIXED[value] if value in _FIXED and (padded or touching) else _LENIENT[value])
    return "".join(out)


def parse_pattern(date_format: str) -> str:
    """Datetime pattern that reads what ``strptime`` reads with this format."""
    return _pattern(date_format, padded=False)


def write_pattern(date_format: str) -> str:
    """Datetime pattern that writes what ``strftime`` writes with this format."""
    return _pattern(date_format, padded=True)


# What each directive looks like in text.
_SHAPES = {"Y": "[0-9]{4}", "y": "[0-9]{2}", "f": "[0-9]{1,6}", "b": r"\p{L}+\.?", "B": r"\p{L}+", "p": "(?i:am|pm)",
           "j": "[0-9]{1,3}", "z": "[+-][0-9:]+|Z"}


def text_shape(date_format: str) -> str:
    """Regular expression every text of this format matches.

    Parsing a text that is no date costs an exception, so texts are matched first.
    """
    out, i = [], 0
    while i < len(date_format):
        ch = date_format[i]
        if ch == "%" and i + 1 < len(date_format):
            code = date_format[i + 1]
            out.append("%" if code == "%" else f"(?:{_SHAPES.get(code, '[0-9]{1,2}')})")
            i += 2
        else:
            out.append(ch if ch.isalnum() or ch == " " else "\\" + ch)
            i += 1
    return "(?i)^" + "".join(out) + "$"


def parse_timestamp(c: Column, date_format: str = DEFAULT_FORMAT) -> Column:
    """Text to TIMESTAMP by a strptime format; NULL where it does not fit."""
    shaped = F.when(c.rlike(text_shape(date_format)), c)
    parsed = F.try_to_timestamp(shaped, F.lit(parse_pattern(date_format)))
    if "%y" in date_format:  # two-digit years from 69 on belong to the 1900s
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("INTERVAL 100 YEARS")).otherwise(parsed)
    return parsed


def serial_date(c: Column, dtype: T.DataType) -> Column:
    """Spreadsheet day number (44927 -> 2023-01-01) to DATE; NULL where it is no whole number."""
    if is_text(dtype):
        bare = strip(c)
        days = F.when(bare.rlike("^[+-]?[0-9]{1,9}$"), bare.try_cast("int"))
    elif is_number(dtype):
        days = F.when(c.cast("double") == F.floor(c.cast("double")), c.try_cast("int"))
    else:
        return F.lit(None).cast("date")
    days = F.when(days.between(_SERIAL_MIN, _SERIAL_MAX), days)
    return F.date_add(F.lit("1899-12-30").cast("date"), days)


def to_date_cell(c: Column, dtype: T.DataType, date_format: str | None) -> Column:
    """Date, formatted text or spreadsheet serial to DATE; NULL where none of them fits."""
    if is_date(dtype):
        return F.to_date(c)
    serial = serial_date(c, dtype)
    if is_text(dtype) and date_format:
        return F.coalesce(F.to_date(parse_timestamp(strip(c), date_format)), serial)
    return serial


def to_timestamp_cell(c: Column, dtype: T.DataType, date_format: str | None) -> Column:
    """Like :func:`to_date_cell`, keeping the time of day."""
    if is_date(dtype):
        return c.cast("timestamp")
    serial = serial_date(c, dtype).cast("timestamp")
    if is_text(dtype) and date_format:
        return F.coalesce(parse_timestamp(strip(c), date_format), serial)
    return serial
