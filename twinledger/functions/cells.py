"""Cell predicates and conversions as Spark expressions.

Cells of a column share one type, so what depends on a cell's type is decided on the driver from
the schema and what depends on its value is a JVM-side expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Month tokens that mark a text as a date.
MONTH_TOKENS = ["jan", "feb", "mar", "mär", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "dez"]

# Words accepted as booleans, by option.
BOOLEAN_WORDS = {
    "allow_yn": (["y", "yes", "Y", "Yes", "YES"], ["n", "no", "N", "No", "NO"]),
    "allow_01": (["1"], ["0"]),
    "allow_tf": (["t", "true", "T", "True", "TRUE"], ["f", "false", "F", "False", "FALSE"]),
}

# What float() accepts: with plain digits and ASCII white space (which the cast skips too), and in full.
_SPACE = r"[\t-\r\x1c-\x20]*"
_SPECIAL = "(?i:inf|infinity|nan)"
_PLAIN_FLOAT = rf"^{_SPACE}[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|{_SPECIAL}){_SPACE}$"
_DIGITS = "[0-9](?:_?[0-9])*"
_ANY_FLOAT = rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|{_SPECIAL})$"

# Numbers DECIMAL(38, 18) holds exactly.
_EXACT_SHAPE = r"^[+-]?(?:[0-9]{1,20}(?:\.[0-9]{0,18})?|\.[0-9]{1,18})$"

_DATE_SHAPE = r"(?s)/.*/|\\.*\\|-.*-|\..*\.|(?iu:" + "|".join(MONTH_TOKENS) + ")"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    """Booleans count as numbers here, as they do in Python."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def strip(c: Column) -> Column:
    """Trim every kind of white space on both sides (SQL ``trim`` takes only the space)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column, dtype: T.DataType) -> Column:
    """NULL, empty text or nothing but white space."""
    return c.isNull() | (strip(c) == "") if is_text(dtype) else c.isNull()


def is_filled(c: Column, dtype: T.DataType) -> Column:
    """True for what Python calls truthy: not NULL, '', 0, 0.0 or False. Never NULL itself."""
    if is_text(dtype):
        test = c != ""
    elif isinstance(dtype, T.BooleanType):
        test = c
    elif is_number(dtype):
        test = c != F.lit(0)
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def number_from_text(c: Column) -> Column:
    """Text to DOUBLE the way ``float()`` reads it; NULL where it is no number.

    The shape is matched first: the SQL cast also takes a trailing d/f and hexadecimal literals, which
    ``float()`` does not, and it throws (and catches) an exception for every cell it cannot read.
    """
    unusual = c.contains("_") | (F.octet_length(c) > F.length(c))
    bare = strip(c)
    return F.when(c.rlike(_PLAIN_FLOAT), c.try_cast("double")).when(
        unusual & bare.rlike(_ANY_FLOAT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")
    )


def whole_number(c: Column, number: Column) -> Column:
    """BIGINT of a text whose DOUBLE is ``number``; exact also where a DOUBLE is not."""
    return F.when(F.abs(number) < 2.0**53, number.cast("bigint")).otherwise(
        F.coalesce(strip(c).try_cast("bigint"), number.try_cast("bigint"))
    )


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, for large expressions off the hot path."""
    return F.transform(F.array(c), body)[0]


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Any cell to DOUBLE, NULL where it is no number."""
    if is_text(dtype):
        return number_from_text(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if is_number(dtype):
        return c.cast("double")
    return F.lit(None).cast("double")


def safe_number(c: Column, dtype: T.DataType, default: float | None = float("nan")) -> Column:
    """DOUBLE with a default in place of what is no number."""
    return F.coalesce(as_double(c, dtype), F.lit(default).cast("double"))


def cell_type(c: Column, dtype: T.DataType) -> Column:
    """BLANK / DATE / NUMBER / TEXT by looking at the cell."""
    if is_date(dtype):
        return F.when(c.isNull(), "BLANK").otherwise("DATE")
    if is_number(dtype):
        return F.when(c.isNull(), "BLANK").otherwise("NUMBER")
    if not is_text(dtype):
        return F.when(c.isNull(), "BLANK").otherwise("TEXT")
    dated = (F.length(c) >= 6) & c.rlike("[0-9]") & c.rlike(_DATE_SHAPE)
    return (
        F.when(c.isNull() | (c == ""), "BLANK")
        .when(dated, "DATE")
        .when(number_from_text(c).isNotNull(), "NUMBER")
        .otherwise("TEXT")
    )


def as_boolean(c: Column, dtype: T.DataType, *, allow_yn: bool = True, allow_01: bool = True,
               allow_tf: bool = True) -> Column:
    """Cell to BOOLEAN through the word lists; NULL where it is neither a true nor a false word.

    Numeric 0 and 1 are always taken; the option governs the texts '0' and '1'.
    """
    if isinstance(dtype, T.BooleanType):
        return c
    if is_number(dtype):
        return F.when(c == 1, True).when(c == 0, False)
    if not is_text(dtype):
        return F.lit(None).cast("boolean")
    allowed = {"allow_yn": allow_yn, "allow_01": allow_01, "allow_tf": allow_tf}
    yes = [w for option, (words, _) in BOOLEAN_WORDS.items() if allowed[option] for w in words]
    no = [w for option, (_, words) in BOOLEAN_WORDS.items() if allowed[option] for w in words]
    if not yes:
        return F.lit(None).cast("boolean")
    return F.when(c.isin(yes), True).when(c.isin(no), False)


def in_tolerance(left: Column, right: Column, tolerance: float) -> Column:
    """True if two numbers lie within a relative band of each other; never NULL.

    Zero matches only zero, opposite signs never match, and the band is tried from both ends.
    Also usable as a join condition next to an equality.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("tolerance must be at least 0 and less than 1")
    a, b = left.cast("double"), right.cast("double")
    upper, lower = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    near = (upper * F.lit(1.0 - tolerance) <= lower) | (lower * F.lit(1.0 + tolerance) >= upper)
    return F.coalesce(
        F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), False)
        .when((a == 0) | (b == 0), a == b)
        .when((a < 0) != (b < 0), False)
        .otherwise(near),
        F.lit(False),
    )


def _render_float(c: Column) -> Column:
    """DOUBLE as Python prints it: plain decimals for 1e-4 <= |x| < 1e16, else ``1e+16``."""
    text = c.cast("double").cast("string")
    size = F.abs(c)
    plain = F.rtrim(text.cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    science = F.concat(
        F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")),
    )
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(c.isNotNull(), science)
    )


def render(c: Column, dtype: T.DataType, null_text: str | None = None) -> Column:
    """Cell as the text Python's ``str()`` gives it; NULL stays NULL unless ``null_text`` is set."""
    if is_text(dtype):
        text = c
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(dtype, T.FloatType):
        text = _render_float(c.cast("string").cast("double"))
    elif isinstance(dtype, T.DoubleType):
        text = _render_float(c)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return text if null_text is None else F.coalesce(text, F.lit(null_text))


def python_type_name(dtype: T.DataType) -> str:
    """Type label used in error details, e.g. ``<class 'int'>``."""
    if is_text(dtype):
        name = "str"
    elif isinstance(dtype, T.BooleanType):
        name = "bool"
    elif is_whole(dtype):
        name = "int"
    elif isinstance(dtype, T.DecimalType):
        name = "decimal.Decimal"
    elif is_number(dtype):
        name = "float"
    elif isinstance(dtype, T.DateType):
        name = "datetime.date"
    elif is_date(dtype):
        name = "datetime.datetime"
    else:
        name = dtype.simpleString()
    return f"<class '{name}'>"


def numeric_key(c: Column, dtype: T.DataType) -> Column:
    """Canonical key text in which '001', 1 and '1.0' are the same; other text is only trimmed.

    Goes through DECIMAL so that 20-digit keys stay exact; numbers DECIMAL cannot hold exactly use
    the DOUBLE's text.
    """
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("string")
    if is_whole(dtype):
        return c.cast("string")
    if not (is_text(dtype) or is_number(dtype)):
        return render(c, dtype)
    t = strip(c) if is_text(dtype) else c.cast("string")
    exact = F.rtrim(F.rtrim(t.try_cast("decimal(38,18)").cast("string"), F.lit("0")), F.lit("."))
    exact = F.when(exact == "-0", "0").otherwise(exact)

    def inexact(number: Column) -> Column:
        whole = F.when((F.abs(number) < 1e15) & (number == F.floor(number)), number.cast("bigint").cast("string"))
        finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
        return F.when(finite, F.coalesce(whole, _render_float(number)))

    return F.when(t.rlike(_EXACT_SHAPE), exact).otherwise(F.coalesce(let(number_from_text(t), inexact), t))
