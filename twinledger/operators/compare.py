"""Row-wise column checks with PASS / FAIL / ERROR results: pure projections, no shuffle.

All checks of a batch go into one ``select``, so the table is read once however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, dates, names

COMPARE_TYPES = ("text", "numerical", "date")
_CONVERTED = "__converted"


@dataclass(frozen=True)
class Check:
    """Options of one comparison; the defaults are those of an unattended run."""

    first_col: str | int
    second_col: str | int
    compare_type: str = "text"
    require_nonblank: bool = False
    case_sensitive: bool = True
    strip_text_fields: bool = False
    convert_dates: bool = False
    first_date_format: str | None = None
    second_date_format: str | None = None
    require_nonzero: bool = False
    conv_text_to_num: bool = False
    first_col_conv: str | None = None
    tolerance: float = 0
    pass_text: str = "PASS"
    error_text: str = "ERROR"
    fail_text: str = "FAIL"
    fail_text_blank: str = "FAIL_ALL_BLANK"
    fail_text_nonzero: str = "FAIL_ALL_ZERO"
    fail_detail: bool = False
    new_col_name: str | None = None

    @property
    def result_name(self) -> str:
        return self.new_col_name or f"COMPARE: {self.first_col} | {self.second_col}"


def _type_text(c: Column, dtype: T.DataType) -> Column:
    return F.when(c.isNull(), F.lit("<class 'NoneType'>")).otherwise(F.lit(cells.python_type_name(dtype)))


def _shown(c: Column, dtype: T.DataType) -> Column:
    return cells.render(c, dtype, "None")


def _described(c: Column, dtype: T.DataType) -> Column:
    """Cell with its type, as error details show it."""
    return F.concat(_shown(c, dtype), F.lit(" ("), _type_text(c, dtype), F.lit(")"))


def _error(check: Check, label: str, a: Column, b: Column) -> Column:
    """Error text; ``a`` and ``b`` are the described cells."""
    if not check.fail_detail:
        return F.lit(check.error_text)
    return F.concat(F.lit(f"{check.error_text}: {label} "), a, F.lit(" -> "), b)


def _change(check: Check, text: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(f"{text}: "), a, F.lit(" -> "), b) if check.fail_detail else F.lit(text)


def _text(check: Check, a: Column, atype: T.DataType, b: Column, btype: T.DataType) -> Column:
    def wrong(c, t):
        return F.lit(False) if cells.is_text(t) or isinstance(t, T.NullType) else c.isNotNull()

    def value(c, t):
        v = c if cells.is_text(t) else F.lit(None).cast("string")
        if check.strip_text_fields:
            v = cells.strip(v)
        return v if check.case_sensitive else F.lower(v)

    x, y = value(a, atype), value(b, btype)
    same = F.lit(check.pass_text)
    if check.require_nonblank:
        same = F.when(x.isNull() | (x == ""), F.lit(check.fail_text_blank)).otherwise(same)
    none = F.lit("None")
    return (
        F.when(wrong(a, atype) | wrong(b, btype), _error(check, "Non-string data:", _described(a, atype), _described(b, btype)))
        .when(x.eqNullSafe(y), same)
        .otherwise(_change(check, check.fail_text, F.coalesce(x, none), F.coalesce(y, none)))
    )


def _date(check: Check, a: Column, atype: T.DataType, b: Column, btype: T.DataType) -> Column:
    stamp = T.TimestampType()
    label = "(date compare fail)"
    if check.convert_dates:
        label = "(date compare conversion fail)"
        shown = []
        for c, t, fmt in ((a, atype, check.first_date_format), (b, btype, check.second_date_format)):
            fmt = fmt or dates.DEFAULT_FORMAT
            shown.append((c, t) if cells.is_date(t) else (dates.to_timestamp_cell(c, t, fmt), stamp))
        (a, atype), (b, btype) = shown
    x, y = (F.to_date(c) if cells.is_date(t) else F.lit(None).cast("date") for c, t in ((a, atype), (b, btype)))

    def unpadded(d: Column) -> Column:
        return F.concat_ws("-", F.year(d), F.month(d), F.day(d))

    return (
        F.when(x.isNull() | y.isNull(), _error(check, label, _described(a, atype), _described(b, btype)))
        .when(x == y, F.lit(check.pass_text))
        .otherwise(_change(check, check.fail_text, unpadded(x), unpadded(y)))
    )


def _numbers(check: Check, a: Column, atype: T.DataType, b: Column, btype: T.DataType):
    """Both cells as numbers (with their types) and the test that both are numbers."""
    out = []
    for c, t in ((a, atype), (b, btype)):
        if cells.is_number(t):
            out.append((c, t))
        elif cells.is_text(t) and check.conv_text_to_num:
            out.append((cells.number_from_text(c), T.DoubleType()))
        else:
            out.append((F.lit(None).cast("double"), T.DoubleType()))
    return out


def _numerical(check: Check, a: Column, atype: T.DataType, b: Column, btype: T.DataType,
               converted: tuple[Column, T.DataType] | None) -> Column:
    (x, xtype), (y, ytype) = _numbers(check, a, atype, b, btype)
    bad = x.isNull() | y.isNull()
    label = "(numerical compare conversion fail)" if check.conv_text_to_num else "(numerical compare fail)"

    def seen(c: Column, dtype: T.DataType, number: Column) -> Column:
        if check.conv_text_to_num and cells.is_text(dtype):  # shows the number where conversion went well
            return F.when(number.isNotNull(), _described(number, T.DoubleType())).otherwise(_described(c, dtype))
        return _described(c, dtype)

    result = F.when(bad, _error(check, label, seen(a, atype, x), seen(b, btype, y)))
    if converted is not None:
        x, xtype = converted
        failure = F.lit(check.error_text)
        if check.fail_detail:
            failure = F.lit(f"{check.error_text}: first_col_conv failure: no value")
        result = result.when(x.isNull(), failure)
    if isinstance(xtype, T.BooleanType):
        x_num = x.cast("int")
    else:
        x_num = x
    y_num = y.cast("int") if isinstance(ytype, T.BooleanType) else y
    equal = x_num == y_num
    if not (cells.is_whole(xtype) and cells.is_whole(ytype)):
        equal = equal & ~F.isnan(x_num.cast("double"))
    near = cells.in_tolerance(x_num, y_num, check.tolerance) if check.tolerance else equal
    passed = F.when(equal, F.lit(check.pass_text)).otherwise(
        _change(check, f"{check.pass_text} (WITHIN TOLERANCE)", _shown(x, xtype), _shown(y, ytype))
    )
    if check.require_nonzero:
        result = result.when(near & (x_num == 0), F.lit(check.fail_text_nonzero))
    return result.when(near, passed).otherwise(_change(check, check.fail_text, _shown(x, xtype), _shown(y, ytype)))


def _spec_errors(df: DataFrame, check: Check) -> list[str]:
    """Fixed message texts: what is wrong with a specification, shown in place of the result."""
    errors = []
    for column in (check.first_col, check.second_col):
        if isinstance(column, int) and not isinstance(column, bool):
            if not 0 <= column < len(df.columns):
                errors.append(
                    f'SPECIFICATION ERROR: column index specified ("{column}") beyond bounds of table provided.'
                )
        elif column not in df.columns:
            errors.append(f'SPECIFICATION ERROR: column name specified ("{column}") not found in table provided.')
        elif df.columns.count(column) > 1:
            errors.append(
                f'SPECIFICATION ERROR: column name specified ("{column}") is not unique in the table provided.'
            )
    if check.compare_type not in COMPARE_TYPES:
        errors.append(
            f'SPECIFICATION ERROR: compare_type (goven as "{check.compare_type}") should be either '
            '"text" or "numerical" or "date"'
        )
    return errors


@dataclass
class Checked:
    """Result of a batch of checks."""

    table: DataFrame
    checks: list[str]
    skipped: list[str] = field(default_factory=list)

    def summary(self) -> DataFrame:
        """Rows per check and outcome; the detail after the outcome text is left off."""
        outcomes = F.explode(
            F.array(*[
                F.struct(F.lit(n).alias("check"), F.substring_index(names.col(n), ": ", 1).alias("outcome"))
                for n in self.checks
            ])
        )
        return (
            self.table.select(outcomes.alias("o"))
            .groupBy("o.check", "o.outcome")
            .agg(F.count(F.lit(1)).alias("records"))
        )


# Options of a specification that say how a header was found; DataFrames have it already.
_HEADER_OPTIONS = ("header_row", "header_row_index", "column_select_mode")
_MAX_SPECS = 10_000


def _check_of(spec: Check | dict[str, Any]) -> Check:
    if isinstance(spec, Check):
        return spec
    options = {k: v for k, v in spec.items() if k not in _HEADER_OPTIONS}
    if spec.get("column_select_mode") == "index":
        options |= {k: int(options[k]) for k in ("first_col", "second_col")}
    return Check(**options)


def specs_from_table(table: DataFrame, **common: Any) -> list[dict[str, Any]]:
    """Specifications from a small table, one per row; empty cells are left to ``common`` or the defaults."""
    rows = table.limit(_MAX_SPECS + 1).collect()
    if len(rows) > _MAX_SPECS:
        raise ValueError(f"more than {_MAX_SPECS} specifications")
    return [{**common, **{k: v for k, v in r.asDict().items() if v is not None and v != ""}} for r in rows]


def compare_many(df: DataFrame, specs: list[Check | dict[str, Any]], on_error: str = "skip") -> Checked:
    """Add one result column per specification, all in one pass.

    A specification that names a missing or repeated column or an unknown type fills its column
    with the message. One that is malformed (unknown option, tolerance out of range, a bad
    expression) is skipped with a message or raised, as ``on_error`` says.
    """
    if on_error not in ("skip", "raise"):
        raise ValueError("on_error must be 'skip' or 'raise'")
    skipped: list[str] = []
    checks: list[Check] = []
    for spec in specs:
        try:
            check = _check_of(spec)
            if not 0 <= check.tolerance < 1:
                raise ValueError("tolerance must be at least 0 and less than 1")
            checks.append(check)
        except (TypeError, ValueError) as exc:
            if on_error == "raise":
                raise
            skipped.append(f"{spec}: {exc}")

    # first_col_conv is SQL over {x}; the number it reads becomes a column for one projection.
    # Columns go by position inside, so repeated names do no harm.
    staged: dict[int, str] = {}
    plain = [f"c{i}" for i in range(len(df.columns))]
    types = [f.dataType for f in df.schema.fields]
    wide = df.toDF(*plain)
    for n, check in enumerate(checks):
        if check.compare_type == "numerical" and check.first_col_conv and not _spec_errors(df, check):
            first = names.position(df, check.first_col)
            source_col, dtype = F.col(plain[first]), types[first]
            (x, _), _ = _numbers(check, source_col, dtype, source_col, dtype)
            try:
                source = wide.withColumn(f"{_CONVERTED}_in_{n}", x)
                expression = str(check.first_col_conv).format(x=f"`{_CONVERTED}_in_{n}`")
                wide = source.withColumn(f"{_CONVERTED}_{n}", F.expr(expression)).drop(f"{_CONVERTED}_in_{n}")
                staged[n] = f"{_CONVERTED}_{n}"
            except Exception as exc:
                if on_error == "raise":
                    raise
                skipped.append(f"{check.result_name}: {exc}")
                staged[n] = ""
    results, added = [], []
    reserved = tuple(df.columns)
    for n, check in enumerate(checks):
        if staged.get(n) == "":
            continue
        errors = _spec_errors(df, check)
        if errors:
            value = F.lit("\n".join(errors))
        else:
            first, second = names.position(df, check.first_col), names.position(df, check.second_col)
            a, b, atype, btype = F.col(plain[first]), F.col(plain[second]), types[first], types[second]
            if check.compare_type == "text":
                value = _text(check, a, atype, b, btype)
            elif check.compare_type == "date":
                value = _date(check, a, atype, b, btype)
            else:
                converted = (F.col(staged[n]), wide.schema[staged[n]].dataType) if n in staged else None
                value = _numerical(check, a, atype, b, btype, converted)
        name = names.unique_names([check.result_name], reserved + tuple(added))[0]
        added.append(name)
        results.append(value)
    checked = [value.alias(f"r{i}") for i, value in enumerate(results)]
    return Checked(wide.select(*plain, *checked).toDF(*df.columns, *added), added, skipped)


def compare_columns(df: DataFrame, first_col: str | int, second_col: str | int, compare_type: str = "text",
                    **options: Any) -> DataFrame:
    """Compare two columns row by row and add a column with the outcome."""
    spec = Check(first_col, second_col, compare_type, **options)
    return compare_many(df, [spec], on_error="raise").table


# Words for boolean constants, and the marker of a constant.
_CONST = "**CONST"
_TRUE_WORDS = ("true", "y", "yes", "t", "1")
_FALSE_WORDS = ("false", "n", "no", "f", "0")


def parse_constants(specs: list[dict[str, Any]]) -> dict[str, Any]:
    """Values of all ``**CONST <type> <value>`` entries in ``first_col``, by the whole entry."""
    found: dict[str, Any] = {}
    for spec in specs:
        if "first_col" not in spec:
            raise ValueError('specifications need a "first_col"')
        entry = spec["first_col"]
        if not isinstance(entry, str) or not entry.startswith(_CONST):
            continue
        parts = entry.split(None, 2)
        if len(parts) < 3:
            raise ValueError(f'constant must be "{_CONST} <type> <value>", not {entry!r}')
        kind, text = parts[1], parts[2]
        word = text.split()[0]
        if kind == "str":
            found[entry] = text
        elif kind == "bool" and word.lower() in _TRUE_WORDS:
            found[entry] = True
        elif kind == "bool" and word.lower() in _FALSE_WORDS:
            found[entry] = False
        elif kind == "int":
            found[entry] = int(word)
        elif kind == "float":
            found[entry] = float(word)
        else:
            raise ValueError(f"constant type or value not recognized: {entry!r}")
    return found


def with_constants(df: DataFrame, specs: list[dict[str, Any]]) -> DataFrame:
    """Add a column for each constant the specifications use, named like the entry."""
    constants = parse_constants(specs)
    return df.withColumns({name: F.lit(value) for name, value in constants.items()}) if constants else df
