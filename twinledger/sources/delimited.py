"""Delimited and plain text files: read, write, sniff the delimiter, convert column types."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, dates, names
from .records import Dialect, line_table, quoted_records

QUOTING = ("QUOTE_MINIMAL", "QUOTE_ALL", "QUOTE_NONNUMERIC", "QUOTE_NONE")

# Candidate delimiters, lines looked at, and the share of lines that must agree.
SNIFF_DELIMITERS = ",;\t|"
_SNIFF_LINES, _SNIFF_SHARE = 20, 0.9

# Codec names Python accepts for the charsets Spark reads.
_CHARSETS = {"utf_8": "UTF-8", "utf8": "UTF-8", "utf-8": "UTF-8", "utf_8_sig": "UTF-8", "utf-8-sig": "UTF-8",
             "utf_16": "UTF-16", "utf-16": "UTF-16", "utf_32": "UTF-32", "utf-32": "UTF-32",
             "latin_1": "ISO-8859-1", "latin-1": "ISO-8859-1", "iso8859_1": "ISO-8859-1",
             "iso-8859-1": "ISO-8859-1", "ascii": "US-ASCII", "us-ascii": "US-ASCII"}


def charset(encoding: str) -> str:
    return _CHARSETS.get(encoding.lower(), encoding)


def _check_quoting(quoting: str) -> None:
    if quoting not in QUOTING:
        raise ValueError(f"quoting must be one of {QUOTING}, not {quoting!r}")


def has_embedded_newlines(spark: SparkSession, path: str, quote_mark: str = '"', encoding: str = "utf_8",
                          delim: str = ",") -> bool:
    """True if some quoted cell contains a line break, which one splittable scan of the lines tells.

    The first line of such a record ends inside a cell; quote marks in the middle of a cell are ordinary.
    """
    lines = spark.read.option("encoding", charset(encoding)).text(path)
    return not lines.where(Dialect(delim, quote_mark).ends_inside(F.col("value"))).limit(1).isEmpty()


def _records(spark: SparkSession, path: str, dialect: Dialect, encoding: str, line_terminator: str | None,
             skip: int, embedded: bool) -> DataFrame:
    """``value, file, block, id`` of every record, without the first ``skip`` lines of each file."""
    lines = line_table(spark, path, charset(encoding), line_terminator)
    if skip:
        lines = _placed(lines).where(F.col("place").isNull() | (F.col("place") >= skip)).drop("place")
    return quoted_records(lines, dialect) if embedded else lines


def _placed(lines: DataFrame) -> DataFrame:
    """``place`` of each line of the first block of a file, from 0; null elsewhere."""
    first = lines.where("block = 0").groupBy(F.col("file").alias("of_file")).agg(F.min("id").alias("first_id"))  # a row per file
    placed = lines.join(first, F.col("file") == F.col("of_file"), "left")
    return placed.select(*lines.columns, F.when(F.col("block") == 0, F.col("id") - F.col("first_id")).alias("place"))


@dataclass(frozen=True)
class _Layout:
    """Files with one header: its cells, the widest row, and how many files there are."""

    header: str | None
    width: int
    files: int


def _layouts(records: DataFrame, dialect: Dialect, header: bool) -> list[_Layout]:
    """Distinct headers (the first record of each file that is not blank), one aggregate over all records."""
    filled = records.where(F.length("value") > 0)
    width = F.max(dialect.cells(F.col("value"))).alias("width")
    if not header:
        widest = filled.agg(width).first()["width"]
        return [_Layout(None, widest, 0)] if widest else []
    by_file = filled.groupBy("file").agg(F.min_by("value", F.struct("block", "id")).alias("header"), width)
    found = by_file.groupBy("header").agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("files"), F.min("file").alias("first"))
    return [_Layout(r["header"], r["width"], r["files"]) for r in found.orderBy("first").collect()]


def _parsed(value: Column, width: int, options: dict) -> Column:
    fields = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(value, fields, {**options, "maxColumns": str(max(20480, width + 1)), "mode": "PERMISSIVE"})


def _titles(spark: SparkSession, layout: _Layout, dialect: Dialect, options: dict, by_place: bool) -> list[str]:
    """Names of all columns, also of those that only some row has."""
    row = spark.createDataFrame([(layout.header or "",)], "value string")
    cells_of = row.select(_parsed(F.col("value"), layout.width, options).alias("r"), dialect.cells(F.col("value")).alias("n")).first()
    values = list(cells_of["r"])[: cells_of["n"]] if layout.header is not None and not by_place else []
    values += [None] * (layout.width - len(values))
    return names.unique_names([v or f"_c{i}" for i, v in enumerate(values)])


def read_cells(spark: SparkSession, path: str, *, delim: str = ",", quote_mark: str = '"', encoding: str = "utf_8",
               line_terminator: str | None = None, quoting: str = "QUOTE_MINIMAL", header_row_index: int = 0,
               embedded_newlines: bool | str = "auto") -> DataFrame:
    """``file, cells`` of every record of delimited files: all its cells as they are, however many.

    Headers are rows like any other. :func:`~twinledger.operators.columns.square_rows` gives them one width.
    """
    _check_quoting(quoting)
    dialect = Dialect(delim, "" if quoting == "QUOTE_NONE" else quote_mark)
    if embedded_newlines == "auto":
        embedded_newlines = bool(dialect.quote) and has_embedded_newlines(spark, path, quote_mark, encoding, delim)
    records = _records(spark, path, dialect, encoding, line_terminator, header_row_index, embedded_newlines)
    records = records.where(F.length("value") > 0)
    widest = records.agg(F.max(dialect.cells(F.col("value")))).first()[0] or 1
    parsed = records.select("file", _parsed(F.col("value"), widest, _options(dialect)).alias("r"), dialect.cells(F.col("value")).alias("n"))
    cell = [F.coalesce(F.col("r").getField(f"c{i}"), F.lit("")) for i in range(widest)]
    return parsed.select("file", F.slice(F.array(*cell), F.lit(1), F.col("n")).alias("cells"))


def _options(dialect: Dialect) -> dict:
    return {"sep": dialect.delim, "quote": dialect.quote, "escape": dialect.quote or "\\", "nullValue": "\u0000", "emptyValue": "",
            "enforceSchema": "true"}


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    delim: str = ",",
    quote_mark: str = '"',
    encoding: str = "utf_8",
    line_terminator: str | None = None,
    quoting: str = "QUOTE_MINIMAL",
    header: bool = True,
    header_row_index: int = 0,
    convert_numbers: bool = False,
    convert_dates: bool = False,
    date_format: str = dates.DEFAULT_FORMAT,
    embedded_newlines: bool | str = "auto",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read delimited files as text columns.

    Each file has a header of its own: files are told apart by it and put one below the other by column name.
    A row longer than its header keeps its further cells in columns ``_c<place>``; a shorter one has empty
    text there, as have all rows of files without a column. Repeated header names get ``_2``, ``_3``, ...
    ``header_row_index`` skips that many leading lines of each file. Line breaks inside quotes are found in
    parallel (:mod:`~twinledger.sources.records`); whether there are any is looked up first
    (``embedded_newlines='auto'``), pass True or False if known. With a ``schema`` the files are read as it says,
    by place, with no look at them before.
    """
    _check_quoting(quoting)
    if delim == "auto":
        sniffed = sniff_delimiter(spark, path, encoding)
        if sniffed is None:
            raise ValueError(f"no delimiter recognized in {path}")
        delim = sniffed[0]
    dialect = Dialect(delim, "" if quoting == "QUOTE_NONE" else quote_mark)
    if embedded_newlines == "auto":
        embedded_newlines = bool(dialect.quote) and has_embedded_newlines(spark, path, quote_mark, encoding, delim)
    options = _options(dialect)
    reader = spark.read.options(**options).option("encoding", charset(encoding))
    if line_terminator:
        reader = reader.option("lineSep", line_terminator)
    if schema is not None:
        df = reader.option("multiLine", embedded_newlines).schema(schema).option("header", header).csv(path)
    else:
        records = _records(spark, path, dialect, encoding, line_terminator, header_row_index, embedded_newlines)
        layouts = _layouts(records, dialect, header)
        if not layouts:
            if header_row_index:
                raise ValueError(f"table has insufficient content (header row {header_row_index})")
            return spark.createDataFrame([], T.StructType([]))
        titles = [_titles(spark, layout, dialect, options, not header) for layout in layouts]
        if len(layouts) == 1 and not header_row_index and not embedded_newlines:
            text = T.StructType([T.StructField(t, T.StringType()) for t in titles[0]])
            df = reader.option("maxColumns", max(20480, len(titles[0]) + 1)).schema(text).option("header", header).csv(path)
        else:
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _by_layout(records, layouts, titles, options, header))
        # A cell without content is empty text, also where a line ends early.
        df = df.select(*[F.coalesce(names.col(c), F.lit("")).alias(c) for c in df.columns])
    if quoting == "QUOTE_NONNUMERIC" or convert_numbers or convert_dates:
        df = convert_types(df, convert_numbers or quoting == "QUOTE_NONNUMERIC", convert_dates, date_format)
    return df


def _by_layout(records: DataFrame, layouts: list[_Layout], titles: list[list[str]], options: dict, header: bool) -> list[DataFrame]:
    """The rows of the files with each header."""
    rows = records.where(F.length("value") > 0)
    if header:
        # The header is the first record of its file. A row per file tells where that is and what it says.
        first = rows.groupBy(F.col("file").alias("of_file")).agg(
            F.min(F.struct("block", "id")).alias("at"), F.min_by("value", F.struct("block", "id")).alias("of_header"))
        rows = rows.join(first, F.col("file") == F.col("of_file")).where(F.struct("block", "id") > F.col("at"))
    tables = []
    for layout, names_of in zip(layouts, titles):
        own = rows.where(F.col("of_header") == layout.header) if header and len(layouts) > 1 else rows
        parsed = own.select(_parsed(F.col("value"), layout.width, options).alias("r"))
        tables.append(parsed.select(*[F.col("r").getField(f"c{i}").alias(t) for i, t in enumerate(names_of)]))
    return tables


_SHORT_WHOLE = "^-?[0-9]{1,15}$"  # of these, text, DOUBLE and BIGINT are the same number


def convert_types(df: DataFrame, convert_numbers: bool = True, convert_dates: bool = False,
                  date_format: str = dates.DEFAULT_FORMAT, columns: list[str] | None = None) -> DataFrame:
    """Give text columns a type if every filled cell has it: BIGINT, DOUBLE, TIMESTAMP, else text.

    One aggregate pass looks at all columns together. Blank cells become NULL in converted columns.
    """
    chosen = columns or [f.name for f in df.schema.fields if cells.is_text(f.dataType)]
    if not chosen:
        return df
    # One row per cell for the test: its code stays small, so the JVM compiles it however wide the table is.
    cell = df.select(F.posexplode(F.array(*[names.col(c) for c in chosen])).alias("i", "c"))
    number = cells.number_from_text(F.col("c")) if convert_numbers else F.lit(None).cast("double")
    # Most whole numbers are short and plain: their shape says so, and neither the long pattern nor a cast is needed.
    short = F.col("c").rlike(_SHORT_WHOLE) if convert_numbers else F.lit(False)
    read = cell.select("i", "c", F.when(short, F.lit(0.0)).otherwise(number).alias("n"))
    c, n = F.col("c"), F.col("n")
    dated = F.when(n.isNull(), dates.parse_timestamp(c, date_format).isNotNull()).otherwise(False)
    judged = read.select(
        "i",
        "n",
        F.when(n.isNotNull(), False).otherwise(cells.is_blank(c, T.StringType())).alias("blank"),
        (dated if convert_dates else F.lit(False)).alias("d"),
    )
    whole = F.coalesce((n == F.floor(n)) & (F.abs(n) < 2.0**63), F.lit(False))
    counted = judged.where(~F.col("blank")).groupBy("i").agg(
        F.count_if(n.isNull()).alias("text"), F.count_if(~whole).alias("broken"), F.count_if(~F.col("d")).alias("undated")
    )
    seen = {r["i"]: r for r in counted.collect()}
    changes = {}
    for i, name in enumerate(chosen):
        c = names.col(name)
        if i not in seen:
            continue
        if convert_numbers and not seen[i]["text"]:
            number = cells.number_from_text(c)
            if not seen[i]["broken"]:
                changes[name] = F.when(c.rlike(_SHORT_WHOLE), c.cast("bigint")).otherwise(cells.whole_number(c, number))
            else:
                changes[name] = number
        elif convert_dates and not seen[i]["undated"]:
            changes[name] = dates.parse_timestamp(c, date_format)
    return df.select(*[changes[c].alias(c) if c in changes else names.col(c) for c in df.columns])


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "utf_8") -> tuple[str, int] | None:
    """Delimiter and column count of delimited text, or None for anything else.

    Looks at the first 20 non-blank lines: at least 90 % of them must have the same number (2 or
    more) of fields, quoted delimiters not counted. Binary content is refused.
    """
    lines = (
        spark.read.option("encoding", charset(encoding)).text(path).where(F.trim("value") != "").limit(_SNIFF_LINES)
    )
    sample = [r["value"] for r in lines.collect()]
    return sniff_lines(sample)


def sniff_lines(sample: list[str]) -> tuple[str, int] | None:
    """:func:`sniff_delimiter` on lines at hand."""
    if len(sample) < 2 or any("\x00" in line for line in sample):
        return None
    best: tuple[float, int, str] | None = None
    for delim in SNIFF_DELIMITERS:
        outside_quotes = re.compile(r'"(?:[^"]|"")*"')
        widths = Counter(outside_quotes.sub("", line).count(delim) + 1 for line in sample)
        width, lines = widths.most_common(1)[0]
        share = lines / len(sample)
        if width >= 2 and share >= _SNIFF_SHARE and (best is None or (share, width) > best[:2]):
            best = (share, width, delim)
    return (best[2], best[1]) if best else None


def read_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """One row per line of text files."""
    return spark.read.option("encoding", charset(encoding)).text(path)


def _formatted(df: DataFrame, date_format: str | None, null_text: str | None) -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = names.col(f.name)
        if date_format and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            text = F.date_format(c, dates.write_pattern(date_format))
        else:
            text = cells.render(c, f.dataType)
        out.append(text if null_text is None else F.coalesce(text, F.lit(null_text)))
    return out


def write_csv(
    df: DataFrame,
    path: str,
    *,
    delim: str = ",",
    quote_mark: str = '"',
    encoding: str = "utf_8",
    line_terminator: str = "\n",
    quoting: str = "QUOTE_MINIMAL",
    header: bool = True,
    convert_dates: bool = False,
    date_format: str = dates.DEFAULT_FORMAT,
    mode: str = "errorifexists",
) -> None:
    """Write a directory of delimited files, one per partition, each with the header."""
    _check_quoting(quoting)
    texts = _formatted(df, date_format if convert_dates else None, None)
    if quoting in ("QUOTE_NONNUMERIC", "QUOTE_NONE"):
        # Spark quotes either all cells or those that need it, so these two are composed here.
        blank_filled = [F.coalesce(c, F.lit("")) for c in texts]
        mark = quote_mark
        if quoting == "QUOTE_NONNUMERIC":

            def quoted(c: Column) -> Column:
                return F.concat(F.lit(mark), F.replace(c, F.lit(mark), F.lit(mark * 2)), F.lit(mark))

            out = [c if cells.is_number(f.dataType) else quoted(c) for c, f in zip(blank_filled, df.schema.fields)]
            titles = [mark + n.replace(mark, mark * 2) + mark for n in df.columns]
        else:
            special = [delim, mark, "\r", "\n"]
            error = F.raise_error(F.lit("a cell needs quoting, but quoting is off"))
            out = [
                F.when(reduce(or_, [c.contains(ch) for ch in special]), error.cast("string")).otherwise(c)
                for c in blank_filled
            ]
            titles = list(df.columns)
        _write_lines(df, out, titles if header else None, path, delim, line_terminator, encoding, mode)
        return
    df.select(*[c.alias(n) for c, n in zip(texts, df.columns)]).write.mode(mode).options(
        sep=delim, quote=quote_mark, escape=quote_mark, header=header, lineSep=line_terminator,
        encoding=charset(encoding), nullValue="", emptyValue="", quoteAll=quoting == "QUOTE_ALL",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def _write_lines(df: DataFrame, texts: list[Column], titles: list[str] | None, path: str, delim: str,
                 line_terminator: str, encoding: str, mode: str) -> None:
    """Write rows as joined lines; the first row of each partition brings the header with it."""
    if charset(encoding) != "UTF-8":
        raise ValueError("lines without quoting rules can only be written as UTF-8")
    line = F.concat_ws(delim, *texts)
    if titles is not None:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        line = F.when(first, F.concat(F.lit(delim.join(titles) + line_terminator), line)).otherwise(line)
    df.select(line.alias("value")).write.mode(mode).option("lineSep", line_terminator).text(path)


def write_text(df: DataFrame, path: str, *, encoding: str = "utf-8", header: bool = True,
               mode: str = "errorifexists") -> None:
    """Write tab-delimited text without quoting; NULL appears as ``None``."""
    _write_lines(df, _formatted(df, None, "None"), list(df.columns) if header else None, path, "\t", "\n", encoding, mode)
