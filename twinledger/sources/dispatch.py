"""Read and write by file extension, and named sets of tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import Flattened
from . import delimited, xml

READ_FORMATS = ("csv", "txt", "xml", "xml_archive", "parquet", "json", "orc")
WRITE_FORMATS = ("csv", "txt", "parquet", "json", "orc")
ALL_TABLES = "**ALL TABLES**"
_SHORT_NAME = 31  # longest name that stays unchanged in a workbook

_INDEX = "table_index"


def detect_format(path: str) -> str:
    """Format by extension; the double suffix of compressed archives counts as one."""
    lowered = path.rstrip("/").lower()
    if lowered.endswith((".tar.gz", ".tgz")):
        return "xml_archive"
    name = lowered.rpartition("/")[2]
    return name.rpartition(".")[2] if "." in name else ""


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a table by its extension, or as ``fmt`` says.

    Text that looks delimited is read as delimited; an unknown extension must look so, else it is an
    error and ``fmt`` is needed. What flattening leaves out is told by :mod:`warnings`; :func:`read_flattened`
    gives the same table with all that is known about it.
    """
    detected = detect_format(path)
    fmt = fmt or detected
    if fmt in ("tsv", "dat", "") or fmt not in READ_FORMATS or (fmt == "txt" and fmt == detected and "delim" not in options):
        sniffed = delimited.sniff_delimiter(spark, path, options.get("encoding", "utf_8"))
        if sniffed:
            return delimited.read_csv(spark, path, **{"delim": sniffed[0], **options})
        if fmt != "txt":
            raise ValueError(f"cannot tell the format of {path}; pass fmt as one of {READ_FORMATS}")
    if fmt == "csv":
        return delimited.read_csv(spark, path, **options)
    if fmt == "txt":
        return delimited.read_text(spark, path, **options)
    if fmt in ("xml", "xml_archive"):
        found = read_flattened(spark, path, fmt, **options)
        for message in found.warnings:
            warnings.warn(f"{path}: {message}", stacklevel=2)
        return found.table
    return spark.read.options(**options).format(fmt).load(path)


def read_flattened(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Flattened:
    """XML files or archives with warnings, paths and, once the table has been run, the metadata of that run."""
    read = xml.read_xml_archive if (fmt or detect_format(path)) == "xml_archive" else xml.read_xml
    return read(spark, path, **options)


def write_table(df: DataFrame, path: str, fmt: str | None = None, *, mode: str = "errorifexists", **options) -> str:
    """Write a table by the extension of ``path`` (added if missing); returns the path written."""
    detected = detect_format(path)
    fmt = fmt or detected
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"cannot write format {fmt!r}; pass fmt as one of {WRITE_FORMATS}")
    if not path.lower().endswith("." + fmt):
        path = f"{path}.{fmt}"
    if not df.columns:
        raise ValueError("a table without columns cannot be written")
    if fmt == "csv":
        delimited.write_csv(df, path, mode=mode, **options)
    elif fmt == "txt":
        delimited.write_text(df, path, mode=mode, **options)
    else:
        df.write.mode(mode).options(**options).format(fmt).save(path)
    return path


def check_table_names(tables: dict[str, DataFrame], short: bool = False) -> None:
    """Names must be there, be usable as folder names, and (``short``) stay distinct when cut to 31 characters."""
    if not tables:
        raise ValueError("no tables given")
    for name in tables:
        if not isinstance(name, str) or not name.strip() or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"unusable table name {name!r}")
    if len({n.lower() for n in tables}) < len(tables):
        raise ValueError("table names must differ in more than case")
    if short and len({n[:_SHORT_NAME] for n in tables}) < len(tables):
        raise ValueError(f"table names are not unique when cut to {_SHORT_NAME} characters")


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", *, mode: str = "errorifexists",
                 short_names: bool = False, **options) -> None:
    """Write a named set of tables, one sub-folder each, and a small index of their names."""
    check_table_names(tables, short_names)
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.{fmt}", fmt, mode=mode, **options)
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, name, fmt) for n, name in enumerate(tables)]
    index = spark.createDataFrame(rows, "position int, name string, format string")
    index.coalesce(1).write.mode(mode).json(f"{folder}/{_INDEX}")


def read_tables(spark: SparkSession, folder: str, names: str | list[str] | None = None, **options) -> dict[str, DataFrame]:
    """Read all (default, or :data:`ALL_TABLES`) or some tables of a set written by :func:`write_tables`."""
    index = spark.read.schema("position int, name string, format string").json(f"{folder}/{_INDEX}")
    known = {r["name"]: r["format"] for r in index.orderBy(F.col("position")).collect()}
    if names is None or names == ALL_TABLES:
        wanted = list(known)
    else:
        wanted = [names] if isinstance(names, str) else list(names)
    missing = [n for n in wanted if n not in known]
    if missing:
        raise KeyError(f"tables {missing} are not in {folder}; it has {list(known)}")
    return {n: read_table(spark, f"{folder}/{n}.{known[n]}", known[n], **options) for n in wanted}
