"""XML files and XML members of tar archives as flat tables."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..operators import flatten as X
from .outline import Outline, outline_of

NAMESPACE_MODES = ("strip", "prefix", "keep")

# What a malformed record does, and the reader mode for it.
_MALFORMED = {"raise": "FAILFAST", "recover": "PERMISSIVE", "skip": "DROPMALFORMED"}
_CORRUPT = "_corrupt_record"
_GLOB = "*.[xX][mM][lL]"


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def record_paths(outline: Outline, record_path: str | None, separator: str = ".") -> list[tuple[str, ...]]:
    """All element paths (from the root down) that a record path means; those of the roots if nothing repeats.

    A record path is the end of an element path in local names; it may begin with the root's name.
    """
    if record_path is None:
        tag = outline.record_tag()
        return [p for p in outline.counts if len(p) > 1 and p[-1] == tag] or [(r,) for r in outline.roots]
    segments = [s for s in record_path.split(separator) if s]
    found = []
    for p in outline.counts:
        wanted = segments[1:] if segments and segments[0] == _local(p[0]) else segments
        below = [_local(n) for n in p[1:]]
        if (not wanted and len(p) == 1) or (wanted and len(below) >= len(wanted) and below[-len(wanted):] == wanted):
            found.append(p)
    if not found:
        raise ValueError(f"no element lies at record_path {record_path!r}")
    return found


def split_units(outline: Outline, records: list[tuple[str, ...]], ancestors: bool = True) -> dict[str, list[tuple[str, ...]]]:
    """At which elements files are split to read some records: tag, and the paths of records from there down.

    That is the record itself or, where ancestors give context, the topmost one below the root that has attributes
    or text. The reader finds every element of a tag that is in no other one of that tag. If that would find
    elements that are no records, or one record twice, the units move up; at the root they always suit.
    """
    def content_at(p):
        return next((i for i in range(1, len(p) - 1) if ancestors and outline.has_content(p[: i + 1])), len(p) - 1)

    level = {p: content_at(p) for p in records}
    while True:
        # The outermost element of a tag is what the reader finds.
        level = {p: p.index(p[i]) for p, i in level.items()}
        found: dict[tuple[str, tuple[str, ...]], set[tuple[str, ...]]] = {}
        for p, i in level.items():
            for q in outline.counts:
                if p[i] in q:
                    j = q.index(p[i])
                    if q[j:] == p[i:]:
                        found.setdefault((p[i], p[i:]), set()).add(q)
        wrong = {
            p for p, i in level.items() for q in found[p[i], p[i:]]
            if level.get(q) is None or q[level[q]] != p[i] or (ancestors and q.index(p[i]) > content_at(q))
            or (i > 0 and p[i] in outline.roots)
        }
        # Where a reader at the root meets a record that another one has, that one comes up too.
        wrong |= {q for p in wrong if not level[p] for q in found[p[0], p] if q in level}
        if not wrong:
            break
        if all(level[p] == 0 for p in wrong):
            raise ValueError("a root of one file is an element of another, with records in both: read these files apart")
        level = {p: max(i - 1, 0) if p in wrong else i for p, i in level.items()}
    units: dict[str, list[tuple[str, ...]]] = {}
    for p, i in level.items():
        if p[i + 1:] not in units.setdefault(p[i], []):
            units[p[i]].append(p[i + 1:])
    return units


def _reader_options(options: X.FlattenOptions, namespace_mode: str, on_malformed: str, row_tag: str) -> dict:
    if namespace_mode not in NAMESPACE_MODES:
        raise ValueError(f"namespace_mode must be one of {NAMESPACE_MODES}")
    if on_malformed not in _MALFORMED:
        raise ValueError(f"on_malformed must be one of {list(_MALFORMED)}")
    return {
        "rowTag": _local(row_tag) if namespace_mode == "strip" else row_tag,
        "attributePrefix": options.attribute_prefix,
        "valueTag": options.text_key,
        "inferSchema": "false",
        "mode": _MALFORMED[on_malformed],
        "columnNameOfCorruptRecord": _CORRUPT,
        "ignoreNamespace": str(namespace_mode == "strip").lower(),
        "excludeAttribute": str(not options.include_attributes).lower(),
        "ignoreSurroundingSpaces": "true",
    }


def _with_names(options: X.FlattenOptions, namespace_mode: str, namespaces: dict[str, str]) -> X.FlattenOptions:
    from dataclasses import replace

    if namespace_mode != "keep":
        return options
    return replace(options, rename={prefix: "{" + uri + "}" for prefix, uri in namespaces.items() if prefix})


def _hint(outline: Outline, records: list[tuple[str, ...]], options: X.FlattenOptions) -> tuple[str, ...]:
    """Column paths in the order in which documents show them."""
    def shown(name: str) -> str:
        prefix, _, local = name.rpartition(":")
        return options.rename[prefix] + local if prefix in options.rename else name

    seen: dict[str, None] = {}
    for path, attribute in outline.columns():
        for record in records:
            if path[: len(record)] == record:
                parts = [*map(shown, path[len(record):]), *([options.attribute_prefix + shown(attribute)] if attribute else [])]
                if parts:
                    seen.setdefault(options.path_separator.join(parts))
                seen.setdefault(options.path_separator.join([*parts, options.text_key]))
    context = {p[i] for p in records for i in range(1, len(p) - 1) if p[: i + 1] in outline.with_text}
    return (*sorted(context), *(c for c in seen if c not in context))


def _without_declarations(schema: T.StructType, tag: str, raw: Outline, prefix: str) -> T.StructType:
    """A schema without the attributes that are namespace declarations, whose names are cut to the prefix they declare."""
    declared: dict[str, set[str]] = {}
    real: dict[str, set[str]] = {}
    for path, titles in raw.attributes.items():
        for title in titles:
            (declared if title.startswith("xmlns") else real).setdefault(_local(path[-1]), set()).add(prefix + _local(title))

    def kept(dtype, name):
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(kept(dtype.elementType, name))
        if not isinstance(dtype, T.StructType):
            return dtype
        gone = declared.get(name, set()) - real.get(name, set())
        return T.StructType([T.StructField(f.name, kept(f.dataType, f.name)) for f in dtype.fields if f.name not in gone])

    return kept(schema, tag)


def read_xml_records(
    spark: SparkSession,
    path: str,
    record_path: str | None = None,
    *,
    options: X.FlattenOptions = X.FlattenOptions(),
    namespace_mode: str = "strip",
    on_malformed: str = "raise",
    ancestors: bool = True,
    with_file_name: bool = False,
    schema: T.StructType | None = None,
) -> tuple[DataFrame, Outline, list[tuple[str, ...]]]:
    """Nested record rows of XML files (a file, a folder of ``*.xml``, or a glob), their outline and the record paths.

    The outline is that of all files (:mod:`~twinledger.sources.outline`). Records are all elements at all
    paths that ``record_path`` (in local names) means; without one, all of the least deep tag that comes
    more than once in some file. Files are split at the elements that :func:`split_units` names, one reader for
    each. With ``ancestors=False`` no context is added and files are split finest. ``schema``, where given, is
    that of the elements at which files are split.
    """
    raw = outline_of(spark, path, _GLOB)
    outline = raw.stripped() if namespace_mode == "strip" else raw
    records = record_paths(outline, record_path, options.path_separator)
    carry = ("__file",) if with_file_name else ()
    tables = []
    for row_tag, below in split_units(outline, records, ancestors).items():
        reader = spark.read.options(**_reader_options(options, namespace_mode, on_malformed, row_tag))
        reader = reader.option("pathGlobFilter", _GLOB)
        df = (reader if schema is None else reader.schema(schema)).xml(path)
        if schema is None and namespace_mode == "strip" and raw.namespaces:
            df = reader.schema(_without_declarations(df.schema, row_tag, raw, options.attribute_prefix)).xml(path)
        if with_file_name:
            df = df.select(F.col("_metadata.file_path").alias("__file"), "*")
        if on_malformed != "recover" and _CORRUPT in df.columns:
            df = df.drop(_CORRUPT)
        if () in below:
            tables.append(df)
        deeper = [[row_tag, *b] for b in below if b]
        if deeper:
            # The root gives no context, other elements at which files are split do.
            fields = [c for c in df.columns if c not in carry]
            wrapped = df.select(*carry, F.struct(*[names.col(c).alias(c) for c in fields]).alias(row_tag))
            if row_tag in outline.roots:
                wrapped, deeper = df, [d[1:] for d in deeper]
            known = X.element_paths(wrapped.schema, options.attribute_prefix, options.text_key)
            deeper = [d for d in deeper if d in known]  # not those that only skipped records have
        if deeper:
            tables.append(X.records_at(
                wrapped, deeper, path_separator=options.path_separator, attribute_prefix=options.attribute_prefix,
                text_key=options.text_key, carry=carry, ancestors=ancestors,
            ))
    if not tables:
        raise ValueError(f"no record could be read at record_path {record_path!r}")
    return reduce(lambda a, b: X.union_of_records(a, b, options.text_key), tables), outline, records


def read_xml(
    spark: SparkSession,
    path: str,
    record_path: str | None = None,
    *,
    namespace_mode: str = "strip",
    on_malformed: str = "raise",
    ancestors: bool = True,
    with_file_name: bool = False,
    max_rows: int | None = None,
    schema: T.StructType | None = None,
    **flatten_options,
) -> X.Flattened:
    """Read XML files and flatten their records; see :func:`~twinledger.operators.flatten.flatten`.

    All files share one schema, so a column is in the same place for each of them. ``max_rows`` is
    per file. With ``with_file_name`` the rows say which file they are from (``__file``, its path).
    """
    flatten_options.setdefault("column_order", "discovery")
    options = X.FlattenOptions(**flatten_options)
    per_file = max_rows is not None
    df, outline, records = read_xml_records(
        spark, path, record_path, options=options, namespace_mode=namespace_mode, on_malformed=on_malformed,
        ancestors=ancestors, with_file_name=with_file_name or per_file, schema=schema,
    )
    options = _with_names(options, namespace_mode, outline.namespaces)
    carry = tuple(c for c in ("__file",) if c in df.columns)
    hint = _hint(outline, records, options)
    result = X.flatten(df, options, carry=carry, discovery=hint)
    if per_file:
        result.table = limit_per_group(result.table, ["__file"], max_rows)
        if not with_file_name:
            result.table = result.table.drop("__file")
    return result


def limit_per_group(df: DataFrame, group: list[str], rows: int) -> DataFrame:
    """The first ``rows`` rows of each group; every task cuts its own rows before they are shuffled."""
    placed = df.withColumn("__order", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__order"))
    return placed.withColumn("__place", place).where(F.col("__place") <= rows).drop("__place", "__order")


def read_xml_tables(spark: SparkSession, path: str, record_path: str | None = None, **options) -> dict[str, DataFrame]:
    """One table per XML file of a folder, all with the same columns.

    Tables are named by their files; if two files have one name, by their paths below the common folder.
    """
    table = read_xml(spark, path, record_path, with_file_name=True, **options).table
    files = [r["__file"] for r in table.select("__file").distinct().orderBy("__file").collect()]
    titles = [unquote(posixpath.basename(f)) for f in files]
    if len(set(titles)) < len(titles):
        folder = posixpath.commonpath([posixpath.dirname(f) for f in files])
        titles = [unquote(posixpath.relpath(f, folder)) for f in files]
    return {title: table.where(F.col("__file") == f).drop("__file") for title, f in zip(titles, files)}


# ---------------------------------------------------------------------------------------------
# Documents held in a column, and archives of documents
# ---------------------------------------------------------------------------------------------


def members_of(archives: DataFrame, suffix: str | None = ".xml", name: str = "archive",
               content: str = "content") -> DataFrame:
    """Files inside tar archives held in a binary column: ``archive, member, text``.

    One task reads one archive and gives out its members one by one. Other members are skipped.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
                    for info in tar:
                        if not info.isfile() or (suffix and not info.name.lower().endswith(suffix)):
                            continue
                        text = tar.extractfile(info).read().decode("utf-8-sig", errors="replace")
                        yield pd.DataFrame({"archive": [archive], "member": [info.name], "text": [text]})

    columns = archives.select(names.col(name).alias("archive"), names.col(content).alias("content"))
    return columns.mapInPandas(members, "archive string, member string, text string")


def archive_members(spark: SparkSession, path: str, suffix: str | None = ".xml") -> DataFrame:
    """Files inside tar archives (any tar compression) on disk: ``archive, member, text``."""
    return members_of(spark.read.format("binaryFile").load(path), suffix, "path")


def parse_documents(df: DataFrame, column: str, *, options: X.FlattenOptions = X.FlattenOptions(),
                    namespace_mode: str = "strip", on_malformed: str = "raise",
                    schema: T.StructType | None = None) -> DataFrame:
    """Parse one XML document per row; the root's children become columns next to the other columns.

    Without a schema one is inferred over all documents, in parallel, so it is the same for each.
    """
    reader = _reader_options(options, namespace_mode, on_malformed, "ROW")
    text = names.col(names.resolve(df, column))
    if schema is None:
        documents = df.select(text.alias("text")).where(F.col("text").isNotNull()).rdd.map(lambda r: r["text"])
        schema = df.sparkSession.read.options(**{**reader, "mode": "PERMISSIVE"}).xml(documents).schema
    fields = [f for f in schema.fields if f.name != _CORRUPT]
    if on_malformed == "raise":
        parsed = F.from_xml(text, _ddl(fields), reader)
        bad = None
    else:
        permissive = {**reader, "mode": "PERMISSIVE"}
        parsed = F.from_xml(text, _ddl([*fields, T.StructField(_CORRUPT, T.StringType())]), permissive)
        bad = F.col("__document").getField(_CORRUPT).isNotNull()
    others = [names.col(c) for c in df.columns if c != column]
    out = df.select(*others, parsed.alias("__document"))
    if on_malformed == "skip":
        out = out.where(~bad)
    kept = [names.col(c) for c in out.columns if c != "__document"]
    return out.select(*kept, *[F.col("__document").getField(f.name).alias(f.name) for f in fields])


def _ddl(fields: list[T.StructField]) -> str:
    return ", ".join(f"{names.quoted(f.name)} {_type_ddl(f.dataType)}" for f in fields)


def _type_ddl(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StructType):
        return "struct<" + ", ".join(f"{names.quoted(f.name)}: {_type_ddl(f.dataType)}" for f in dtype.fields) + ">"
    if isinstance(dtype, T.ArrayType):
        return f"array<{_type_ddl(dtype.elementType)}>"
    return dtype.simpleString()


def read_xml_archive(spark: SparkSession, path: str, record_path: str | None = None, *,
                     namespace_mode: str = "strip", on_malformed: str = "raise", max_rows: int | None = None,
                     schema: T.StructType | None = None, **flatten_options) -> X.Flattened:
    """Read every XML member of tar archives and flatten the records, with ``archive`` and ``member``."""
    options = X.FlattenOptions(**flatten_options)
    carry = ("archive", "member")
    documents = parse_documents(archive_members(spark, path), "text", options=options, schema=schema,
                                namespace_mode=namespace_mode, on_malformed=on_malformed)
    root = None
    if record_path:
        first = record_path.split(options.path_separator)[0]
        body = T.StructType([f for f in documents.schema.fields if f.name not in carry])
        segments = [s for s in record_path.split(options.path_separator) if s]
        root = first if not X.find_record_paths(body, segments) else None
    records = X.select_records(documents, record_path, root=root, path_separator=options.path_separator,
                               attribute_prefix=options.attribute_prefix, text_key=options.text_key, carry=carry)
    result = X.flatten(records, options, carry=carry)
    if max_rows is not None:
        result.table = limit_per_group(result.table, list(carry), max_rows)
    return result
