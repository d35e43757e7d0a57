"""Flatten nested records (from XML, JSON or Parquet) to columns.

Everything is derived from the schema: leaf paths become one ``select``, exploded lists a chain of
``explode_outer``. There is no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, names

STRATEGIES = ("explode", "aggregate", "indexed", "residual")
AGGREGATE_FORMATS = ("json", "xml", "delimited")
RESIDUAL_FORMATS = ("json", "xml", "dict")
COLUMN_ORDERS = ("alpha", "stable", "discovery")
MAX_COLUMNS = 2000


@dataclass(frozen=True)
class FlattenOptions:
    """How nested parts turn into columns. ``attribute_prefix`` and ``text_key`` name what the reader wrote."""

    list_strategy: str = "explode"
    list_strategy_overrides: dict[str, str] = field(default_factory=dict)
    max_depth: int | None = None
    residual_format: str = "xml"
    aggregate_format: str = "json"
    aggregate_delimiter: str = " | "
    max_indexed_items: int = 10
    force_list: tuple[str, ...] = ()
    path_separator: str = "."
    attribute_prefix: str = "@"
    text_key: str = "#text"
    include_attributes: bool = True
    include_text: bool = True
    empty_value: str | None = ""
    column_order: str = "stable"
    discovery: tuple[str, ...] = ()
    max_columns: int | None = MAX_COLUMNS
    rename: dict[str, str] = field(default_factory=dict)  # namespace prefix -> text put in its place

    def __post_init__(self):
        for strategy in (self.list_strategy, *self.list_strategy_overrides.values()):
            if strategy not in STRATEGIES:
                raise ValueError(f"unknown list strategy {strategy!r}; known are {STRATEGIES}")
        if self.residual_format not in RESIDUAL_FORMATS:
            raise ValueError(f"unknown residual format {self.residual_format!r}; known are {RESIDUAL_FORMATS}")
        if self.aggregate_format not in AGGREGATE_FORMATS:
            raise ValueError(f"unknown aggregate format {self.aggregate_format!r}; known are {AGGREGATE_FORMATS}")
        if self.column_order not in COLUMN_ORDERS:
            raise ValueError(f"unknown column order {self.column_order!r}; known are {COLUMN_ORDERS}")


@dataclass
class Flattened:
    """Result of :func:`flatten` with what its schema walk found."""

    table: DataFrame
    discovered_paths: list[str]
    truncated_paths: list[str]
    warnings: list[str]
    observations: dict[str, Observation] = field(default_factory=dict)

    def metadata(self) -> dict:
        """``records``, ``rows`` and ``items_left_out`` as the first run of ``table`` counted them, with columns and paths.

        Nothing is read a second time for it, so it waits until some action has run the table whole.
        """
        seen = {k: v or 0 for o in self.observations.values() for k, v in o.get.items()}
        return {**seen, "columns": self.table.columns, "discovered_paths": self.discovered_paths,
                "truncated_paths": self.truncated_paths, "warnings": self.warnings}

    def record_count(self) -> int:
        """Number of output rows (runs the query)."""
        return self.table.count()


def _list_of(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType)


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _as_json(c: Column, dtype: T.DataType) -> Column:
    """JSON of any value; a scalar becomes a JSON string or number."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    wrapped = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def _as_xml(c: Column, dtype: T.DataType, tag: str, o: FlattenOptions) -> Column:
    """XML of one occurrence or of each in turn."""
    if _list_of(dtype):
        each = F.transform(c, lambda x: _as_xml(x, dtype.elementType, tag, o))
        return F.when(c.isNotNull(), F.array_join(each, ""))
    if isinstance(dtype, T.StructType):
        text = F.to_xml(c, {"rowTag": tag, "attributePrefix": o.attribute_prefix, "valueTag": o.text_key, "indent": ""})
        return F.when(c.isNotNull(), F.rtrim(text, F.lit("\n")))
    return F.concat(F.lit(f"<{tag}>"), _xml_escape(c.cast("string")), F.lit(f"</{tag}>"))


def _serialized(c: Column, dtype: T.DataType, tag: str, fmt: str, o: FlattenOptions) -> Column:
    if fmt == "dict":  # the structure itself, to be taken apart later by variant_get
        return F.when(c.isNotNull(), F.parse_json(_as_json(c, dtype)))
    return _as_xml(c, dtype, tag, o) if fmt == "xml" else _as_json(c, dtype)


class _Walk:
    """One walk over a schema: collects the explodes to run and the leaves to select."""

    def __init__(self, df: DataFrame, options: FlattenOptions, indexed_width: dict[str, int] | int | None):
        self.df, self.o, self.indexed_width = df, options, indexed_width
        self.leaves: list[tuple[str, Column]] = []
        self.structures: set[str] = set()  # leaves that are VARIANT values, not text
        self.truncated: list[str] = []
        self.indexed: dict[str, Column] = {}
        self.explodes = 0
        self.context: set[str] = set()

    def path(self, base: str, name: str) -> str:
        prefix, colon, local = name.partition(":")
        attribute = self.o.attribute_prefix
        if colon and prefix.removeprefix(attribute) in self.o.rename:
            lead = attribute if prefix.startswith(attribute) else ""
            name = lead + self.o.rename[prefix.removeprefix(attribute)] + local
        return f"{base}{self.o.path_separator}{name}" if base else name

    def is_attribute(self, name: str) -> bool:
        return bool(self.o.attribute_prefix) and name.startswith(self.o.attribute_prefix)

    def fields(self, struct: T.StructType, value, base: str, depth: int) -> None:
        """Attributes first, then own text, then children, as they stand in a document."""
        attributes = [f for f in struct.fields if self.is_attribute(f.name)]
        own_text = [f for f in struct.fields if f.name == self.o.text_key]
        children = [f for f in struct.fields if f not in attributes and f not in own_text]
        attributes = [f for f in attributes if not f.name.startswith(f"{self.o.attribute_prefix}xmlns")]
        if not depth:  # context of ancestors leads the row
            mark = self.o.path_separator + self.o.attribute_prefix
            context = [f for f in children if mark in f.name and not isinstance(f.dataType, (T.StructType, T.ArrayType))]
            children = [f for f in children if f not in context]
            self.leaves += [(f.name, cells.render(value(f.name), f.dataType)) for f in context]
            self.context = {f.name for f in context}
        if self.o.include_attributes:
            for f in attributes:
                self.leaves.append((self.path(base, f.name), cells.render(value(f.name), f.dataType)))
        if self.o.include_text:
            for f in own_text:
                # Text next to children or attributes keeps its own name, else it is the element itself.
                alone = not children and not (self.o.include_attributes and attributes)
                name = base if alone and base else self.path(base, f.name)
                self.leaves.append((name, cells.render(value(f.name), f.dataType)))
        for f in children:
            self.element(f.name, f.dataType, value(f.name), self.path(base, f.name), depth + 1)

    def element(self, tag: str, dtype: T.DataType, c: Column, path: str, depth: int) -> None:
        if tag in self.o.force_list and not _list_of(dtype):
            c, dtype = F.when(c.isNotNull(), F.array(c)), T.ArrayType(dtype)
        if not _list_of(dtype):
            self.single(tag, dtype, c, path, depth)
            return
        strategy = self.o.list_strategy_overrides.get(path, self.o.list_strategy)
        item = dtype.elementType
        if strategy == "explode":
            self.single(tag, item, self.exploded(c), path, depth)
        elif strategy == "aggregate":
            if self.o.aggregate_format == "delimited" and not isinstance(item, (T.StructType, T.ArrayType, T.MapType)):
                texts = F.transform(c, lambda x: cells.strip(cells.render(x, item, "")))
                value = F.array_join(texts, self.o.aggregate_delimiter)
            else:
                value = _serialized(c, dtype, tag, "xml" if self.o.aggregate_format == "xml" else "json", self.o)
            self.leaves.append((path, value))
        elif strategy == "indexed":
            self.indexed[path] = F.size(c)
            for i in range(self.width(path)):
                self.single(tag, item, F.get(c, F.lit(i)), self.path(path, str(i)), depth)
        else:
            self.residual(tag, dtype, c, path)

    def residual(self, tag: str, dtype: T.DataType, c: Column, path: str) -> None:
        self.truncated.append(path)
        title = self.path(path, "residual")
        if self.o.residual_format == "dict":
            self.structures.add(title)
        self.leaves.append((title, _serialized(c, dtype, tag, self.o.residual_format, self.o)))

    def single(self, tag: str, dtype: T.DataType, c: Column, path: str, depth: int) -> None:
        if self.o.max_depth is not None and depth > self.o.max_depth:
            self.residual(tag, dtype, c, path)
        elif isinstance(dtype, T.StructType):
            self.fields(dtype, lambda n: c.getField(n), path, depth)
        elif _list_of(dtype):
            self.element(tag, dtype, c, path, depth)
        elif self.o.include_text:
            self.leaves.append((path, cells.render(c, dtype)))

    def exploded(self, c: Column) -> Column:
        name = f"__item_{self.explodes}"
        self.explodes += 1
        self.df = self.df.withColumn(name, F.explode_outer(c))
        return F.col(name)

    def width(self, path: str) -> int:
        if isinstance(self.indexed_width, dict):
            return min(self.indexed_width.get(path, 0), self.o.max_indexed_items)
        return self.o.max_indexed_items if self.indexed_width is None else min(self.indexed_width, self.o.max_indexed_items)


def flatten(df: DataFrame, options: FlattenOptions | None = None, *, carry: tuple[str, ...] = (),
            indexed_width: str | int = "data", **changes) -> Flattened:
    """Flatten every nested column of a table to text columns named by their path.

    Lists are exploded (a row per item; independent lists multiply), aggregated into one cell, spread
    over indexed columns, or kept as one blob; per path through ``list_strategy_overrides``. A list
    is a list in every row, also where it has one item. ``carry`` columns are passed through as they
    are, in front. Residuals with ``residual_format='dict'`` are VARIANT values (NULL where there is nothing);
    all other cells are text. For indexed lists ``indexed_width='data'`` first asks for the longest list (one
    narrow aggregate); a number skips that, and streams need one.
    """
    o = replace(options or FlattenOptions(), **changes)
    carried = [names.col(c) for c in carry]
    source = df.drop(*carry) if carry else df
    observations = {} if df.isStreaming else {"records": Observation(), "rows": Observation()}
    full = df.select(*[names.col(c) for c in source.columns], *[c.alias(f"__carry_{i}") for i, c in enumerate(carried)])
    nested = T.StructType([full.schema[c] for c in source.columns])

    if observations:
        full = full.observe(observations["records"], F.count(F.lit(1)).alias("records"))

    def walk(width):
        w = _Walk(full, o, width)
        w.fields(nested, lambda n: names.col(n), "", 0)
        return w

    width: dict[str, int] | int | None = None if indexed_width == "data" else int(indexed_width)
    found = walk(width)
    warnings: list[str] = []
    if found.indexed and indexed_width == "data":
        paths = list(found.indexed)
        longest = found.df.agg(*[
            F.struct(
                F.max(size).alias("longest"),
                F.sum(F.greatest(size - o.max_indexed_items, F.lit(0))).alias("dropped"),
            ).alias(f"w{i}")
            for i, size in enumerate(found.indexed.values())
        ]).first()
        width = {p: max(longest[f"w{i}"]["longest"] or 0, 0) for i, p in enumerate(paths)}
        for i, p in enumerate(paths):
            if longest[f"w{i}"]["dropped"]:
                warnings.append(
                    f"{p}: {longest[f'w{i}']['dropped']} item(s) left out, more than max_indexed_items={o.max_indexed_items} in a list"
                )
        found = walk(width)
    left_out = [F.greatest(size - o.max_indexed_items, F.lit(0)) for size in found.indexed.values()]
    left_out = F.sum(reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0)) for n in left_out], F.lit(0)))
    leaves = found.leaves
    if o.column_order == "alpha":
        leaves = sorted(leaves, key=lambda leaf: leaf[0])
    elif o.column_order == "discovery" and o.discovery:
        place = {p: i for i, p in enumerate(o.discovery)} | {p: -1 for p in found.context}
        leaves = sorted(leaves, key=lambda leaf: place.get(leaf[0], len(place)))
    if o.max_columns is not None and len(leaves) > o.max_columns:
        warnings.append(f"{len(leaves) - o.max_columns} column(s) left out, more than max_columns={o.max_columns}")
        leaves = leaves[: o.max_columns]
    titles = names.unique_names([*carry, *[p for p, _ in leaves]])
    out = []
    for (path, c), title in zip(leaves, titles[len(carry):]):
        out.append((c if o.empty_value is None or path in found.structures else F.coalesce(c, F.lit(o.empty_value))).alias(title))
    rows = found.df
    if observations:
        rows = rows.observe(observations["rows"], F.count(F.lit(1)).alias("rows"), left_out.cast("bigint").alias("items_left_out"))
    table = rows.select(*[F.col(f"__carry_{i}").alias(t) for i, t in enumerate(titles[: len(carry)])], *out)
    return Flattened(table, [p for p, _ in found.leaves], sorted(found.truncated), warnings, observations)


def expected_rows(df: DataFrame, options: FlattenOptions | None = None, **changes) -> DataFrame:
    """How many rows exploding the top-level lists will give, before doing it."""
    o = replace(options or FlattenOptions(), **changes)
    factors = []

    def visit(dtype: T.DataType, c: Column, path: str) -> None:
        if _list_of(dtype):
            if o.list_strategy_overrides.get(path, o.list_strategy) == "explode":
                factors.append(F.greatest(F.coalesce(F.size(c), F.lit(1)), F.lit(1)).cast("bigint"))
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                visit(f.dataType, c.getField(f.name), f"{path}{o.path_separator}{f.name}")

    for f in df.schema.fields:
        visit(f.dataType, names.col(f.name), f.name)
    product = reduce(lambda a, b: a * b, factors, F.lit(1).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(product), F.lit(0)).alias("expected_rows"))


# ---------------------------------------------------------------------------------------------
# Records inside documents
# ---------------------------------------------------------------------------------------------


def _children(dtype: T.DataType) -> T.StructType | None:
    inner = dtype.elementType if _list_of(dtype) else dtype
    return inner if isinstance(inner, T.StructType) else None


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def element_paths(schema: T.StructType, attribute_prefix: str = "@", text_key: str = "#text") -> list[list[str]]:
    """All element paths of a schema, each before those below it; attributes and own text are no elements."""
    found: list[list[str]] = []

    def visit(struct: T.StructType, path: list[str]) -> None:
        for f in struct.fields:
            if (attribute_prefix and f.name.startswith(attribute_prefix)) or f.name == text_key:
                continue
            found.append([*path, f.name])
            if (inner := _children(f.dataType)) is not None:
                visit(inner, found[-1])

    visit(schema, [])
    return found


def _occurrences(c: Column, dtype: T.DataType, path: list[str]) -> Column:
    """How many elements at a path below a value there are in it."""
    none = F.lit(0).cast("bigint")
    if _list_of(dtype):
        if not path and not _list_of(dtype.elementType):
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
        each = F.transform(c, lambda x: _occurrences(x, dtype.elementType, path))
        return F.coalesce(F.aggregate(each, none, lambda a, x: a + x), none)
    if not path:
        return c.isNotNull().cast("bigint")
    return _occurrences(c.getField(path[0]), dtype[path[0]].dataType, path[1:])


def _has_list(struct: T.StructType, path: list[str]) -> bool:
    dtype = struct[path[0]].dataType
    if _list_of(dtype) or len(path) == 1:
        return _list_of(dtype)
    return _has_list(dtype, path[1:])


def detect_record_paths(df: DataFrame, *, attribute_prefix: str = "@", text_key: str = "#text",
                        carry: tuple[str, ...] = ()) -> list[list[str]]:
    """Paths of the records in a table of documents: all paths of one tag, wherever it lies.

    That is the least deep tag (ties by name) that comes more than once in some document, be it in one list
    or below different parents. One aggregate counts all tags; nothing is found where nothing repeats.
    """
    body = T.StructType([f for f in df.schema.fields if f.name not in carry])
    by_tag: dict[str, list[list[str]]] = {}
    for p in element_paths(body, attribute_prefix, text_key):
        by_tag.setdefault(p[-1], []).append(p)
    # A tag with one path and no list on it comes once at most.
    repeatable = {t: ps for t, ps in by_tag.items() if len(ps) > 1 or _has_list(body, ps[0])}
    if not repeatable:
        return []
    counts = []
    for i, paths in enumerate(repeatable.values()):
        each = [_occurrences(names.col(p[0]), body[p[0]].dataType, p[1:]) for p in paths]
        counts.append(F.max(reduce(lambda a, b: a + b, each)).alias(f"n{i}"))
    most = df.agg(*counts).first()
    repeated = [t for i, t in enumerate(repeatable) if (most[i] or 0) > 1]
    if not repeated:
        return []
    return by_tag[min(repeated, key=lambda t: (min(map(len, by_tag[t])), t))]


def detect_record_path(schema: T.StructType) -> list[str] | None:
    """Path of the shallowest repeated element, ties by name; None if nothing repeats."""
    level = [([], schema)]
    while level:
        repeated, below = [], []
        for path, struct in level:
            for f in struct.fields:
                here = [*path, f.name]
                if _list_of(f.dataType):
                    repeated.append(here)
                elif (inner := _children(f.dataType)) is not None:
                    below.append((here, inner))
        if repeated:
            return min(repeated, key=lambda p: p[-1])
        level = below
    return None


def find_record_paths(schema: T.StructType, segments: list[str]) -> list[list[str]]:
    """All schema paths that end in the given segments (compared by local name)."""
    found: list[list[str]] = []

    def visit(struct: T.StructType, path: list[str]) -> None:
        for f in struct.fields:
            here = [*path, f.name]
            if [_local(n) for n in here[-len(segments):]] == segments:
                found.append(here)
            if (inner := _children(f.dataType)) is not None:
                visit(inner, here)

    visit(schema, [])
    return found


def select_records(df: DataFrame, record_path: str | None = None, *, root: str | None = None,
                   path_separator: str = ".", attribute_prefix: str = "@", text_key: str = "#text",
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per record element of a document table, with the context of its ancestors.

    Each input row is a document (its columns are the root's children). Attributes and text of every
    ancestor below the root go along as ``Ancestor.@name`` and ``Ancestor``; other columns named
    ``carry`` stay as well. Without a path the records are found by :func:`detect_record_paths`, and a
    document in which nothing repeats is its own record. A table that is a stream needs a path.
    """
    body = T.StructType([f for f in df.schema.fields if f.name not in carry])
    if record_path is None:
        paths = detect_record_paths(df, attribute_prefix=attribute_prefix, text_key=text_key, carry=carry)
        if not paths:
            return df
    else:
        segments = [s for s in record_path.split(path_separator) if s]
        if root is not None and segments and segments[0] == _local(root):
            segments = segments[1:]
        if not segments:
            return df
        paths = find_record_paths(body, segments)
        if not paths:
            raise ValueError(f"no element lies at record_path {record_path!r}")
    return records_at(df, paths, path_separator=path_separator, attribute_prefix=attribute_prefix, text_key=text_key, carry=carry)


def records_at(df: DataFrame, paths: list[list[str]], *, path_separator: str = ".", attribute_prefix: str = "@",
               text_key: str = "#text", carry: tuple[str, ...] = (), ancestors: bool = True) -> DataFrame:
    """The records at given schema paths, one below the other, with the context of their ancestors."""
    body = T.StructType([f for f in df.schema.fields if f.name not in carry])
    tables = [_descend(df, body, p, path_separator, attribute_prefix, text_key, carry, ancestors) for p in paths]
    return reduce(lambda a, b: union_of_records(a, b, text_key), tables)


def union_of_records(a: DataFrame, b: DataFrame, text_key: str = "#text") -> DataFrame:
    """Two sets of records one below the other, by name.

    A field may have another shape on the other side, where an element has one item or no children: it then takes
    the shape that holds both (a list, a struct with own text).
    """
    merged = {f.name: f.dataType for f in a.schema.fields}
    for f in b.schema.fields:
        merged[f.name] = _holding_both(merged[f.name], f.dataType, text_key) if f.name in merged else f.dataType

    def shaped(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*[
            (_reshaped(names.col(n), have[n], t, text_key) if n in have else F.lit(None).cast(t)).alias(n) for n, t in merged.items()
        ])

    return shaped(a).unionByName(shaped(b))


def _holding_both(a: T.DataType, b: T.DataType, text_key: str) -> T.DataType:
    if a == b:
        return a
    if _list_of(a) or _list_of(b):
        inner = [t.elementType if _list_of(t) else t for t in (a, b)]
        return T.ArrayType(_holding_both(*inner, text_key))
    if isinstance(a, T.StructType) or isinstance(b, T.StructType):
        sides = [t if isinstance(t, T.StructType) else T.StructType([T.StructField(text_key, t)]) for t in (a, b)]
        fields = {f.name: f.dataType for f in sides[0].fields}
        for f in sides[1].fields:
            fields[f.name] = _holding_both(fields[f.name], f.dataType, text_key) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    return T.StringType()


def _reshaped(c: Column, have: T.DataType, want: T.DataType, text_key: str) -> Column:
    if have == want:
        return c
    if _list_of(want):
        if _list_of(have):
            return F.transform(c, lambda x: _reshaped(x, have.elementType, want.elementType, text_key))
        return F.when(c.isNotNull(), F.array(_reshaped(c, have, want.elementType, text_key)))
    if isinstance(want, T.StructType):
        own = isinstance(have, T.StructType)
        inside = {f.name: f.dataType for f in have.fields} if own else {text_key: have}
        parts = [
            (_reshaped(c.getField(f.name) if own else c, inside[f.name], f.dataType, text_key) if f.name in inside
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c.cast(want)


def _descend(df: DataFrame, body: T.StructType, path: list[str], separator: str, attribute_prefix: str,
             text_key: str, carry: tuple[str, ...], with_context: bool = True) -> DataFrame:
    context: list[str] = []
    current, struct = "", body
    for depth, name in enumerate(path):
        dtype = struct[name].dataType
        c = names.col(name) if not depth else F.col(current).getField(name)
        step = f"__level_{depth}"
        if _list_of(dtype):
            df = df.withColumn(step, F.explode(c))
        else:
            df = df.withColumn(step, c).where(F.col(step).isNotNull())
        current = step
        last = depth == len(path) - 1
        inner = _children(dtype)
        if not last:
            for f in inner.fields if with_context else ():
                if f.name.startswith(attribute_prefix) and not f.name.startswith(f"{attribute_prefix}xmlns"):
                    title = f"{name}{separator}{f.name}"
                elif f.name == text_key:
                    title = name
                else:
                    continue
                df = df.withColumn(f"__context_{len(context)}", F.col(step).getField(f.name))
                context.append(title)
            struct = inner
    kept = [names.col(c) for c in carry]
    ancestors = [F.col(f"__context_{i}").alias(t) for i, t in enumerate(context)]
    if inner is None:
        return df.select(*kept, *ancestors, F.col(current).alias(text_key))
    return df.select(*kept, *ancestors, *[F.col(current).getField(f.name).alias(f.name) for f in inner.fields])
