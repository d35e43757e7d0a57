"""Guided aggregation: many aggregates over one key, plain or spread over categories.

All plain aggregates share one ``groupBy(key)``. Category aggregates first group by (key, category)
and then turn the few remaining rows into columns, so their cost does not grow with the number of
categories and a hot key is spread over its categories. Everything but concatenation is a partial
aggregate, so a hot key leaves each map task as one row. A concatenated cell holds the whole text of
its group; one that no cell can hold raises with its key, and :func:`concatenate_parts` gives it as rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, names
from ..plans import durable
from ..plans.agg_specs import AggSpec, check_specs

KEY, CATEGORY = "__key", "__category"
# What a string cell can hold at all (2 GB); not a setting.
_CELL_BYTES = 2_000_000_000

# Cell states; the position is the code carried through the aggregates.
STATES = ["ok", "non_numeric", "empty", "invalid", "duplicate", "not_found", "non_text"]
_CODE = {name: n for n, name in enumerate(STATES)}


@dataclass
class Measure:
    """How one spec is aggregated and read back."""

    aggregates: dict[str, Column]
    value: Callable[[Callable[[str], Column]], Column]
    dtype: T.DataType
    state: Callable[[Callable[[str], Column]], Column] | None = None
    texts: dict[str, str] = field(default_factory=dict)
    absent: tuple[Any, str] = (None, "ok")  # value and state of a category cell without rows


class Inputs:
    """Row-level expressions the aggregates read, each computed once per row in one projection."""

    def __init__(self) -> None:
        self._known: dict[tuple, tuple[str, Column]] = {}

    def put(self, label: tuple, expression: Column) -> Column:
        """Register an expression under a label that tells it from others; returns its column."""
        name, _ = self._known.setdefault(label, (f"i{len(self._known)}", expression))
        return F.col(name)

    def columns(self) -> list[Column]:
        return [expression.alias(name) for name, expression in self._known.values()]


def _text_of(c: Column, dtype: T.DataType, strip: bool, null_text: str | None) -> Column:
    """Cell as text, trimmed on request; NULL is blank unless a text for it is given."""
    text = cells.render(c, dtype)
    if strip and cells.is_text(dtype):
        text = cells.strip(text)
    return F.coalesce(text, F.lit("" if null_text is None else null_text))


def _numbers(kind: str, spec: AggSpec, dtype: T.DataType, null_text: str | None, inputs: Inputs) -> Measure:
    c, o = names.col(spec.agg_col), spec.agg_options
    if cells.is_text(dtype):
        text = cells.strip(c) if o.get("strip") else c
        text = text if null_text is None else F.coalesce(text, F.lit(null_text))
        number = inputs.put(("number", spec.agg_col, o.get("strip", False)), cells.number_from_text(text))
        blank = text.isNull() | (text == "")
    elif cells.is_number(dtype):
        number = c.cast("int") if isinstance(dtype, T.BooleanType) else c
        number = inputs.put(("number", spec.agg_col), number)
        blank = c.isNull()
    else:
        number, blank = inputs.put(("number", spec.agg_col), F.lit(None).cast("double")), c.isNull()
    if o["ignore_non_numbers"]:
        bad = F.lit(False)
    elif not o["ignore_empty"]:
        bad = number.isNull()
    elif cells.is_number(dtype):
        bad = F.lit(False)
    else:
        bad = number.isNull() & ~inputs.put(("blank", spec.agg_col, o.get("strip", False)), blank)
    function = {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg}[kind]
    if kind == "average":
        out: T.DataType = T.DoubleType()
    elif cells.is_text(dtype) or not cells.is_number(dtype) or isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = T.DoubleType()
    elif isinstance(dtype, T.DecimalType):
        out = T.DecimalType(38, dtype.scale) if kind == "sum" else dtype
    else:
        out = T.LongType()
    return Measure(
        {"v": function(number).cast(out), "n": F.count(number), "bad": F.count_if(bad)},
        value=lambda get: F.when(get("bad") == 0, get("v")),
        state=lambda get: F.when(get("bad") > 0, _CODE["non_numeric"]).when(get("n") == 0, _CODE["empty"]).otherwise(0),
        dtype=out,
        texts={"non_numeric": o["non_numbers_text"], "empty": o["empty_text"]},
        absent=(None, "empty"),
    )


def _booleans(kind: str, spec: AggSpec, dtype: T.DataType, null_text: str | None, inputs: Inputs) -> Measure:
    c, o = names.col(spec.agg_col), spec.agg_options
    if o.get("strip") and not isinstance(dtype, T.BooleanType):
        # Trimmed cells are judged as text, so the number 1 becomes the word '1'.
        c, dtype = _text_of(c, dtype, True, null_text), T.StringType()
    word = cells.as_boolean(c, dtype, allow_yn=o["allow_yn"], allow_01=o["allow_01"], allow_tf=o["allow_tf"])
    label = (spec.agg_col, o["allow_yn"], o["allow_01"], o["allow_tf"], o.get("strip", False))
    word = inputs.put(("word", *label), word)
    bad = word.isNull()
    if o["ignore_blanks"]:
        bad = bad & ~inputs.put(("blank word", *label), cells.is_blank(c, dtype))
    function = F.bool_and if kind == "and" else F.bool_or
    return Measure(
        {"v": function(word), "bad": F.count_if(bad)},
        value=lambda get: F.when(get("bad") == 0, get("v")),
        state=lambda get: F.when(get("bad") > 0, _CODE["invalid"]).when(get("v").isNull(), _CODE["empty"]).otherwise(0),
        dtype=T.BooleanType(),
        texts={"invalid": o["invalid_text"], "empty": ""},
        absent=(None, "empty"),
    )


def _plain_value(spec: AggSpec, dtype: T.DataType, inputs: Inputs, strip: bool) -> Column:
    """The cell itself, trimmed if it is text and that is asked for."""
    c = names.col(spec.agg_col)
    strip = strip and cells.is_text(dtype)
    return inputs.put(("value", spec.agg_col, strip), cells.strip(c) if strip else c)


def _counts(kind: str, spec: AggSpec, dtype: T.DataType, null_text: str | None, inputs: Inputs) -> Measure:
    strip = spec.agg_options.get("strip", False)
    if kind == "count_all":
        value = F.count(F.lit(1))
    else:
        text = _text_of(names.col(spec.agg_col), dtype, strip, null_text)
        value = F.count_if(inputs.put(("nonempty", spec.agg_col, strip), text != ""))
    return Measure({"v": value}, lambda get: get("v"), T.LongType(), absent=(0, "ok"))


def _are_same(spec: AggSpec, dtype: T.DataType, inputs: Inputs) -> Measure:
    o = spec.agg_options
    value = _plain_value(spec, dtype, inputs, o["strip"])
    return Measure(
        {"lo": F.min(value), "hi": F.max(value), "n": F.count(value), "null": F.count_if(value.isNull())},
        # One distinct value, NULL being a value too; smallest = largest needs no distinct pass.
        value=lambda get: F.when(get("n") == 0, True).otherwise((get("null") == 0) & (get("lo") == get("hi"))),
        dtype=T.BooleanType(),
        texts={"not_found": o.get("not_found_text", "")},
        absent=(None, "not_found"),
    )


def _text_lengths(kind: str, spec: AggSpec, dtype: T.DataType, null_text: str | None, inputs: Inputs) -> Measure:
    c, o = names.col(spec.agg_col), spec.agg_options
    length = F.length(_text_of(c, dtype, o["strip"], null_text)).cast("bigint")
    length = inputs.put(("length", spec.agg_col, o["strip"]), length)
    bad = F.lit(False)
    if not o["strip"]:
        bad = inputs.put(("null", spec.agg_col), c.isNull()) if cells.is_text(dtype) else F.lit(True)
    function = {"min": F.min, "max": F.max, "avg": F.avg}[kind[:3]]
    return Measure(
        {"v": function(length), "bad": F.count_if(bad)},
        value=lambda get: F.when(get("bad") == 0, get("v")),
        state=lambda get: F.when(get("bad") > 0, _CODE["non_text"]).otherwise(0),
        dtype=T.DoubleType() if kind[:3] == "avg" else T.LongType(),
        texts={"non_text": o["non_text_message"], "empty": o["empty_text"]},
        absent=(None, "empty"),
    )


def _filled(kind: str, spec: AggSpec, dtype: T.DataType, null_text: str | None, inputs: Inputs) -> Measure:
    c, o = names.col(spec.agg_col), spec.agg_options
    filled = _text_of(c, dtype, True, null_text) != "" if o["strip"] else cells.is_filled(c, dtype)
    filled = inputs.put(("filled", spec.agg_col, o["strip"]), filled)
    aggregate = {
        "all_filled": F.bool_and(filled),
        "some_filled": F.bool_or(filled),
        "none_filled": ~F.bool_or(filled),
    }[kind]
    return Measure({"v": aggregate}, lambda get: get("v"), T.BooleanType(), absent=(kind == "none_filled", "ok"))


def _single(spec: AggSpec, dtype: T.DataType, inputs: Inputs) -> Measure:
    """The one value of a (key, category); NULLs do not count as entries."""
    c, o = _plain_value(spec, dtype, inputs, False), spec.agg_options
    if o["allow_duplicates_if_equal"]:
        aggregates = {"v": F.min(c), "hi": F.max(c), "n": F.count(c)}

        def repeated(get):
            return (get("n") > 1) & (get("v") != get("hi"))
    else:
        aggregates = {"v": F.any_value(c, F.lit(True)), "n": F.count(c)}

        def repeated(get):
            return get("n") > 1
    return Measure(
        aggregates,
        value=lambda get: F.when(~repeated(get), get("v")),
        state=lambda get: F.when(repeated(get), _CODE["duplicate"]).otherwise(0),
        dtype=dtype,
        texts={"duplicate": o["duplicates_text"]},
    )


def _category_sum(spec: AggSpec, dtype: T.DataType, inputs: Inputs) -> Measure:
    c, o = names.col(spec.agg_col), spec.agg_options
    kind = inputs.put(("cell type", spec.agg_col), cells.cell_type(c, dtype))
    number = inputs.put(("number or zero", spec.agg_col), F.coalesce(cells.as_double(c, dtype), F.lit(0.0)))
    number = F.when(kind != "BLANK", number)
    bad = F.lit(False) if o["ignore_non_numbers"] else kind.isin("DATE", "TEXT")
    return Measure(
        {"v": F.sum(number), "bad": F.count_if(bad)},
        value=lambda get: F.when(get("bad") == 0, F.coalesce(get("v"), F.lit(0.0))),
        state=lambda get: F.when(get("bad") > 0, _CODE["non_numeric"]).otherwise(0),
        dtype=T.DoubleType(),
        texts={"non_numeric": o["non_numbers_text"]},
        absent=(0.0, "ok"),
    )


def _measure(spec: AggSpec, dtype: T.DataType, null_text: str | None, inputs: Inputs) -> Measure | None:
    """Aggregates of a spec; None for concatenation and distinct counts, which are planned on their own."""
    kind = spec.kind
    if kind in ("sum", "min", "max", "average"):
        return _numbers(kind, spec, dtype, null_text, inputs)
    if kind in ("and", "or"):
        return _booleans(kind, spec, dtype, null_text, inputs)
    if kind in ("count_all", "count_nonempty"):
        return _counts(kind, spec, dtype, null_text, inputs)
    if kind == "are_same":
        return _are_same(spec, dtype, inputs)
    if kind.endswith("_text_length"):
        return _text_lengths(kind, spec, dtype, null_text, inputs)
    if kind.endswith("_filled"):
        return _filled(kind, spec, dtype, null_text, inputs)
    if kind == "single":
        return _single(spec, dtype, inputs)
    if kind == "category_sum":
        return _category_sum(spec, dtype, inputs)
    return None


# ---------------------------------------------------------------------------------------------
# Distinct counts and concatenation
# ---------------------------------------------------------------------------------------------

_UNIQUE = Measure({}, lambda get: get("v"), T.LongType(), absent=(0, "ok"))
_JOINED = Measure({}, lambda get: get("v"), T.StringType(), lambda get: F.lit(_CODE["ok"]), absent=("", "ok"))


def _distinct_counts(df: DataFrame, group: dict[str, Column], specs: list[tuple[int, AggSpec]],
                     types: dict[str, T.DataType]) -> DataFrame:
    """Distinct values per group as ``v<spec>``, all specs in one pass; NULL is one value.

    Each row becomes one (group, spec, value) per spec, distinct already in its task; grouping by all
    three spreads a hot group over its values. Values travel as text or number of one type per kind, so
    specs of different types fit one table.
    """
    kinds: dict[str, str] = {}
    items = []
    for n, s in specs:
        dtype = types[s.agg_col]
        c = names.col(s.agg_col)
        value = cells.strip(c) if s.agg_options.get("strip") and cells.is_text(dtype) else c
        slot = kinds.setdefault(dtype.simpleString(), f"x{len(kinds)}")
        items.append((n, slot, value))
    slots = {slot: kind for kind, slot in kinds.items()}
    structs = [
        F.struct(F.lit(n).alias("n"), *[(value if slot == k else F.lit(None).cast(kind)).alias(k) for k, kind in slots.items()])
        for n, slot, value in items
    ]
    exploded = df.select(*[g.alias(n) for n, g in group.items()], F.explode(F.array(*structs)).alias("item"))
    pairs = exploded.select(*group, "item.*").distinct()
    counts = [F.count_if(F.col("n") == n).alias(f"v{n}") for n, _, _ in items]
    return pairs.groupBy(*group).agg(*counts)


def _merged(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Put tables with one row per group side by side.

    All parts are already partitioned by the group, so their union needs no further exchange.
    """
    if len(parts) == 1:
        return parts[0]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    picks = [
        (F.max(f.name) if cells.is_number(f.dataType) else F.any_value(F.col(f.name), F.lit(True))).alias(f.name)
        for f in together.schema.fields
        if f.name not in by
    ]
    return together.groupBy(*by).agg(*picks)


def _concatenated(df: DataFrame, group: dict[str, Column], text: Column, link: str, unique: bool,
                  order: list[Column], name: str) -> DataFrame:
    """One text per group, in the given order or, if unique, of the sorted distinct items."""
    fields = list(group)
    keyed = [c.alias(n) for n, c in group.items()]
    if unique:
        rows = df.select(*keyed, text.alias("t")).distinct()
        item, read = F.col("t"), None
    else:
        rows = df.select(*keyed, F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], text.alias("t")).alias("item"))
        item, read = F.col("item"), "t"
    gathered = F.array_sort(F.collect_list(item))
    if read:
        gathered = F.transform(gathered, lambda x: x[read])
    size = F.sum(F.octet_length(F.col("t") if unique else F.col("item.t")) + F.lit(len(link.encode())))
    told = F.concat_ws(", ", *[F.col(f).cast("string") for f in fields])
    too_long = F.raise_error(F.concat(F.lit("no cell can hold the concatenated text of "), told, F.lit("; use concatenate_parts")))
    grouped = rows.groupBy(*fields).agg(gathered.alias("items"), size.alias("size"))
    joined = F.when(F.col("size") > _CELL_BYTES, too_long.cast("string")).otherwise(F.array_join("items", link))
    return grouped.select(*fields, joined.alias(name))


def concatenate_parts(
    df: DataFrame,
    key: str | int,
    column: str | int,
    order_by: list[str] | None = None,
    *,
    strip: bool = True,
    unique: bool = False,
    part_rows: int = 10_000,
    link_text: str = ", ",
    null_text: str | None = None,
) -> DataFrame:
    """Concatenation for groups of any size, as rows ``key, part, text`` of ``part_rows`` items each.

    Joining a key's parts in order with the link text gives exactly the cell of the ``concatenate``
    (or, with ``unique``, ``concatenate_unique``) aggregate. All rows are numbered in order of key and
    row (range partitions, so a hot key fills many); an item's part is its distance from the first
    number of its key. The narrow table of first numbers is joined in a way adaptive execution can
    split, and parts are grouped one by one, so no task holds a whole hot key.
    """
    key, column = names.resolve(df, key), names.resolve(df, column)
    text = _text_of(names.col(column), df.schema[column].dataType, strip, null_text)
    if unique:
        rows = df.select(names.col(key).alias(KEY), text.alias("o0")).distinct().withColumn("t", F.col("o0"))
        order = ["o0"]
    else:
        if not order_by:
            raise ValueError("concatenation in row order needs order_by")
        order = [f"o{n}" for n in range(len(order_by))]
        rows = df.select(
            names.col(key).alias(KEY),
            *[names.col(names.resolve(df, c)).alias(o) for c, o in zip(order_by, order)],
            text.alias("t"),
        )
    numbered = durable.with_row_number(rows, [KEY, *order], "number")
    first = durable.checkpointed(numbered.groupBy(F.col(KEY).alias("first_key")).agg(F.min("number").alias("first")))
    placed = numbered.join(first, F.col(KEY).eqNullSafe(F.col("first_key")))
    part = (F.floor((F.col("number") - F.col("first")) / F.lit(part_rows)) + 1).cast("int").alias("part")
    items = F.transform(F.array_sort(F.collect_list(F.struct("number", "t"))), lambda x: x["t"])
    parts = placed.groupBy(KEY, part).agg(F.array_join(items, link_text).alias("text"))
    return parts.select(F.col(KEY).alias("key"), "part", "text")


# ---------------------------------------------------------------------------------------------
# The aggregate operator
# ---------------------------------------------------------------------------------------------


def distinct_values(df: DataFrame, column: str | int, limit: int | None = None) -> list[Any]:
    """Sorted distinct values of a column (NULL last); raises beyond ``limit``, if there is one."""
    name = names.resolve(df, column)
    rows = df.select(names.col(name).alias("v")).distinct()
    rows = (rows if limit is None else rows.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"column {name!r} has more than {limit} distinct values")
    values = [r["v"] for r in rows]
    return sorted((v for v in values if v is not None)) + ([None] if None in values else [])


def _state_text(code: Column, measure: Measure) -> Column:
    possible = {"ok", *measure.texts, measure.absent[1]}
    text = F.when(code == 0, STATES[0])
    for name in STATES[1:]:
        if name in possible:
            text = text.when(code == _CODE[name], name)
    return text


def _flagged(measure: Measure) -> bool:
    return measure.state is not None


def _output(name: str, value: Column, code: Column | None, measure: Measure, as_text: bool) -> list[Column]:
    """Result column(s) of one cell: text with placeholders, or typed value plus state."""
    if not as_text:
        out = [value.cast(measure.dtype).alias(name)]
        if code is not None:
            out.append(_state_text(code, measure).alias(f"{name}__status"))
        return out
    text = cells.render(value, measure.dtype)
    if code is not None and measure.texts:
        for state, label in measure.texts.items():
            text = F.when(code == _CODE[state], F.lit(label)).otherwise(text)
    return [text.alias(name)]


def aggregate(
    df: DataFrame,
    key: str | int,
    specs: list[AggSpec | dict[str, Any]],
    *,
    key_name: str | None = None,
    order_by: list[str] | None = None,
    as_text: bool = False,
    null_text: str | None = None,
    ordered: bool = False,
    on_error: str = "skip",
    max_pivot_columns: int | None = None,
) -> DataFrame:
    """One row per key with one column per aggregate (or per aggregate and category).

    Typed by default: a column holds its value, and ``<name>__status`` says why there is none
    (:data:`STATES`). With ``as_text`` each cell is text and shows the placeholder instead. NULL
    cells are blank; ``null_text='None'`` treats them as that word. ``order_by`` gives the row
    order for ``concatenate``. Unknown kinds and bad category columns are skipped with a warning or
    raised. Category columns are named ``<name> - <category>``; a spec with a list of categories has those
    columns, others have one for each value of their category column. More than ``max_pivot_columns``
    of them raise, if it is given.
    """
    key = names.resolve(df, key)
    label = key_name or key
    plan = check_specs(df, specs, on_error)
    key_col = names.col(key)

    types = {f.name: f.dataType for f in df.schema.fields}
    parts: list[DataFrame] = []  # tables with one row per key
    columns: dict[int, list[str]] = {n: [] for n in range(len(plan))}

    # Plain aggregates: one groupBy.
    inputs = Inputs()
    plain = [(n, s, m) for n, s in enumerate(plan) if not s.by_category
             and (m := _measure(s, types[s.agg_col], null_text, inputs))]
    raw = {f"m{n}_{k}": a for n, _, m in plain for k, a in m.aggregates.items()}
    if raw:
        base = df.select(key_col.alias(KEY), *inputs.columns()).groupBy(KEY).agg(*[a.alias(n) for n, a in raw.items()])
        outputs = []
        for n, s, m in plain:
            get = lambda k, n=n: F.col(f"m{n}_{k}")
            cell = _output(s.agg_name, m.value(get), m.state(get) if m.state else None, m, as_text)
            outputs += [c.alias(f"s{n}_{i}") for i, c in enumerate(cell)]
            columns[n] = [s.agg_name] + ([f"{s.agg_name}__status"] if len(cell) == 2 else [])
        parts.append(base.select(KEY, *outputs))

    # Distinct counts share one pass; each concatenation gathers rows of its own.
    unique = [(n, s) for n, s in enumerate(plan) if not s.by_category and s.kind == "count_unique"]
    if unique:
        counted = _distinct_counts(df, {KEY: key_col}, unique, types)
        cells_of = [_output("", F.col(f"v{n}"), None, _UNIQUE, as_text)[0].alias(f"s{n}_0") for n, _ in unique]
        parts.append(counted.select(KEY, *cells_of))
        columns |= {n: [s.agg_name] for n, s in unique}
    for n, s in enumerate(plan):
        if s.by_category or s.kind not in ("concatenate", "concatenate_unique"):
            continue
        if s.kind == "concatenate" and not order_by:
            raise ValueError("the concatenate aggregate needs order_by")
        text = _text_of(names.col(s.agg_col), types[s.agg_col], s.agg_options["strip"], null_text)
        order = [names.col(names.resolve(df, c)) for c in order_by or []]
        parts.append(_concatenated(df, {KEY: key_col}, text, s.agg_options["link_text"],
                                   s.kind == "concatenate_unique", order, f"s{n}_0"))
        columns[n] = [s.agg_name] + ([] if as_text else [f"{s.agg_name}__status"])
        if not as_text:
            parts[-1] = parts[-1].withColumn(f"s{n}_1", F.lit("ok"))

    # Category aggregates: group by (key, category), then spread; specs of one category column share it.
    by_category: dict[str, list[int]] = {}
    for n, s in enumerate(plan):
        if s.by_category:
            by_category.setdefault(s.agg_options["cat_key_col"], []).append(n)
    width = 0
    for cat, members in by_category.items():
        given = {n: plan[n].agg_options.get("categories") or None for n in members}
        found = None if all(given.values()) else distinct_values(df, cat, max_pivot_columns)
        values = {n: given[n] or found for n in members}
        width += sum(len(v) for v in values.values())
        if max_pivot_columns is not None and width > max_pivot_columns:
            raise ValueError(f"{width} pivot columns exceed the limit of {max_pivot_columns}")
        table, titles_of = _spread(df, key_col, cat, values, [(n, plan[n]) for n in members], as_text, null_text)
        columns |= titles_of
        parts.append(table)

    result = _merged(parts, [KEY]) if parts else df.select(key_col.alias(KEY)).distinct()
    final, titles = [F.col(KEY)], [label]
    for n, s in enumerate(plan):
        final += [F.col(f"s{n}_{i}") for i in range(len(columns[n]))]
        titles += columns[n]
    result = result.select(*[c.alias(t) for c, t in zip(final, names.unique_names(titles))])
    return result.orderBy(names.col(result.columns[0])) if ordered else result


def _spread(df: DataFrame, key_col: Column, cat: str, values: dict[int, list[Any]], specs: list[tuple[int, AggSpec]],
            as_text: bool, null_text: str | None) -> tuple[DataFrame, dict[int, list[str]]]:
    """Aggregate by (key, category) and turn categories into columns ``s<spec>_<i>``."""
    cat_col = names.col(cat)
    group = {KEY: key_col, CATEGORY: cat_col}
    types = {f.name: f.dataType for f in df.schema.fields}
    inputs = Inputs()
    measures = {n: _measure(s, types[s.agg_col], null_text, inputs) for n, s in specs}
    raw = {f"m{n}_{k}": a for n, m in measures.items() if m for k, a in m.aggregates.items()}
    prepared = df.select(*[c.alias(n) for n, c in group.items()], *inputs.columns())
    counted = prepared.groupBy(KEY, CATEGORY).agg(F.lit(True).alias("here"), *[a.alias(n) for n, a in raw.items()])
    outputs = []
    for n, m in measures.items():
        if m:
            get = lambda k, n=n: F.col(f"m{n}_{k}")
            outputs.append(m.value(get).alias(f"v{n}"))
            if m.state:
                outputs.append(m.state(get).alias(f"c{n}"))
    parts = [counted.select(KEY, CATEGORY, "here", *outputs)]
    unique = [(n, s) for n, s in specs if measures[n] is None and s.kind == "count_unique"]
    if unique:
        parts.append(_distinct_counts(df, group, unique, types))
        measures |= {n: _UNIQUE for n, _ in unique}
    for n, s in specs:
        if measures[n] is None:  # category-concat-unique
            text = _text_of(names.col(s.agg_col), types[s.agg_col], False, null_text)
            parts.append(_concatenated(df, group, text, s.agg_options["link_text"], True, [], f"v{n}"))
            measures[n] = _JOINED
    cellwise = _merged(parts, [KEY, CATEGORY])
    for n, _ in specs:
        if measures[n] is _JOINED:
            cellwise = cellwise.withColumn(f"c{n}", F.lit(_CODE["ok"]))

    def pick(c: str, dtype: T.DataType, at: Column) -> Column:
        # One row per cell: max() of a number keeps the aggregate hashed, any_value() serves the rest.
        value = F.when(at, F.col(c))
        return F.max(value) if cells.is_number(dtype) else F.any_value(value, F.lit(True))

    # Each value of any spec's list has a place; a spec reads the places of its own list.
    places: dict[Any, int] = {}
    for n, _ in specs:
        for value in values[n]:
            places.setdefault(value, len(places))
    picks, finals, found = [], [], {n: [] for n, _ in specs}
    for value, i in places.items():
        literal = F.lit(value) if value is not None else F.lit(None).cast(df.schema[cat].dataType)
        at = F.col(CATEGORY).eqNullSafe(literal)
        picks.append(F.max(F.when(at, F.col("here"))).alias(f"here_{i}"))
        for n, s in specs:
            m = measures[n]
            if value in values[n]:
                picks.append(pick(f"v{n}", m.dtype, at).alias(f"v{n}_{i}"))
                if m.state:
                    picks.append(pick(f"c{n}", T.IntegerType(), at).alias(f"c{n}_{i}"))
    wide = cellwise.groupBy(KEY).agg(*picks)
    for n, s in specs:
        m = measures[n]
        absent_value, absent_state = m.absent
        with_state = _flagged(m) or absent_state != "ok"
        for value in values[n]:
            i = places[value]
            here = F.col(f"here_{i}").isNotNull()
            cell = F.when(here, F.col(f"v{n}_{i}")).otherwise(F.lit(absent_value).cast(m.dtype))
            code = None
            if with_state:
                present = F.col(f"c{n}_{i}") if m.state else F.lit(0)
                code = F.when(here, present).otherwise(F.lit(_CODE[absent_state]))
            title = f"{s.agg_name} - {value}"
            for c in _output(title, cell, code, m, as_text):
                position = len(found[n])
                finals.append(c.alias(f"s{n}_{position}"))
                found[n].append(title if position == 0 or found[n][-1] != title else f"{title}__status")
    return wide.select(KEY, *finals), found


def de_aggregate(df: DataFrame, column: str | int, delim: str = ", ", strip: bool = True,
                 null_text: str = "None") -> DataFrame:
    """One row per item of a delimited cell; the other cells are repeated, empty items kept."""
    name = names.resolve(df, column)
    text = cells.render(names.col(name), df.schema[name].dataType, null_text)
    if not delim:
        raise ValueError("delim must not be empty")
    literal = "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in delim)
    item = F.explode(F.split(text, literal))
    out = df.select(*[item.alias(c) if c == name else names.col(c) for c in df.columns])
    return out.withColumn(name, cells.strip(names.col(name))) if strip else out
