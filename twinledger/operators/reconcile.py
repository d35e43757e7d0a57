"""Reconcile two versions of a table cell by cell.

Both versions go through one union and one ``groupBy(key)``: a single exchange in which every key
ends up as one row with its two row counts and, where a count is 1, that side's row. Duplicated keys
collapse on the map side already, so a hot key costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, names
from ..plans import durable
from ..plans.lazy import Tables
from . import keys as K

TEXT, NUMERIC = 0, 1
ABSENT = -1

MODES = ("NAME", "POSITION")
SELECTIONS = ("LIST", "AUTO-OR", "AUTO-AND")

_LEFT_ROW, _RIGHT_ROW, _CAT, _SIDE = "__left_row", "__right_row", "__category", "__side"


@dataclass(frozen=True)
class ColumnPair:
    """Left column, right column (position, or -1 for none) and compare type (0 text, 1 numeric)."""

    left: int
    right: int
    compare: int = TEXT


@dataclass(frozen=True)
class Texts:
    """What the detail table shows."""

    match: str = "-"
    empty: str = "<blank>"
    missing_col: str = "<missing col>"
    missing_record: str = "<missing record>"
    ambiguous_record: str = "<ambiguous>"
    transition: str = " --> "
    in_tolerance: str = "--"


def _header(df: DataFrame, strip: bool) -> list[str]:
    return [c.strip(cells.WHITESPACE) if strip else c for c in df.columns]


def _repeated(header: list[str]) -> set[str]:
    return {h for h in header if header.count(h) > 1}


def positional_pairs(left: DataFrame, right: DataFrame) -> list[ColumnPair]:
    """First with first, second with second, ...; what is left over has no counterpart."""
    nl, nr = len(left.columns), len(right.columns)
    return [ColumnPair(i if i < nl else ABSENT, i if i < nr else ABSENT) for i in range(max(nl, nr))]


def map_columns(
    left: DataFrame,
    right: DataFrame,
    mode: str = "NAME",
    select: str = "AUTO-OR",
    columns: list[tuple] | None = None,
    strip: bool = True,
    sort: bool = False,
) -> tuple[list[ColumnPair], list[str]]:
    """Choose the column pairs to compare; also returns messages about what had to be left out.

    ``AUTO-OR`` takes all columns, ``AUTO-AND`` only those found on both sides, each by ``NAME`` or
    by ``POSITION``. ``LIST`` takes ``columns`` as (left, right, type) triples of names or positions.
    ``sort`` orders pairs found by name alphabetically.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if select not in SELECTIONS:
        raise ValueError(f"select must be one of {SELECTIONS}, not {select!r}")
    lhead, rhead = _header(left, strip), _header(right, strip)
    ldup, rdup = _repeated(lhead), _repeated(rhead)
    errors: list[str] = []

    if select == "LIST":
        if not columns:
            raise ValueError("select='LIST' needs columns")
        pairs = []
        for lcol, rcol, *rest in columns:
            sides = []
            for value, head, dup, side in ((lcol, lhead, ldup, "original"), (rcol, rhead, rdup, "new")):
                if isinstance(value, str):
                    name = value.strip(cells.WHITESPACE) if strip else value
                    if name not in head:
                        errors.append(f'Column "{name}" is not in the {side} table; pair left out')
                        break
                    if name in dup:
                        errors.append(f'Column "{name}" occurs more than once in the {side} table; pair left out')
                        break
                    value = head.index(name)
                elif value != ABSENT and not 0 <= value < len(head):
                    errors.append(f"Column {value} is beyond the {side} table; pair left out")
                    break
                sides.append(value)
            else:
                pairs.append(ColumnPair(sides[0], sides[1], rest[0] if rest else TEXT))
        if not pairs:
            raise ValueError("no valid column pair: " + "; ".join(errors))
        return pairs, errors

    if columns:
        errors.append("columns are ignored where they are selected automatically")
    if mode == "POSITION":
        pairs = positional_pairs(left, right)
        if select == "AUTO-AND":
            pairs = [p for p in pairs if ABSENT not in (p.left, p.right)]
        return pairs, errors
    for side, dup in (("original", ldup), ("new", rdup)):
        errors += [f'column name "{n}" occurs more than once in the {side} table and is ignored' for n in sorted(dup)]
    lpos = {n: i for i, n in enumerate(lhead) if n not in ldup}
    rpos = {n: i for i, n in enumerate(rhead) if n not in rdup}
    order = [n for n in lhead if n in lpos] + [n for n in rhead if n in rpos and n not in lpos]
    if select == "AUTO-AND":
        order = [n for n in order if n in lpos and n in rpos]
    if sort:
        order = sorted(order)
    return [ColumnPair(lpos.get(n, ABSENT), rpos.get(n, ABSENT)) for n in order], errors


def _compared_type(ltype: T.DataType, rtype: T.DataType) -> T.DataType | None:
    """Type two cells are compared in, or None if such cells are never equal."""
    try:
        return K.common_key_type(ltype, rtype)
    except TypeError:
        return None


def _cell_diff(n: int, pair: ColumnPair, ltypes: list, rtypes: list, texts: Texts, tolerance: float,
               zero_is_blank: bool) -> Column:
    """The detail cell of one column pair (the ``n``-th)."""
    cat = F.col(_CAT)
    has_left, has_right = 0 <= pair.left < len(ltypes), 0 <= pair.right < len(rtypes)

    def side(has: bool, row: str, position: int, types: list):
        if not has:
            return F.lit(None), T.StringType(), F.lit(False), F.lit(texts.missing_col)
        cell, dtype = F.col(row)[f"c{position}"], types[position]
        if zero_is_blank:
            filled = cells.is_filled(cell, dtype)
        else:
            filled = F.coalesce(cell != "", F.lit(False)) if cells.is_text(dtype) else cell.isNotNull()
        shown = F.when(filled, cells.render(cell, dtype)).otherwise(F.lit(texts.empty))
        return cell, dtype, filled, shown

    lcell, ltype, lfilled, lshown = side(has_left, _LEFT_ROW, pair.left, ltypes)
    rcell, rtype, rfilled, rshown = side(has_right, _RIGHT_ROW, pair.right, rtypes)

    left_text = (
        F.when(cat.isin("C", "H"), F.lit(texts.missing_record))
        .when(cat.isin("D", "F", "G"), F.lit(texts.ambiguous_record))
        .otherwise(lshown)
    )
    right_text = (
        F.when(cat.isin("B", "G"), F.lit(texts.missing_record))
        .when(cat.isin("E", "F", "H"), F.lit(texts.ambiguous_record))
        .otherwise(rshown)
    )
    change = F.concat(left_text, F.lit(texts.transition), right_text)
    if not has_left and not has_right:
        return F.when(cat == "A", F.lit(texts.match)).otherwise(change)
    if not has_left or not has_right:
        if pair.compare != NUMERIC:
            return change
        number = F.col(f"__lnum_{n}" if has_left else f"__rnum_{n}")
        shown = F.coalesce(F.when(lfilled | rfilled, cells.render(number, T.DoubleType())), lshown if has_left else rshown)
        either = (shown, rshown) if has_left else (lshown, shown)
        return F.when(cat == "A", F.concat(either[0], F.lit(texts.transition), either[1])).otherwise(change)

    both = lfilled & rfilled
    target = _compared_type(ltype, rtype)
    if target is None:
        same = F.lit(False)
    else:
        lcast, rcast = K.as_key(lcell, ltype, target), K.as_key(rcell, rtype, target)
        same = lcast == rcast
        if isinstance(target, (T.DoubleType, T.FloatType)):
            same = same & ~F.isnan(lcast)
    near = F.lit(False)
    if tolerance and cells.is_number(ltype) and cells.is_number(rtype):
        near = cells.in_tolerance(cells.as_double(lcell, ltype), cells.as_double(rcell, rtype), tolerance)

    if pair.compare == NUMERIC:
        lnum = F.when(lfilled, F.col(f"__lnum_{n}"))
        rnum = F.when(rfilled, F.col(f"__rnum_{n}"))
        parsed = lnum.isNotNull() & rnum.isNotNull()
        same = F.when(parsed, (lnum == rnum) & ~F.isnan(lnum)).otherwise(same & lnum.isNull() & rnum.isNull())
        if tolerance:
            near = parsed & cells.in_tolerance(lnum, rnum, tolerance)
        as_float = T.DoubleType()
        change = F.when(
            cat == "A",
            F.concat(
                F.coalesce(cells.render(lnum, as_float), lshown),
                F.lit(texts.transition),
                F.coalesce(cells.render(rnum, as_float), rshown),
            ),
        ).otherwise(change)

    matched = (~lfilled & ~rfilled) | (both & F.coalesce(same, F.lit(False)))
    return (
        F.when((cat == "A") & matched, F.lit(texts.match))
        .when((cat == "A") & both & F.coalesce(near, F.lit(False)), F.lit(texts.in_tolerance))
        .otherwise(change)
    )


def _columns_table(left: DataFrame, right: DataFrame, lhead: list[str], rhead: list[str], pairs: list[ColumnPair],
                   shown: list[str], titles: list[str]) -> DataFrame:
    """One row per compared pair: where it comes from, how it is compared, and warnings."""
    ldup, rdup = _repeated(lhead), _repeated(rhead)
    rows = []
    for n, (p, title, column) in enumerate(zip(pairs, titles, shown)):
        warnings = []
        if not 0 <= p.left < len(lhead):
            warnings.append("original column is beyond the table")
        elif lhead[p.left] in ldup:
            warnings.append("original column name occurs more than once")
        if not 0 <= p.right < len(rhead):
            warnings.append("new column is beyond the table")
        elif rhead[p.right] in rdup:
            warnings.append("new column name occurs more than once")
        rows.append((n, p.left, p.right, p.compare, title, column, "\n".join(warnings)))
    schema = ("position int, original_index int, new_index int, compare_type int, title string, "
              "detail_column string, warnings string")
    return left.sparkSession.createDataFrame(rows, schema)


def _titles(pairs: list[ColumnPair], lhead: list[str], rhead: list[str], texts: Texts) -> list[str]:
    titles = []
    for p in pairs:
        old = lhead[p.left] if 0 <= p.left < len(lhead) else texts.missing_col
        new = rhead[p.right] if 0 <= p.right < len(rhead) else texts.missing_col
        titles.append(old if old == new else old + texts.transition + new)
    return titles


def reconcile(
    left: DataFrame,
    right: DataFrame,
    left_key: str | int = -1,
    right_key: str | int = -1,
    *,
    columns: list[ColumnPair | tuple] | None = None,
    order_by: list | tuple = (None, None),
    strip: bool = True,
    numeric_key: bool = True,
    tolerance: float = 0,
    texts: Texts = Texts(),
    zero_is_blank: bool = True,
    autogen_key_name: str = "Index [Autogen]",
    include_source: bool = True,
    ordered: bool = False,
    reuse_keys: bool = False,
) -> Tables:
    """Compare two versions of a table.

    Returns, lazily, ``detail`` (one row per key, one cell per column pair: match, in tolerance, or
    old --> new), ``duplicates in original``, ``duplicates in new``, ``summary`` (counts per key
    category), ``headers`` (unique and repeated column names), ``keys`` (each key with its
    category), ``columns`` (what was compared with what) and, on request, both prepared sources.

    A key of -1 means the row's number; that needs an order for the side in ``order_by`` (column
    names, together unique). ``numeric_key`` makes '001', 1 and '1.0' one key. ``zero_is_blank``
    treats 0 and False as blank. ``reuse_keys`` checkpoints the keyed rows once so that several
    of the returned tables do not read the sources again.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("tolerance must be at least 0 and less than 1")
    lhead, rhead = _header(left, strip), _header(right, strip)
    pairs = [p if isinstance(p, ColumnPair) else ColumnPair(*p) for p in columns] if columns is not None else None
    if pairs is None:
        pairs = positional_pairs(left, right)

    sides = []
    for df, head, key, order in ((left, lhead, left_key, order_by[0]), (right, rhead, right_key, order_by[1])):
        plain = df.toDF(*[f"c{i}" for i in range(len(head))])
        if key == -1 and not isinstance(key, bool):
            if not order:
                raise ValueError("a row-number key needs order_by for its side")
            wanted = [f"c{names.position(df, o)}" for o in order]
            position = f"c{len(head)}"
            plain = durable.with_row_number(plain, wanted, position)
            head = head + [autogen_key_name]
        else:
            position = f"c{names.position(df, key)}"
        plain = plain.select(*[
            (cells.strip(F.col(f.name)).alias(f.name) if strip and cells.is_text(f.dataType) else F.col(f.name))
            for f in plain.schema.fields
        ])
        sides.append((plain, head, position))
    (lplain, lhead, lpos), (rplain, rhead, rpos) = sides
    ltypes = [f.dataType for f in lplain.schema.fields]
    rtypes = [f.dataType for f in rplain.schema.fields]

    as_numbers = numeric_key or -1 in (left_key, right_key)
    if as_numbers:
        lkey, rkey = K.key_columns(lplain, rplain, lpos, rpos, numeric=True)
    else:
        lkey = cells.render(F.col(lpos), lplain.schema[lpos].dataType, "None")
        rkey = cells.render(F.col(rpos), rplain.schema[rpos].dataType, "None")

    lneeded = sorted({p.left for p in pairs if 0 <= p.left < len(ltypes)})
    rneeded = sorted({p.right for p in pairs if 0 <= p.right < len(rtypes)})

    def row(needed: list[int]) -> Column:
        return F.struct(*([F.col(f"c{i}") for i in needed] or [F.lit(0).alias("none")]))

    tagged = lplain.select(lkey.alias(K.KEY), F.lit(True).alias(_SIDE), row(lneeded).alias(_LEFT_ROW)).unionByName(
        rplain.select(rkey.alias(K.KEY), F.lit(False).alias(_SIDE), row(rneeded).alias(_RIGHT_ROW)),
        allowMissingColumns=True,
    )
    keyed = tagged.groupBy(K.KEY).agg(
        F.count_if(F.col(_SIDE)).alias(K.LEFT_ROWS),
        F.count_if(~F.col(_SIDE)).alias(K.RIGHT_ROWS),
        F.any_value(F.col(_LEFT_ROW), F.lit(True)).alias(_LEFT_ROW),
        F.any_value(F.col(_RIGHT_ROW), F.lit(True)).alias(_RIGHT_ROW),
    )
    keyed = keyed.withColumn(_CAT, K.category(F.col(K.LEFT_ROWS), F.col(K.RIGHT_ROWS)))
    if reuse_keys:
        keyed = durable.checkpointed(keyed)

    titles = _titles(pairs, lhead, rhead, texts)
    shown = names.unique_names(titles, reserved=("Key", "Key Category"))

    def detail() -> DataFrame:
        staged = keyed
        if any(p.compare == NUMERIC for p in pairs):
            # Texts to be compared as numbers are read once, in a projection of their own.
            numbers = {}
            for n, p in enumerate(pairs):
                if p.compare == NUMERIC:
                    for side, row_name, at, types in (("l", _LEFT_ROW, p.left, ltypes), ("r", _RIGHT_ROW, p.right, rtypes)):
                        if 0 <= at < len(types):
                            numbers[f"__{side}num_{n}"] = cells.as_double(F.col(row_name)[f"c{at}"], types[at])
            staged = keyed.select("*", *[c.alias(name) for name, c in numbers.items()])
        out = staged.select(
            F.col(K.KEY).alias("Key"),
            F.col(_CAT).alias("Key Category"),
            *[
                _cell_diff(n, p, ltypes, rtypes, texts, tolerance, zero_is_blank).alias(name)
                for n, (p, name) in enumerate(zip(pairs, shown))
            ],
        )
        return out.orderBy(F.col("Key Category").isin("C", "H"), "Key") if ordered else out

    found = keyed.select(F.col(K.KEY).alias("key"), F.col(_CAT).alias("category"))

    def duplicates(plain: DataFrame, key: Column, head: list[str], letters: str) -> DataFrame:
        bad = keyed.where(F.col(_CAT).isin(list(letters))).select(K.KEY, K.LEFT_ROWS)
        return (
            plain.withColumn("__stream_key", key)
            .join(bad, K.finds(F.col("__stream_key")), "left_semi")
            .drop("__stream_key")
            .toDF(*names.unique_names(head))
        )

    def headers() -> DataFrame:
        return left.sparkSession.createDataFrame(
            [
                ("Original header names, unique:", ", ".join(sorted(set(lhead) - _repeated(lhead)))),
                ("Original header names, non-unique:", ", ".join(sorted(_repeated(lhead)))),
                ("New header names, unique:", ", ".join(sorted(set(rhead) - _repeated(rhead)))),
                ("New header names, non-unique:", ", ".join(sorted(_repeated(rhead)))),
            ],
            "item string, names string",
        )

    result = {
        "detail": detail,
        "duplicates in original": lambda: duplicates(lplain, lkey, lhead, "DFG"),
        "duplicates in new": lambda: duplicates(rplain, rkey, rhead, "EFH"),
        "summary": lambda: K.summarize_keys(found),
        "headers": headers,
        "keys": lambda: found,
        "columns": lambda: _columns_table(left, right, lhead, rhead, pairs, shown, titles),
    }
    if include_source:
        result["original"] = lambda: lplain.toDF(*names.unique_names(lhead))
        result["new"] = lambda: rplain.toDF(*names.unique_names(rhead))
    return Tables(result)


def reconcile_guided(
    left: DataFrame,
    right: DataFrame,
    left_key: str | int = -1,
    right_key: str | int = -1,
    *,
    mode: str = "NAME",
    select: str = "AUTO-OR",
    columns: list[tuple] | None = None,
    sort: bool = False,
    strip: bool = True,
    **options,
) -> Tables:
    """:func:`reconcile` with the column pairs chosen by :func:`map_columns`.

    Adds ``Column Errors`` to the result if columns had to be left out.
    """
    pairs, errors = map_columns(left, right, mode, select, columns, strip, sort)
    result = reconcile(left, right, left_key, right_key, columns=pairs, strip=strip, **options)
    if errors:
        messages = [(e,) for e in errors]
        result = result.having(**{"Column Errors": lambda: left.sparkSession.createDataFrame(messages, "message string")})
    return result
