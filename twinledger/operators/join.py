"""Joins that never multiply ambiguous rows.

The joined side is reduced to one row per key (its count, and the row itself where the count is 1)
*before* the join, so an n:m key cannot explode. The table that streams through is the left side of
a null-safe left join: its rows are shuffled once or, if the keys turn out small, not at all, and
adaptive execution can split a hot key's partition because a left join may split its left side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, names
from ..plans import durable
from ..plans.lazy import Tables
from . import keys as K

JOIN_TYPES = ("restrictive", "base", "promiscuous")

_BASE_ROW, _EXT_ROW, _CAT = "__base_row", "__ext_row", "__category"


def _row(df: DataFrame, fields: list[str]) -> Column:
    return F.struct(*[names.col(c).alias(f) for c, f in zip(df.columns, fields)])


def _key_index(base: DataFrame, ext: DataFrame, bkey: Column, ekey: Column, *, with_base: bool, with_ext: bool,
               negative: DataFrame | None = None, nkey: Column | None = None) -> DataFrame:
    """One row per key of either table: counts, category, and the rows of whichever side is needed."""
    base_fields = [f"b{i}" for i in range(len(base.columns))]
    ext_fields = [f"e{i}" for i in range(len(ext.columns))]
    parts = [
        K.tally(base, bkey, K.LEFT_ROWS, {_BASE_ROW: _row(base, base_fields)} if with_base else None),
        K.tally(ext, ekey, K.RIGHT_ROWS, {_EXT_ROW: _row(ext, ext_fields)} if with_ext else None),
    ]
    if negative is not None:
        parts.append(K.tally(negative, nkey, K.NEGATIVE_ROWS))
    merged = K.merge_tallies(parts)
    return merged.withColumn(_CAT, K.category(F.col(K.LEFT_ROWS), F.col(K.RIGHT_ROWS)))


def _output_names(base: DataFrame, ext: DataFrame, base_tag: str, ext_tag: str) -> tuple[list[str], list[str]]:
    tagged = [base_tag + c for c in base.columns] + [ext_tag + c for c in ext.columns]
    tagged = names.unique_names(tagged, reserved=("Key", "Key Code", "Explained by negative list"))
    return tagged[: len(base.columns)], tagged[len(base.columns):]


def join_tables(
    base: DataFrame,
    ext: DataFrame,
    join_type: str,
    base_key: str | int,
    ext_key: str | int,
    *,
    negative: DataFrame | None = None,
    negative_key: str | int = 0,
    base_tag: str = "_ORIG_",
    ext_tag: str = "_JOINED_",
    no_match_text: str = "-no match-",
    ambiguous_text: str = "-ambiguous-",
    as_text: bool = True,
    all_keys: bool = True,
    unmatched: bool = True,
    unmatched_name: str = "unmatched",
    numeric_key: bool = False,
    reuse_keys: bool = False,
) -> Tables:
    """Join two tables by one key each.

    * ``restrictive``: base rows whose key is unique in ``ext`` (categories A, D).
    * ``base``: every base row once; ``no_match_text`` where the key is missing (B, G),
      ``ambiguous_text`` where it is not unique in ``ext`` (E, F).
    * ``promiscuous``: every row of both tables. E is told from the ext side with the one base row
      repeated; C and H have no base row; F appears from both sides with the other side ambiguous.

    Returns ``joined``, ``all_keys`` (unless switched off) and, for base joins, the ext rows that
    found no place (C, E, F, H). With ``as_text`` all carried columns become text so that a cell can
    hold either a value or a placeholder; without it the columns keep their types, placeholders
    become NULL, and the key code tells why. ``reuse_keys`` checkpoints the key table once, which
    pays off when more than one of the returned tables is used and lets a small key table be
    broadcast after its rows were counted.
    """
    if join_type not in JOIN_TYPES:
        raise ValueError(f"join_type must be one of {JOIN_TYPES}, not {join_type!r}")
    bkey, ekey = K.key_columns(base, ext, base_key, ext_key, numeric_key)
    nkey = None
    if negative is not None:
        key_type = base.select(bkey).schema[0].dataType
        nkey = K.negative_column(base, negative, base_key, negative_key, numeric_key, key_type)
    index = _key_index(base, ext, bkey, ekey, with_base=join_type == "promiscuous", with_ext=True,
                       negative=negative, nkey=nkey)
    if reuse_keys:
        index = durable.broadcast_if_small(durable.checkpointed(index))

    base_names, ext_names = _output_names(base, ext, base_tag, ext_tag)
    base_types = [f.dataType for f in base.schema.fields]
    ext_types = [f.dataType for f in ext.schema.fields]

    def present(cell: Column, dtype) -> Column:
        return cells.render(cell, dtype) if as_text else cell

    def placeholder(cat: Column, missing: str, ambiguous: str, otherwise: Column, dtype) -> Column:
        if not as_text:
            return F.when(~cat.isin(list(missing + ambiguous)), otherwise)
        return (
            F.when(cat.isin(list(missing)), F.lit(no_match_text))
            .when(cat.isin(list(ambiguous)), F.lit(ambiguous_text))
            .otherwise(present(otherwise, dtype))
        )

    cat = F.col(_CAT)
    lead = [F.col(K.KEY).alias("Key"), cat.alias("Key Code")]
    if negative is not None:
        lead.append(K.explained(cat, F.col(K.NEGATIVE_ROWS)).alias("Explained by negative list"))

    base_fields = [f"b{i}" for i in range(len(base.columns))]
    ext_fields = [f"e{i}" for i in range(len(ext.columns))]

    ext_stream = ext.select(ekey.alias("__stream_key"), *[names.col(c).alias(f) for c, f in zip(ext.columns, ext_fields)])

    def seen_from_base() -> DataFrame:
        stream = base.select(
            bkey.alias("__stream_key"), *[names.col(c).alias(f) for c, f in zip(base.columns, base_fields)]
        )
        side = index.drop(_BASE_ROW)
        if join_type == "restrictive":
            side = side.where(cat.isin("A", "D"))
        how = "inner" if join_type == "restrictive" else "left"
        matched = stream.join(side, K.finds(F.col("__stream_key")), how)
        if join_type == "promiscuous":
            matched = matched.where(cat != "E")
        return matched.select(
            *lead,
            *[present(F.col(f), t).alias(n) for f, t, n in zip(base_fields, base_types, base_names)],
            *[
                placeholder(cat, "BG", "EF", F.col(_EXT_ROW)[f], t).alias(n)
                for f, t, n in zip(ext_fields, ext_types, ext_names)
            ],
        )

    def seen_from_ext() -> DataFrame:
        left_over = index.drop(_EXT_ROW).where(cat.isin(list("CEFH")))
        rest = ext_stream.join(left_over, K.finds(F.col("__stream_key")), "inner")
        return rest.select(
            *lead,
            *[
                placeholder(cat, "CH", "F", F.col(_BASE_ROW)[f], t).alias(n)
                for f, t, n in zip(base_fields, base_types, base_names)
            ],
            *[present(F.col(f), t).alias(n) for f, t, n in zip(ext_fields, ext_types, ext_names)],
        )

    def joined() -> DataFrame:
        return seen_from_base().unionByName(seen_from_ext()) if join_type == "promiscuous" else seen_from_base()

    def keys() -> DataFrame:
        found = index if negative is None else index.where((F.col(K.LEFT_ROWS) > 0) | (F.col(K.RIGHT_ROWS) > 0))
        return found.select(cat.alias("Key Analysis Result"), F.col(K.KEY).alias("Key"))

    def loose_rows() -> DataFrame:
        loose = index.where(cat.isin(list("CEFH"))).select(K.KEY, K.LEFT_ROWS)
        kept = ext_stream.join(loose, K.finds(F.col("__stream_key")), "left_semi")
        return kept.select(*[F.col(f).alias(n) for f, n in zip(ext_fields, names.unique_names(ext.columns))])

    result = {"joined": joined}
    if all_keys:
        result["all_keys"] = keys
    if unmatched and join_type == "base":
        result[unmatched_name] = loose_rows
    return Tables(result)
