"""Aggregate specifications: the 36 kinds, their options, and checking them before any planning."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..functions import names

# Option defaults and the texts shown for cells that have no value.
_NON_NUMERIC, _ALL_EMPTY = "-Non-numeric-", "-All empty-"
_NON_BOOLEAN, _NON_TEXT = "-Non-boolean value found-", "-Field(s) without text data-"
_DUPLICATES, _NOT_FOUND = "-Duplicate entries-", "<No record found>"

_NUMBERS = {"ignore_non_numbers": False, "non_numbers_text": _NON_NUMERIC, "ignore_empty": True,
            "empty_text": _ALL_EMPTY}
_BOOLEANS = {"allow_yn": True, "allow_01": True, "allow_tf": True, "ignore_blanks": False,
             "invalid_text": _NON_BOOLEAN}
_LENGTHS = {"strip": True, "non_text_message": _NON_TEXT, "empty_text": _ALL_EMPTY}
_STRIP = {"strip": True}

# Kind -> options of the plain aggregate, and what the per-category form adds (None: no such form).
_KINDS: dict[str, tuple[dict[str, Any], dict[str, Any] | None]] = {
    "concatenate": ({"strip": True, "link_text": ", "}, None),
    "concatenate_unique": ({"strip": True, "link_text": ", "}, None),
    "and": (_BOOLEANS, _STRIP),
    "or": (_BOOLEANS, _STRIP),
    "count_nonempty": (_STRIP, {}),
    "count_all": ({}, _STRIP),
    "count_unique": (_STRIP, {}),
    "sum": (_NUMBERS, None),
    "min": (_NUMBERS, _STRIP),
    "max": (_NUMBERS, _STRIP),
    "average": (_NUMBERS, _STRIP),
    "are_same": (_STRIP, {"not_found_text": _NOT_FOUND}),
    "min_text_length": (_LENGTHS, {}),
    "max_text_length": (_LENGTHS, {}),
    "avg_text_length": (_LENGTHS, {}),
    "all_filled": (_STRIP, {}),
    "some_filled": (_STRIP, {}),
    "none_filled": (_STRIP, {}),
}

PLAIN_TYPES = list(_KINDS)
_CATEGORY_ONLY = {
    "category": {"allow_duplicates_if_equal": False, "duplicates_text": _DUPLICATES},
    "category-sum": {"ignore_non_numbers": False, "non_numbers_text": _NON_NUMERIC},
    "category-concat-unique": {"link_text": ", "},
}
DEFAULT_OPTIONS: dict[str, dict[str, Any]] = {kind: dict(options) for kind, (options, _) in _KINDS.items()}
DEFAULT_OPTIONS |= {kind: {"cat_key_col": -1, **options} for kind, options in _CATEGORY_ONLY.items()}
DEFAULT_OPTIONS |= {
    "category-" + kind.replace("_", "-"): {"cat_key_col": -1, **options, **extra}
    for kind, (options, extra) in _KINDS.items()
    if extra is not None
}
CATEGORY_TYPES = [kind for kind in DEFAULT_OPTIONS if kind.startswith("category")]
AGG_TYPES = CATEGORY_TYPES + PLAIN_TYPES


@dataclass(frozen=True)
class AggSpec:
    """One aggregate: its kind, the column it reads, the options that differ from the defaults, a name.

    Category kinds need ``cat_key_col`` among the options; ``categories`` may list the category
    values to make columns of, which saves the pass that looks for them.
    """

    agg_type: str
    agg_col: str | int
    agg_name: str | None = None
    agg_options: dict[str, Any] = field(default_factory=dict)

    @property
    def by_category(self) -> bool:
        return self.agg_type.startswith("category")

    @property
    def kind(self) -> str:
        """Kind without the category part: category-min-text-length -> min_text_length."""
        if self.agg_type == "category":
            return "single"
        if self.agg_type == "category-sum":
            return "category_sum"
        if self.agg_type == "category-concat-unique":
            return "concatenate_unique"
        return self.agg_type.removeprefix("category-").replace("-", "_")


def spec_all(df: DataFrame, agg_type: str, options: dict[str, Any] | None = None) -> list[AggSpec]:
    """The same aggregate over every column of a table."""
    return [
        AggSpec(agg_type, c, f"{n} - {agg_type} - {c}", dict(options or {})) for n, c in enumerate(df.columns)
    ]


def check_specs(df: DataFrame, specs: list[AggSpec | dict[str, Any]], on_error: str = "skip") -> list[AggSpec]:
    """Resolve columns, fill in option defaults and names; leave out or raise for what cannot run."""
    if on_error not in ("skip", "raise"):
        raise ValueError("on_error must be 'skip' or 'raise'")
    checked: list[AggSpec] = []
    for n, given in enumerate(specs):
        spec = given if isinstance(given, AggSpec) else AggSpec(**given)
        try:
            if spec.agg_type not in DEFAULT_OPTIONS:
                raise ValueError(f"aggregation type {spec.agg_type!r} is not available")
            allowed = {*DEFAULT_OPTIONS[spec.agg_type], "categories"}
            unknown = sorted(set(spec.agg_options) - allowed)
            if unknown:
                raise ValueError(f"{spec.agg_type} has no options {unknown}")
            column = names.resolve(df, spec.agg_col)
            options = {**DEFAULT_OPTIONS[spec.agg_type], **spec.agg_options}
            if spec.by_category:
                if options["cat_key_col"] == -1:
                    raise ValueError(f"{spec.agg_type} needs cat_key_col")
                options["cat_key_col"] = names.resolve(df, options["cat_key_col"])
        except (ValueError, KeyError, IndexError, TypeError) as exc:
            if on_error == "raise":
                raise
            warnings.warn(f"aggregation spec {n} skipped: {exc}", stacklevel=3)
            continue
        checked.append(AggSpec(spec.agg_type, column, spec.agg_name or f"{n} - {spec.agg_type} - {column}", options))
    return checked
