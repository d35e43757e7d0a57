"""Reconciling the two versions of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.keys import CATEGORIES
from ..operators.reconcile import ColumnPair, reconcile, reconcile_guided
from . import tables as t

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "cents"]


def _versions(spark, sf):
    return t.old_orders(spark, sf), t.new_orders(spark, sf)


def _part(name, **options):
    def run(spark, sf):
        return reconcile(*_versions(spark, sf), "o_orderkey", "o_orderkey", **options)[name]

    return run


def numeric_key(spark, sf):
    """Keys padded with zeros on one side and with decimals on the other."""
    old, new = _versions(spark, sf)
    old = old.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), "cents")
    new = new.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".00")).alias("id"), "cents")
    return reconcile(old, new, "id", "id", columns=[(1, 1, 1)])["detail"]


def text_key(spark, sf):
    old, new = _versions(spark, sf)
    old = old.select(F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("id"), "o_orderpriority")
    new = new.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    return reconcile(old, new, "id", "id", numeric_key=False, columns=[(1, 1)])["detail"]


def columns_by_name(spark, sf):
    """Columns in another order, one renamed and one dropped, matched by name."""
    old, new = _versions(spark, sf)
    new = new.select("cents", "o_orderpriority", F.col("o_custkey").alias("customer"), "o_orderkey")
    old = old.select("o_orderkey", "o_custkey", "o_orderpriority", "cents")
    return reconcile_guided(old, new, "o_orderkey", "o_orderkey", mode="NAME", select="AUTO-OR")["detail"]


def columns_by_list(spark, sf):
    old, new = _versions(spark, sf)
    return reconcile_guided(old, new, "o_orderkey", "o_orderkey", select="LIST", tolerance=0.05,
                            columns=[("cents", "cents", 1), ("o_orderstatus", "o_orderpriority", 0)])["detail"]


def row_number_key(spark, sf):
    """Two tables without a key, row by row in their order."""
    left = t.load(spark, sf, "customer").select("c_name", "c_mktsegment", "c_custkey")
    right = left.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "HOUSES").otherwise(F.col("c_mktsegment")))
    return reconcile(left, right, order_by=(["c_custkey"], ["c_custkey"]), columns=[ColumnPair(0, 0), ColumnPair(1, 1)])["detail"]


def missing_counterpart(spark, sf):
    """A column compared as a number that the new version does not have."""
    old, new = _versions(spark, sf)
    return reconcile(old.select("o_orderkey", "cents"), new.select("o_orderkey"), "o_orderkey", "o_orderkey", columns=[ColumnPair(1, -1, 1)])["detail"]


QUERIES = {
    "reconcile_missing_counterpart": missing_counterpart,
    "reconcile_detail": _part("detail"),
    "reconcile_tolerance": _part("detail", tolerance=0.05),
    "reconcile_duplicates_left": _part("duplicates in original"),
    "reconcile_duplicates_right": _part("duplicates in new"),
    "reconcile_summary": _part("summary"),
    "reconcile_keys": _part("keys"),
    "reconcile_numeric_key": numeric_key,
    "reconcile_text_key": text_key,
    "reconcile_columns_by_name": columns_by_name,
    "reconcile_columns_by_list": columns_by_list,
    "reconcile_row_number_key": row_number_key,
}

_LETTERS = ", ".join(f"('{letter}', '{text}')" for letter, text in CATEGORIES.items())
_OLD_NEW = t.counted("old_orders", "new_orders", "o_orderkey", "o_orderkey")


def _shown(value: str, number: bool = False) -> str:
    blank = f"{value} IS NULL OR {value} = 0" if number else f"{value} IS NULL OR {value} = ''"
    return f"CASE WHEN {blank} THEN '<blank>' ELSE CAST({value} AS VARCHAR) END"


def _cell(left: str | None, right: str | None, title: str, number: bool = False, near: str | None = None,
          same: str | None = None, left_text: str | None = None, right_text: str | None = None) -> str:
    """The detail cell of one pair, written out."""
    lt = left_text or (_shown(left, number) if left else "'<missing col>'")
    rt = right_text or (_shown(right, number) if right else "'<missing col>'")
    lt = f"CASE WHEN cat IN ('C','H') THEN '<missing record>' WHEN cat IN ('D','F','G') THEN '<ambiguous>' ELSE {lt} END"
    rt = f"CASE WHEN cat IN ('B','G') THEN '<missing record>' WHEN cat IN ('E','F','H') THEN '<ambiguous>' ELSE {rt} END"
    same = same or (f"{left} IS NOT DISTINCT FROM {right}" if left and right else "FALSE")
    band = f"WHEN cat = 'A' AND ({near}) THEN '--' " if near else ""
    return f"""CASE WHEN cat = 'A' AND ({same}) THEN '-' {band}ELSE ({lt}) || ' --> ' || ({rt}) END AS "{title}" """


_JOINED = """FROM counted LEFT JOIN old_orders o ON o.o_orderkey = k AND l = 1
  LEFT JOIN new_orders n ON n.o_orderkey = k AND r = 1"""
_NEAR = """o.{c} <> 0 AND n.{c} <> 0 AND (greatest(o.{c}, n.{c})::DOUBLE * (1.0::DOUBLE - 0.05::DOUBLE) <= least(o.{c}, n.{c})::DOUBLE
  OR least(o.{c}, n.{c})::DOUBLE * (1.0::DOUBLE + 0.05::DOUBLE) >= greatest(o.{c}, n.{c})::DOUBLE)"""


def _detail(tolerance: bool) -> str:
    out = []
    for c in _COLUMNS:
        if c == "o_orderdate":
            out.append(_cell(f"o.{c}", f"n.{c}", c, left_text=t.STAMP.format(f"o.{c}"), right_text=t.STAMP.format(f"n.{c}")))
        elif c in ("o_orderstatus", "o_orderpriority"):
            out.append(_cell(f"o.{c}", f"n.{c}", c))
        else:
            out.append(_cell(f"o.{c}", f"n.{c}", c, True, _NEAR.format(c=c) if tolerance else None))
    return f'WITH {t.VERSIONS}, {_OLD_NEW} SELECT k AS "Key", cat AS "Key Category", {", ".join(out)} {_JOINED}'


_FLOAT = "CASE WHEN {0} = 0 THEN '<blank>' WHEN cat = 'A' THEN CAST({0} AS VARCHAR) || '.0' ELSE CAST({0} AS VARCHAR) END"

SQL = {
    "reconcile_missing_counterpart": f"""WITH {t.VERSIONS}, {_OLD_NEW} SELECT k AS "Key", cat AS "Key Category",
        {_cell("o.cents", None, "cents --> <missing col>", True, left_text=_FLOAT.format("o.cents"))} {_JOINED}""",
    "reconcile_detail": _detail(False),
    "reconcile_tolerance": _detail(True),
    "reconcile_duplicates_left": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT {", ".join(_COLUMNS)} FROM old_orders JOIN counted ON k = o_orderkey WHERE l > 1""",
    "reconcile_duplicates_right": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT {", ".join(_COLUMNS)} FROM new_orders JOIN counted ON k = o_orderkey WHERE r > 1""",
    "reconcile_summary": f"""WITH {t.VERSIONS}, {_OLD_NEW},
        letters(category, description) AS (VALUES {_LETTERS})
        SELECT category, description, count(k) AS keys_found FROM letters LEFT JOIN counted ON cat = category GROUP BY category, description""",
    "reconcile_keys": f"WITH {t.VERSIONS}, {_OLD_NEW} SELECT k AS key, cat AS category FROM counted",
    "reconcile_numeric_key": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT CAST(k AS VARCHAR) AS "Key", cat AS "Key Category",
               {_cell("o.cents", "n.cents", "cents", True, left_text=_FLOAT.format("o.cents"), right_text=_FLOAT.format("n.cents"))}
        {_JOINED}""",
    "reconcile_text_key": f"""WITH {t.VERSIONS},
        padded AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS id, o_orderpriority FROM old_orders),
        plain AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority FROM new_orders),
        {t.counted("padded", "plain", "id", "id")}
        SELECT k AS "Key", cat AS "Key Category", {_cell("o.o_orderpriority", "n.o_orderpriority", "o_orderpriority")}
        FROM counted LEFT JOIN padded o ON o.id = k AND l = 1 LEFT JOIN plain n ON n.id = k AND r = 1""",
    "reconcile_columns_by_name": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT k AS "Key", cat AS "Key Category", {_cell("o.o_orderkey", "n.o_orderkey", "o_orderkey", True)},
               {_cell("o.o_custkey", None, "o_custkey --> <missing col>", True)},
               {_cell("o.o_orderpriority", "n.o_orderpriority", "o_orderpriority")},
               {_cell("o.cents", "n.cents", "cents", True)},
               {_cell(None, "n.o_custkey", "<missing col> --> customer", True)}
        {_JOINED}""",
    "reconcile_columns_by_list": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT k AS "Key", cat AS "Key Category",
               {_cell("o.cents", "n.cents", "cents", True, _NEAR.format(c="cents"), left_text=_FLOAT.format("o.cents"), right_text=_FLOAT.format("n.cents"))},
               {_cell("o.o_orderstatus", "n.o_orderpriority", "o_orderstatus --> o_orderpriority")}
        {_JOINED}""",
    "reconcile_row_number_key": """
        SELECT row_number() OVER (ORDER BY c_custkey) AS "Key", 'A' AS "Key Category", '-' AS c_name,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING --> HOUSES' ELSE '-' END AS c_mktsegment
        FROM customer""",
}
