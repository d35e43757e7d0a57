"""Key analysis and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.join import join_tables
from ..operators.keys import CATEGORIES, key_analysis, key_set, summarize_keys
from . import tables as t

_LETTERS = ", ".join(f"('{letter}', '{text}')" for letter, text in CATEGORIES.items())
_KEY_COLUMNS = "k AS key, cat AS category, l AS left_rows, r AS right_rows"


def key_analysis_order_line(spark, sf):
    return key_analysis(t.load(spark, sf, "orders"), t.load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")


def key_analysis_long_double(spark, sf):
    """Whole keys above 2**53 against the same keys as DOUBLE, which holds only the even ones."""
    orders, lines = t.load(spark, sf, "orders"), t.load(spark, sf, "lineitem")
    return key_analysis(orders.select((F.col("o_orderkey") + F.lit(2**53)).alias("k")),
                        lines.select((F.col("l_orderkey") + F.lit(2**53)).cast("double").alias("k")), "k", "k")


def key_analysis_cust_order(spark, sf):
    return key_analysis(t.load(spark, sf, "orders"), t.load(spark, sf, "customer"), "o_custkey", "c_custkey")


def key_analysis_all_categories(spark, sf):
    return key_analysis(t.old_orders(spark, sf), t.new_orders(spark, sf), "o_orderkey", "o_orderkey")


def key_analysis_negative_list(spark, sf):
    """Orders missing from the new version, explained by a list of withdrawn (pending) orders of low priority."""
    negative = t.orders(spark, sf).where("o_orderstatus = 'P' AND o_orderpriority IN ('3-MEDIUM', '5-LOW')")
    return key_analysis(t.old_orders(spark, sf), t.new_orders(spark, sf), "o_orderkey", "o_orderkey",
                        negative=negative, negative_key="o_orderkey")


def key_set_left_only(spark, sf):
    return key_set(t.load(spark, sf, "orders"), t.load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "BG")


def key_summary(spark, sf):
    keys = key_analysis(t.old_orders(spark, sf), t.new_orders(spark, sf), "o_orderkey", "o_orderkey")
    return summarize_keys(keys)


def _join(kind):
    def run(spark, sf):
        return join_tables(t.old_orders(spark, sf), t.new_orders(spark, sf), kind, "o_orderkey", "o_orderkey")["joined"]

    return run


def join_lookup(spark, sf):
    """Every line of an order looked up in the orders table."""
    lines = t.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = t.orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderpriority")
    return join_tables(lines, orders, "base", "l_orderkey", "o_orderkey", as_text=False)["joined"]


def join_orders_customers(spark, sf):
    """The flagship: orders looked up against customers, with key code."""
    orders = t.orders(spark, sf).select("o_orderkey", "o_custkey", "cents")
    customers = t.load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return join_tables(orders, customers, "base", "o_custkey", "c_custkey")["joined"]


def join_negative_list(spark, sf):
    negative = t.orders(spark, sf).where("o_orderstatus = 'P' AND o_orderpriority IN ('3-MEDIUM', '5-LOW')")
    old = t.old_orders(spark, sf).select("o_orderkey", "cents")
    new = t.new_orders(spark, sf).select("o_orderkey", "cents")
    return join_tables(old, new, "base", 0, 0, negative=negative, negative_key="o_orderkey")["joined"]


def join_unmatched(spark, sf):
    new = t.new_orders(spark, sf).select("o_orderkey", "o_custkey", "cents")
    return join_tables(t.old_orders(spark, sf), new, "base", "o_orderkey", "o_orderkey")["unmatched"]


def join_all_keys(spark, sf):
    return join_tables(t.old_orders(spark, sf), t.new_orders(spark, sf), "restrictive", 0, 0)["all_keys"]


QUERIES = {
    "key_analysis_order_line": key_analysis_order_line,
    "key_analysis_long_double": key_analysis_long_double,
    "key_analysis_cust_order": key_analysis_cust_order,
    "key_analysis_all_categories": key_analysis_all_categories,
    "key_analysis_negative_list": key_analysis_negative_list,
    "key_set_left_only": key_set_left_only,
    "key_summary": key_summary,
    "join_restrictive": _join("restrictive"),
    "join_base": _join("base"),
    "join_promiscuous": _join("promiscuous"),
    "join_lookup": join_lookup,
    "join_orders_customers": join_orders_customers,
    "join_negative_list": join_negative_list,
    "join_unmatched": join_unmatched,
    "join_all_keys": join_all_keys,
}

_OLD_NEW = t.counted("old_orders", "new_orders", "o_orderkey", "o_orderkey")
_NEGATIVE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('3-MEDIUM', '5-LOW')"
_EXPLAINED = f"""CASE WHEN cat NOT IN ('B', 'G') THEN 'n/a' WHEN k IN ({_NEGATIVE}) THEN 'Yes' ELSE 'No' END"""
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "cents"]


def _text(side: str, column: str) -> str:
    value = f"{side}.{column}"
    return t.STAMP.format(value) if column == "o_orderdate" else f"CAST({value} AS VARCHAR)"


def _cells(side: str, tag: str, missing: str = "", ambiguous: str = "") -> str:
    """Cells of one side as text, with placeholders where the category says so."""
    out = []
    for c in _COLUMNS:
        value = _text(side, c)
        if missing or ambiguous:
            value = (
                f"CASE WHEN cat IN ({missing}) THEN '-no match-' WHEN cat IN ({ambiguous}) THEN '-ambiguous-' "
                f"ELSE {value} END"
            )
        out.append(f'{value} AS "{tag}{c}"')
    return ", ".join(out)


_LEAD = 'k AS "Key", cat AS "Key Code"'
_FROM_OLD = "FROM old_orders o JOIN counted ON k = o.o_orderkey LEFT JOIN new_orders n ON n.o_orderkey = k AND r = 1"
_FROM_NEW = "FROM new_orders n JOIN counted ON k = n.o_orderkey LEFT JOIN old_orders o ON o.o_orderkey = k AND l = 1"
_BASE_CELLS = f"""{_cells("o", "_ORIG_")}, {_cells("n", "_JOINED_", "'B','G'", "'E','F'")}"""
_EXT_CELLS = f"""{_cells("o", "_ORIG_", "'C','H'", "'F'")}, {_cells("n", "_JOINED_")}"""

SQL = {
    "key_analysis_order_line": f"WITH {t.counted('orders', 'lineitem', 'o_orderkey', 'l_orderkey')} SELECT {_KEY_COLUMNS} FROM counted",
    "key_analysis_long_double": f"""WITH {t.counted('orders', 'lineitem', 'CAST(o_orderkey + 9007199254740992 AS VARCHAR)',
        'CAST(CAST(CAST(l_orderkey + 9007199254740992 AS DOUBLE) AS BIGINT) AS VARCHAR)')} SELECT {_KEY_COLUMNS} FROM counted""",
    "key_analysis_cust_order": f"WITH {t.counted('orders', 'customer', 'o_custkey', 'c_custkey')} SELECT {_KEY_COLUMNS} FROM counted",
    "key_analysis_all_categories": f"WITH {t.VERSIONS}, {_OLD_NEW} SELECT {_KEY_COLUMNS} FROM counted",
    "key_analysis_negative_list": f"WITH {t.VERSIONS}, {_OLD_NEW} SELECT {_KEY_COLUMNS}, {_EXPLAINED} AS explained FROM counted",
    "key_set_left_only": f"""WITH {t.counted('orders', 'lineitem', 'o_orderkey', 'l_orderkey')}
        SELECT k AS key, cat AS category FROM counted WHERE cat IN ('B', 'G')""",
    "key_summary": f"""WITH {t.VERSIONS}, {_OLD_NEW},
        letters(category, description) AS (VALUES {_LETTERS})
        SELECT category, description, count(k) AS keys_found FROM letters LEFT JOIN counted ON cat = category GROUP BY category, description""",
    "join_restrictive": f"WITH {t.VERSIONS}, {_OLD_NEW} SELECT {_LEAD}, {_BASE_CELLS} {_FROM_OLD} WHERE cat IN ('A', 'D')",
    "join_base": f"WITH {t.VERSIONS}, {_OLD_NEW} SELECT {_LEAD}, {_BASE_CELLS} {_FROM_OLD}",
    "join_promiscuous": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT {_LEAD}, {_BASE_CELLS} {_FROM_OLD} WHERE cat <> 'E'
        UNION ALL SELECT {_LEAD}, {_EXT_CELLS} {_FROM_NEW} WHERE cat IN ('C', 'E', 'F', 'H')""",
    "join_lookup": f"""WITH {t.ORDERS}, {t.counted('lineitem', 'orders', 'l_orderkey', 'o_orderkey')}
        SELECT k AS "Key", cat AS "Key Code", l_orderkey AS "_ORIG_l_orderkey", l_linenumber AS "_ORIG_l_linenumber",
               l_quantity AS "_ORIG_l_quantity", o_orderkey AS "_JOINED_o_orderkey", o_custkey AS "_JOINED_o_custkey",
               o_orderpriority AS "_JOINED_o_orderpriority"
        FROM lineitem JOIN counted ON k = l_orderkey LEFT JOIN orders_c ON o_orderkey = k AND r = 1""",
    "join_orders_customers": f"""WITH {t.ORDERS}, {t.counted('orders', 'customer', 'o_custkey', 'c_custkey')}
        SELECT k AS "Key", cat AS "Key Code", CAST(o_orderkey AS VARCHAR) AS "_ORIG_o_orderkey",
               CAST(o_custkey AS VARCHAR) AS "_ORIG_o_custkey", CAST(cents AS VARCHAR) AS "_ORIG_cents",
               coalesce(CAST(c_custkey AS VARCHAR), '-no match-') AS "_JOINED_c_custkey",
               coalesce(c_name, '-no match-') AS "_JOINED_c_name", coalesce(c_mktsegment, '-no match-') AS "_JOINED_c_mktsegment"
        FROM orders_c JOIN counted ON k = o_custkey LEFT JOIN customer ON c_custkey = k""",
    "join_negative_list": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT k AS "Key", cat AS "Key Code", {_EXPLAINED} AS "Explained by negative list",
               CAST(o.o_orderkey AS VARCHAR) AS "_ORIG_o_orderkey", CAST(o.cents AS VARCHAR) AS "_ORIG_cents",
               CASE WHEN cat IN ('B','G') THEN '-no match-' WHEN cat IN ('E','F') THEN '-ambiguous-'
                    ELSE CAST(n.o_orderkey AS VARCHAR) END AS "_JOINED_o_orderkey",
               CASE WHEN cat IN ('B','G') THEN '-no match-' WHEN cat IN ('E','F') THEN '-ambiguous-'
                    ELSE CAST(n.cents AS VARCHAR) END AS "_JOINED_cents"
        {_FROM_OLD}""",
    "join_unmatched": f"""WITH {t.VERSIONS}, {_OLD_NEW}
        SELECT o_orderkey, o_custkey, cents FROM new_orders JOIN counted ON k = o_orderkey WHERE cat IN ('C','E','F','H')""",
    "join_all_keys": f"""WITH {t.VERSIONS}, {_OLD_NEW} SELECT cat AS "Key Analysis Result", k AS "Key" FROM counted""",
}
