"""Row-wise column checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compare import Check, compare_columns, compare_many, with_constants
from ..operators.join import join_tables
from . import tables as t


def _paired(spark, sf):
    """Orders that both versions can tell, side by side."""
    return join_tables(t.old_orders(spark, sf), t.new_orders(spark, sf), "restrictive", "o_orderkey", "o_orderkey",
                       base_tag="old_", ext_tag="new_", as_text=False)["joined"]


def compare_text(spark, sf):
    return compare_columns(_paired(spark, sf), "old_o_orderpriority", "new_o_orderpriority", fail_detail=True,
                           new_col_name="check").select("Key", "check")


def compare_text_options(spark, sf):
    left = t.load(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t")).alias("a"),
        F.when(F.col("p_type") == "PROMO", None).otherwise(F.col("p_name")).alias("b"))
    return compare_columns(left, "a", "b", strip_text_fields=True, case_sensitive=False, require_nonblank=True,
                           fail_detail=True, new_col_name="check").select("p_partkey", "check")


def compare_numeric(spark, sf):
    """Stored text length against the real one, the one as text and the other as number."""
    documents = t.load(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", F.concat("n_chars", F.lit(" chars"))).otherwise(F.col("n_chars").cast("string")).alias("stated"),
        F.when(F.col("lang") == "de", F.length("text") + 1).otherwise(F.length("text")).alias("real"))
    return compare_columns(documents, "stated", "real", "numerical", conv_text_to_num=True, fail_detail=True,
                           new_col_name="check").select("doc_id", "check")


def compare_tolerance(spark, sf):
    return compare_columns(_paired(spark, sf), "old_cents", "new_cents", "numerical", tolerance=0.05, fail_detail=True,
                           new_col_name="check").select("Key", "check")


def compare_date(spark, sf):
    return compare_columns(_paired(spark, sf), "old_o_orderdate", "new_o_orderdate", "date", fail_detail=True,
                           new_col_name="check").select("Key", "check")


def compare_date_text(spark, sf):
    """Ship dates as text in another format than the order dates."""
    lines = t.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "dd.MM.yyyy").alias("ship"),
        F.when(F.col("l_returnflag") == "R", F.date_format("l_shipdate", "yyyy/MM/dd"))
        .when(F.col("l_returnflag") == "A", F.lit("unknown"))
        .otherwise(F.date_format(F.expr("l_shipdate + INTERVAL 1 DAY"), "yyyy/MM/dd")).alias("other"))
    return compare_columns(lines, "ship", "other", "date", convert_dates=True, first_date_format="%d.%m.%Y",
                           second_date_format="%Y/%m/%d", new_col_name="check").groupBy("check").agg(F.count(F.lit(1)).alias("records"))


def compare_serial_date(spark, sf):
    """Spreadsheet day numbers against dates."""
    orders = t.orders(spark, sf).select(
        "o_orderkey", "o_orderdate", F.date_diff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date")).alias("serial"))
    return compare_columns(orders, "serial", "o_orderdate", "date", convert_dates=True, new_col_name="check").select("o_orderkey", "check")


def compare_expr(spark, sf):
    lines = t.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return compare_columns(lines, "l_quantity", "l_extendedprice", "numerical", first_col_conv="{x} * 1500", tolerance=0.2,
                           new_col_name="check").groupBy("check").agg(F.count(F.lit(1)).alias("records"))


def compare_nonzero(spark, sf):
    lines = t.load(spark, sf, "lineitem")
    return compare_columns(lines, "l_discount", "l_tax", "numerical", require_nonzero=True, new_col_name="check") \
        .groupBy("check").agg(F.count(F.lit(1)).alias("records"))


def _specs():
    return [
        Check("old_o_orderpriority", "new_o_orderpriority", new_col_name="priority"),
        Check("old_o_orderstatus", "new_o_orderstatus", new_col_name="status", require_nonblank=True),
        Check("old_cents", "new_cents", "numerical", tolerance=0.05, new_col_name="price"),
        Check("old_cents", "new_o_orderstatus", "numerical", new_col_name="mixed"),
        Check("old_o_orderdate", "new_o_orderdate", "date", new_col_name="day"),
        Check("old_nothing", "new_cents", new_col_name="missing"),
    ]


def compare_many_table(spark, sf):
    checked = compare_many(_paired(spark, sf), _specs())
    return checked.table.select("Key", *checked.checks)


def compare_many_summary(spark, sf):
    return compare_many(_paired(spark, sf), _specs()).summary()


def compare_constant(spark, sf):
    specs = [{"first_col": "**CONST str BUILDING", "second_col": "c_mktsegment", "new_col_name": "check"}]
    customers = with_constants(t.load(spark, sf, "customer"), specs)
    return compare_many(customers, specs).table.select("c_custkey", "check")


def compare_skips_bad_checks(spark, sf):
    """A check without a name gets one from its columns, a malformed one is left out and said so."""
    customers = t.load(spark, sf, "customer").withColumn("again", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise("x"))
    checked = compare_many(customers, [{"first_col": "c_name", "second_col": "again", "compare_type": "text"},
                                       {"first_col": "c_name", "second_col": "again", "tolerance": 2}])
    return checked.table.select("c_custkey", *checked.checks).withColumn("skipped", F.lit(len(checked.skipped)))


QUERIES = {
    "compare_skips_bad_checks": compare_skips_bad_checks,
    "compare_text": compare_text,
    "compare_text_options": compare_text_options,
    "compare_numeric": compare_numeric,
    "compare_tolerance": compare_tolerance,
    "compare_date": compare_date,
    "compare_date_text": compare_date_text,
    "compare_serial_date": compare_serial_date,
    "compare_expr": compare_expr,
    "compare_nonzero": compare_nonzero,
    "compare_many": compare_many_table,
    "compare_many_summary": compare_many_summary,
    "compare_constant": compare_constant,
}

_PAIRED = f"""WITH {t.VERSIONS}, {t.counted("old_orders", "new_orders", "o_orderkey", "o_orderkey")},
paired AS (
  SELECT k, o.o_orderpriority AS op, n.o_orderpriority AS np, o.o_orderstatus AS os, n.o_orderstatus AS ns,
         o.cents AS oc, n.cents AS nc, o.o_orderdate AS od, n.o_orderdate AS nd
  FROM old_orders o JOIN counted ON k = o.o_orderkey JOIN new_orders n ON n.o_orderkey = k WHERE r = 1)"""
_DAY = "year({0}) || '-' || month({0}) || '-' || day({0})"


def _near(a: str, b: str, tolerance: float) -> str:
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    hi, lo = f"greatest(abs({a}), abs({b}))", f"least(abs({a}), abs({b}))"
    return (
        f"CASE WHEN {a} = 0 OR {b} = 0 THEN {a} = {b} WHEN ({a} < 0) <> ({b} < 0) THEN FALSE ELSE "
        f"{hi} * (CAST(1 AS DOUBLE) - CAST({tolerance} AS DOUBLE)) <= {lo} "
        f"OR {lo} * (CAST(1 AS DOUBLE) + CAST({tolerance} AS DOUBLE)) >= {hi} END"
    )


_MANY = f"""{_PAIRED},
checked AS (
  SELECT k AS "Key", CASE WHEN op IS NOT DISTINCT FROM np THEN 'PASS' ELSE 'FAIL' END AS priority,
         CASE WHEN os = ns THEN 'PASS' ELSE 'FAIL' END AS status,
         CASE WHEN oc = nc THEN 'PASS' WHEN {_near("oc", "nc", 0.05)} THEN 'PASS (WITHIN TOLERANCE)' ELSE 'FAIL' END AS price,
         'ERROR' AS mixed,
         CASE WHEN CAST(od AS DATE) = CAST(nd AS DATE) THEN 'PASS' ELSE 'FAIL' END AS day,
         'SPECIFICATION ERROR: column name specified ("old_nothing") not found in table provided.' AS missing
  FROM paired)"""

SQL = {
    "compare_skips_bad_checks": """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS "COMPARE: c_name | again", 1 AS skipped FROM customer""",
    "compare_text": f"""{_PAIRED} SELECT k AS "Key", CASE WHEN op IS NOT DISTINCT FROM np THEN 'PASS'
        ELSE 'FAIL: ' || coalesce(op, 'None') || ' -> ' || coalesce(np, 'None') END AS "check" FROM paired""",
    "compare_text_options": """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'FAIL: ' || lower(p_name) || ' -> None'
        ELSE 'PASS' END AS "check" FROM part""",
    "compare_numeric": """SELECT doc_id, CASE
        WHEN lang = 'fr' THEN 'ERROR: (numerical compare conversion fail) ' || n_chars || ' chars (<class ''str''>) -> ' || length(text) || ' (<class ''int''>)'
        WHEN lang = 'de' THEN 'FAIL: ' || n_chars || '.0 -> ' || (length(text) + 1)
        WHEN n_chars = length(text) THEN 'PASS' ELSE 'FAIL: ' || n_chars || '.0 -> ' || length(text) END AS "check" FROM documents""",
    "compare_tolerance": f"""{_PAIRED} SELECT k AS "Key", CASE WHEN oc = nc THEN 'PASS'
        WHEN {_near("oc", "nc", 0.05)} THEN 'PASS (WITHIN TOLERANCE): ' || oc || ' -> ' || nc
        ELSE 'FAIL: ' || oc || ' -> ' || nc END AS "check" FROM paired""",
    "compare_date": f"""{_PAIRED} SELECT k AS "Key", CASE WHEN CAST(od AS DATE) = CAST(nd AS DATE) THEN 'PASS'
        ELSE 'FAIL: ' || {_DAY.format("od")} || ' -> ' || {_DAY.format("nd")} END AS "check" FROM paired""",
    "compare_date_text": """SELECT CASE l_returnflag WHEN 'R' THEN 'PASS' WHEN 'A' THEN 'ERROR' ELSE 'FAIL' END AS "check",
        count(*) AS records FROM lineitem GROUP BY 1""",
    "compare_serial_date": """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) = DATE '1899-12-30' +
        CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER) THEN 'PASS' ELSE 'FAIL' END AS "check" FROM orders""",
    "compare_expr": f"""SELECT CASE WHEN l_quantity * 1500 = l_extendedprice THEN 'PASS'
        WHEN {_near("l_quantity * 1500", "l_extendedprice", 0.2)} THEN 'PASS (WITHIN TOLERANCE)' ELSE 'FAIL' END AS "check",
        count(*) AS records FROM lineitem GROUP BY 1""",
    "compare_nonzero": """SELECT CASE WHEN l_discount = l_tax AND l_discount = 0 THEN 'FAIL_ALL_ZERO' WHEN l_discount = l_tax THEN 'PASS'
        ELSE 'FAIL' END AS "check", count(*) AS records FROM lineitem GROUP BY 1""",
    "compare_many": f'{_MANY} SELECT * FROM checked',
    "compare_many_summary": f"""{_MANY} SELECT "check", split_part(outcome, ': ', 1) AS outcome, count(*) AS records
        FROM (UNPIVOT checked ON priority, status, price, mixed, day, missing INTO NAME "check" VALUE outcome) GROUP BY 1, 2""",
    "compare_constant": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'PASS' ELSE 'FAIL' END AS "check" FROM customer""",
}
