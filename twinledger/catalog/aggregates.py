"""The 36 aggregate kinds, plain and by category, and splitting delimited cells."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions import cells
from ..operators.aggregate import aggregate, concatenate_parts, de_aggregate
from ..operators.sketches import distinct_sketches, estimated_counts, merge_sketches
from ..plans.agg_specs import AggSpec, spec_all
from . import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}

_STATUSES = ("F", "O", "P")


def _orders(spark, sf):
    """Orders with columns that exercise blanks, words and mixed text."""
    return t.orders(spark, sf).withColumns({
        "priority": F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ").otherwise(F.col("o_orderpriority")),
        "word": F.when(F.col("cents") > 30000000, "Yes").when(F.col("cents") > 5000000, "n").otherwise("1"),
        "loose": F.when(F.col("o_orderpriority") == "5-LOW", "maybe").when(F.col("o_orderpriority") == "2-HIGH", "T").otherwise(""),
        "mixed": F.when(F.col("o_orderpriority") == "1-URGENT", "pending")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise((F.col("cents") / 100).cast("bigint").cast("string")),
    })


_ORDERS = t.ORDERS + """,
o AS (
  SELECT *, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' ' ELSE o_orderpriority END AS priority,
         CASE WHEN cents > 30000000 THEN 'Yes' WHEN cents > 5000000 THEN 'n' ELSE '1' END AS word,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'maybe' WHEN o_orderpriority = '2-HIGH' THEN 'T' ELSE '' END AS loose,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'pending' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
              ELSE CAST(cents // 100 AS VARCHAR) END AS mixed
  FROM orders_c)"""


def _plain(name, kind, column, options, value_sql, status_sql=None, key="o_custkey", as_text=False):
    def run(spark, sf):
        spec = AggSpec(kind, column, "r", options)
        return aggregate(_orders(spark, sf), key, [spec], order_by=["o_orderkey"], as_text=as_text)

    QUERIES[name] = run
    status = f', {status_sql} AS "r__status"' if status_sql else ""
    SQL[name] = f"WITH {_ORDERS} SELECT {key}, {value_sql} AS r{status} FROM o GROUP BY {key}"


def _number_sql(function: str, cast: str) -> tuple[str, str]:
    """Value and status over the mixed text column."""
    bad = "count(*) FILTER (WHERE mixed = 'pending') > 0"
    number = "CASE WHEN mixed NOT IN ('pending', '') THEN CAST(mixed AS DOUBLE) END"
    value = f"CASE WHEN {bad} THEN NULL ELSE CAST({function}({number}) AS {cast}) END"
    return value, f"CASE WHEN {bad} THEN 'non_numeric' WHEN count({number}) = 0 THEN 'empty' ELSE 'ok' END"


_plain("agg_sum", "sum", "cents", {}, "CAST(sum(cents) AS BIGINT)", "'ok'")
_plain("agg_min", "min", "cents", {}, "min(cents)", "'ok'")
_plain("agg_max", "max", "cents", {}, "max(cents)", "'ok'")
_plain("agg_average", "average", "cents", {}, "avg(cents)", "'ok'")
for _kind, _function in (("sum", "sum"), ("min", "min"), ("max", "max"), ("average", "avg")):
    _plain(f"agg_{_kind}_mixed_text", _kind, "mixed", {}, *_number_sql(_function, "DOUBLE"))
_plain("agg_sum_ignoring_text", "sum", "mixed", {"ignore_non_numbers": True},
       "sum(CASE WHEN mixed NOT IN ('pending', '') THEN CAST(mixed AS DOUBLE) END)",
       "CASE WHEN count(*) FILTER (WHERE mixed NOT IN ('pending', '')) = 0 THEN 'empty' ELSE 'ok' END")
_plain("agg_count_all", "count_all", "priority", {}, "count(*)")
_plain("agg_count_nonempty", "count_nonempty", "priority", {}, "count(*) FILTER (WHERE trim(priority) <> '')")
_plain("agg_count_unique", "count_unique", "priority", {}, "count(DISTINCT trim(priority))")
_plain("agg_concatenate", "concatenate", "priority", {}, "string_agg(trim(priority), ', ' ORDER BY o_orderkey)", "'ok'")
_plain("agg_concatenate_unique", "concatenate_unique", "priority", {"link_text": "|"},
       "string_agg(DISTINCT trim(priority), '|' ORDER BY trim(priority))", "'ok'")
_plain("agg_and", "and", "word", {}, "bool_and(word IN ('Yes', '1'))", "'ok'")
_plain("agg_or", "or", "word", {}, "bool_or(word IN ('Yes', '1'))", "'ok'")
_plain("agg_and_ignoring_blanks", "and", "loose", {"ignore_blanks": True},
       "CASE WHEN count(*) FILTER (WHERE loose = 'maybe') > 0 THEN NULL ELSE bool_and(CASE WHEN loose = 'T' THEN TRUE END) END",
       "CASE WHEN count(*) FILTER (WHERE loose = 'maybe') > 0 THEN 'invalid' WHEN count(*) FILTER (WHERE loose = 'T') = 0 THEN 'empty' ELSE 'ok' END")
_plain("agg_are_same", "are_same", "o_orderstatus", {}, "count(DISTINCT o_orderstatus) = 1")
_plain("agg_min_text_length", "min_text_length", "priority", {}, "min(length(trim(priority)))", "'ok'")
_plain("agg_max_text_length", "max_text_length", "priority", {}, "max(length(trim(priority)))", "'ok'")
_plain("agg_avg_text_length", "avg_text_length", "priority", {}, "avg(length(trim(priority)))", "'ok'")
_plain("agg_all_filled", "all_filled", "priority", {}, "bool_and(trim(priority) <> '')")
_plain("agg_some_filled", "some_filled", "priority", {}, "bool_or(trim(priority) <> '')")
_plain("agg_none_filled", "none_filled", "priority", {}, "NOT bool_or(trim(priority) <> '')")
_plain("agg_sum_as_text", "sum", "mixed", {},
       f"CASE {_number_sql('sum', 'DOUBLE')[1]} WHEN 'non_numeric' THEN '-Non-numeric-' WHEN 'empty' THEN '-All empty-' "
       f"ELSE CAST({_number_sql('sum', 'DOUBLE')[0]} AS VARCHAR) END", as_text=True)


def agg_document_lengths(spark, sf):
    """Text lengths over whole documents by source."""
    specs = [AggSpec(k, "text", k, {"strip": False}) for k in ("min_text_length", "max_text_length", "avg_text_length")]
    return aggregate(t.load(spark, sf, "documents"), "source", specs)


QUERIES["agg_document_lengths"] = agg_document_lengths
SQL["agg_document_lengths"] = """SELECT source, min(length(text)) AS min_text_length, 'ok' AS min_text_length__status,
    max(length(text)) AS max_text_length, 'ok' AS max_text_length__status,
    avg(length(text)) AS avg_text_length, 'ok' AS avg_text_length__status FROM documents GROUP BY source"""


def agg_many_specs(spark, sf):
    """Several aggregates over line items of a supplier in one pass."""
    lines = t.load(spark, sf, "lineitem")
    return aggregate(lines, "l_suppkey", [
        AggSpec("sum", "l_quantity", "qty"), AggSpec("min", "l_extendedprice", "low"), AggSpec("max", "l_extendedprice", "high"),
        AggSpec("average", "l_quantity", "mean"), AggSpec("count_all", "l_orderkey", "n"),
        AggSpec("count_unique", "l_partkey", "parts"), AggSpec("are_same", "l_linestatus", "same"),
        AggSpec("some_filled", "l_returnflag", "filled"),
    ])


QUERIES["agg_many_specs"] = agg_many_specs
SQL["agg_many_specs"] = """SELECT l_suppkey, sum(l_quantity) AS qty, 'ok' AS qty__status, min(l_extendedprice) AS low, 'ok' AS low__status,
    max(l_extendedprice) AS high, 'ok' AS high__status, avg(l_quantity) AS mean, 'ok' AS mean__status, count(*) AS n,
    count(DISTINCT l_partkey) AS parts, count(DISTINCT l_linestatus) = 1 AS same, bool_or(l_returnflag <> '') AS filled
    FROM lineitem GROUP BY l_suppkey"""


def agg_concatenate_parts(spark, sf):
    """Order keys per status as parts of bounded length: keys, part numbers and texts row by row."""
    return concatenate_parts(t.orders(spark, sf), "o_orderstatus", "o_orderkey", ["o_orderkey"], part_rows=1000)


QUERIES["agg_concatenate_parts"] = agg_concatenate_parts
SQL["agg_concatenate_parts"] = """SELECT o_orderstatus AS key, part, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS text
    FROM (SELECT o_orderstatus, o_orderkey,
                 CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 + 1 AS INTEGER) AS part
          FROM orders) GROUP BY o_orderstatus, part"""


def agg_spec_all(spark, sf):
    """Distinct values of every column of the line items, per return flag, in one pass."""
    lines = t.load(spark, sf, "lineitem")
    return aggregate(lines, "l_returnflag", spec_all(lines, "count_unique"))


_LINE_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
                 "l_linestatus l_shipdate").split()
QUERIES["agg_spec_all"] = agg_spec_all
SQL["agg_spec_all"] = "SELECT l_returnflag, " + ", ".join(
    f'count(DISTINCT {c}) AS "{n} - count_unique - {c}"' for n, c in enumerate(_LINE_COLUMNS)
) + " FROM lineitem GROUP BY l_returnflag"


def pivot_own_categories(spark, sf):
    """Three specs over one category column: two with lists of their own, one with all its values."""
    specs = [AggSpec("category-count-all", "o_orderkey", name, {"cat_key_col": "o_orderstatus", **more})
             for name, more in (("x", {"categories": ["F"]}), ("y", {"categories": ["O", "P"]}), ("z", {}))]
    return aggregate(t.orders(spark, sf), "o_custkey", specs)


QUERIES["pivot_own_categories"] = pivot_own_categories
SQL["pivot_own_categories"] = "SELECT o_custkey, " + ", ".join(
    f"count(*) FILTER (o_orderstatus = '{c}') AS \"{n} - {c}\"" for n, c in ("xF", "yO", "yP", "zF", "zO", "zP")
) + " FROM orders GROUP BY o_custkey"


def _pivot(name, kind, column, options, value_sql, status_sql=None, absent="NULL", absent_status="'ok'"):
    """A category aggregate of orders: customers as rows, order status as columns."""

    def run(spark, sf):
        spec = AggSpec(kind, column, "r", {"cat_key_col": "o_orderstatus", **options})
        return aggregate(_orders(spark, sf), "o_custkey", [spec])

    QUERIES[name] = run
    out = []
    for status in _STATUSES:
        here = f"count(*) FILTER (WHERE o_orderstatus = '{status}') > 0"
        own = f"FILTER (WHERE o_orderstatus = '{status}'"
        value = value_sql.replace("{own", own).replace("}", ")").replace("<and>", " AND ")
        out.append(f"CASE WHEN {here} THEN {value} ELSE {absent} END AS \"r - {status}\"")
        if status_sql:
            state = status_sql.replace("{own", own).replace("}", ")").replace("<and>", " AND ")
            out.append(f"CASE WHEN {here} THEN {state} ELSE {absent_status} END AS \"r - {status}__status\"")
    SQL[name] = f"WITH {_ORDERS} SELECT o_custkey, {', '.join(out)} FROM o GROUP BY o_custkey"


# In the SQL pieces, {own} stands for the FILTER of one category and {own<and>...} narrows it further.
_BAD = "count(*) {own<and>mixed = 'pending'} > 0"
_GOOD = "mixed NOT IN ('pending', '')"


def _pivot_numbers(function: str) -> tuple[str, str]:
    value = f"CASE WHEN {_BAD} THEN NULL ELSE {function}(CASE WHEN {_GOOD} THEN CAST(mixed AS DOUBLE) END) {{own}} END"
    status = f"CASE WHEN {_BAD} THEN 'non_numeric' WHEN count(*) {{own<and>{_GOOD}}} = 0 THEN 'empty' ELSE 'ok' END"
    return value, status


_pivot("pivot_category", "category", "cents", {}, "CASE WHEN count(*) {own} = 1 THEN min(cents) {own} END",
       "CASE WHEN count(*) {own} > 1 THEN 'duplicate' ELSE 'ok' END")
_pivot("pivot_category_equal", "category", "priority", {"allow_duplicates_if_equal": True},
       "CASE WHEN count(DISTINCT priority) {own} = 1 THEN min(priority) {own} END",
       "CASE WHEN count(DISTINCT priority) {own} > 1 THEN 'duplicate' ELSE 'ok' END")
_pivot("pivot_sum", "category-sum", "mixed", {},
       f"CASE WHEN {_BAD} THEN NULL ELSE coalesce(sum(CASE WHEN {_GOOD} THEN CAST(mixed AS DOUBLE) END) {{own}}, 0) END",
       f"CASE WHEN {_BAD} THEN 'non_numeric' ELSE 'ok' END", "0.0")
_pivot("pivot_concat_unique", "category-concat-unique", "o_orderpriority", {},
       "string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) {own}", "'ok'", "''")
_pivot("pivot_and", "category-and", "word", {}, "bool_and(word IN ('Yes', '1')) {own}", "'ok'", "NULL", "'empty'")
_pivot("pivot_or", "category-or", "loose", {},
       "CASE WHEN count(*) {own<and>loose <> 'T'} > 0 THEN NULL ELSE bool_or(loose = 'T') {own} END",
       "CASE WHEN count(*) {own<and>loose <> 'T'} > 0 THEN 'invalid' ELSE 'ok' END", "NULL", "'empty'")
_pivot("pivot_min", "category-min", "mixed", {}, *_pivot_numbers("min"), "NULL", "'empty'")
_pivot("pivot_max", "category-max", "mixed", {}, *_pivot_numbers("max"), "NULL", "'empty'")
_pivot("pivot_average", "category-average", "mixed", {}, *_pivot_numbers("avg"), "NULL", "'empty'")
_pivot("pivot_count_nonempty", "category-count-nonempty", "priority", {}, "count(*) {own<and>trim(priority) <> ''}", None, "0")
_pivot("pivot_count_all", "category-count-all", "priority", {}, "count(*) {own}", None, "0")
_pivot("pivot_count_unique", "category-count-unique", "priority", {}, "count(DISTINCT trim(priority)) {own}", None, "0")
_pivot("pivot_are_same", "category-are-same", "priority", {}, "count(DISTINCT trim(priority)) {own} = 1", "'ok'", "NULL", "'not_found'")
_pivot("pivot_min_text_length", "category-min-text-length", "priority", {}, "min(length(trim(priority))) {own}", "'ok'", "NULL", "'empty'")
_pivot("pivot_max_text_length", "category-max-text-length", "priority", {}, "max(length(trim(priority))) {own}", "'ok'", "NULL", "'empty'")
_pivot("pivot_avg_text_length", "category-avg-text-length", "priority", {}, "avg(length(trim(priority))) {own}", "'ok'", "NULL", "'empty'")
_pivot("pivot_all_filled", "category-all-filled", "priority", {}, "bool_and(trim(priority) <> '') {own}", None, "FALSE")
_pivot("pivot_some_filled", "category-some-filled", "priority", {}, "bool_or(trim(priority) <> '') {own}", None, "FALSE")
_pivot("pivot_none_filled", "category-none-filled", "priority", {}, "NOT bool_or(trim(priority) <> '') {own}", None, "TRUE")


def pivot_lineitem(spark, sf):
    """Line items: return flag by line status, a sum and a count side by side with plain totals."""
    lines = t.load(spark, sf, "lineitem")
    by = {"cat_key_col": "l_linestatus"}
    return aggregate(lines, "l_returnflag", [
        AggSpec("category-sum", "l_quantity", "qty", by), AggSpec("category-count-all", "l_orderkey", "n", by),
        AggSpec("sum", "l_quantity", "total"),
    ])


QUERIES["pivot_lineitem"] = pivot_lineitem
SQL["pivot_lineitem"] = """SELECT l_returnflag,
    sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS "qty - F", 'ok' AS "qty - F__status",
    sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS "qty - O", 'ok' AS "qty - O__status",
    count(*) FILTER (WHERE l_linestatus = 'F') AS "n - F", count(*) FILTER (WHERE l_linestatus = 'O') AS "n - O",
    sum(l_quantity) AS total, 'ok' AS total__status FROM lineitem GROUP BY l_returnflag"""


def de_aggregate_lines(spark, sf):
    """One row per line of every document."""
    return de_aggregate(t.load(spark, sf, "documents").select("doc_id", "lang", "text"), "text", "\n")


def de_aggregate_names(spark, sf):
    return de_aggregate(t.load(spark, sf, "part").select("p_partkey", "p_name"), "p_name", " ", strip=False)


QUERIES["de_aggregate_lines"] = de_aggregate_lines
SQL["de_aggregate_lines"] = f"""SELECT doc_id, lang, trim(unnest(string_split(text, chr(10))), '{cells.WHITESPACE}') AS text FROM documents"""
QUERIES["de_aggregate_names"] = de_aggregate_names
SQL["de_aggregate_names"] = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part"


def de_aggregate_round_trip(spark, sf):
    """Order keys gathered per customer and split again."""
    gathered = aggregate(t.orders(spark, sf), "o_custkey", [AggSpec("concatenate", "o_orderkey", "ids")], order_by=["o_orderkey"])
    return de_aggregate(gathered.select("o_custkey", "ids"), "ids").select("o_custkey", F.col("ids").cast("bigint").alias("o_orderkey"))


QUERIES["de_aggregate_round_trip"] = de_aggregate_round_trip
SQL["de_aggregate_round_trip"] = "SELECT o_custkey, o_orderkey FROM orders"


def count_unique_approx(spark, sf):
    """Distinct customers and days per priority from sketches of two halves, beside the exact counts."""
    orders = _orders(spark, sf)
    halves = [distinct_sketches(orders.where(F.col("o_orderkey") % 2 == i), ["o_orderpriority"], ["o_custkey", "o_orderdate"]) for i in (0, 1)]
    found = estimated_counts(merge_sketches(halves, ["o_orderpriority"]), ["o_orderpriority"])
    exact = orders.groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderdate").alias("days"))

    def near(estimate, count):
        return F.abs(F.col(estimate) - F.col(count)) <= F.col(count) * 0.06 + 1

    joined = found.join(exact, F.col("o_orderpriority") == F.col("p"))
    return joined.select("o_orderpriority", "customers", "days", near("o_custkey", "customers").alias("customers_near"),
                         near("o_orderdate", "days").alias("days_near"))


QUERIES["agg_count_unique_approx"] = count_unique_approx
SQL["agg_count_unique_approx"] = """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days,
    TRUE AS customers_near, TRUE AS days_near FROM orders GROUP BY 1"""


def skips_bad_specs(spark, sf):
    """The key column under another name; a spec of an unknown kind is left out with a warning."""
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = aggregate(t.orders(spark, sf), "o_orderstatus", [AggSpec("count_all", "cents", "n"), AggSpec("median", "cents", "m")], key_name="status")
    return found.select("status", "n").withColumn("skipped", F.lit(sum("skipped" in str(w.message) for w in said)))


QUERIES["agg_skips_bad_specs"] = skips_bad_specs
SQL["agg_skips_bad_specs"] = "SELECT o_orderstatus AS status, count(*) AS n, 1 AS skipped FROM orders GROUP BY 1"
