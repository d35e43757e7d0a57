"""Files of awkward shapes, written from the test tables to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, names
from ..operators.columns import first_columns, square_rows
from ..operators.flatten import flatten, select_records
from ..plans.durable import scratch_folder
from ..sources.delimited import read_cells, read_csv, read_text, write_csv
from ..sources.dispatch import read_tables, write_tables
from ..sources.xml import read_xml
from . import tables as t


# Spark's XML reader gives a whole file to one task, so there are more files, not larger ones, the more rows there are.
_ROWS_A_FILE = 50_000


def _saved(spark, df, row_tag, root_tag, name="", files=None):
    """XML files of bounded size, or as many as are wanted."""
    folder = f"{scratch_folder(spark)}/{name or root_tag}"
    dealt = df.repartition(files) if files else df.hint("rebalance")
    dealt.write.options(
        rowTag=row_tag, rootTag=root_tag, attributePrefix="@", valueTag="#text", declaration="", nullValue="",
        maxRecordsPerFile=0 if files else _ROWS_A_FILE,
    ).xml(folder)
    return folder


def _part(name, size):
    return F.struct(F.col("p_partkey").alias("@id"), F.col(name).alias("Name"), (F.col("p_size") * size).alias("Size"))


def _shelves(spark, sf):
    """Each part on a shelf of its brand: once alone, twice in a box that is a level deeper."""
    part = t.load(spark, sf, "part")
    return part.select(
        F.struct(F.col("p_brand").alias("@brand"), _part("p_name", 1).alias("Part")).alias("Shelf"),
        F.struct(F.struct(F.array(_part("p_type", 2), _part("p_name", 3)).alias("Part")).alias("Box")).alias("Store"),
    )


def xml_read_records(spark, sf):
    """Records of one tag at two paths of different depth, one of them with context."""
    return read_xml(spark, _saved(spark, _shelves(spark, sf), "Bay", "Depot"), "Part").table


def xml_cousins(spark, sf):
    """Documents whose records have different parents, none of which has two: counts over the document tell them."""
    documents = t.load(spark, sf, "part").select(
        F.struct(_part("p_name", 1).alias("Item")).alias("Left"), F.struct(_part("p_type", 2).alias("Item")).alias("Right"))
    return flatten(select_records(documents)).table


def xml_late_context(spark, sf):
    """An attribute that only the last order of the last file has is context of its lines. Files are ranges of orders."""
    orders = t.orders(spark, sf)
    last = orders.agg(F.max("o_orderkey")).first()[0]
    rows = orders.orderBy("o_orderkey").select(
        F.when(F.col("o_orderkey") == last, "late").alias("@region"),
        F.struct(F.col("o_orderkey").alias("Key"), F.col("cents").alias("Cents")).alias("Line"),
    )
    folder = f"{scratch_folder(spark)}/late"
    options = {"rowTag": "Order", "rootTag": "Orders", "attributePrefix": "@", "nullValue": "", "declaration": ""}
    rows.write.options(**options, maxRecordsPerFile=_ROWS_A_FILE).xml(folder)
    return read_xml(spark, folder, "Order.Line").table


def xml_folder(spark, sf):
    """Two folders' worth of files with other fields each, as one table with the columns of both."""
    base = f"{scratch_folder(spark)}/all"
    for name, df in (
        ("customer", t.load(spark, sf, "customer").select(F.col("c_custkey").alias("Key"), F.col("c_name").alias("Name"))),
        ("supplier", t.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("Key"), F.col("s_nationkey").alias("Nation"))),
    ):
        df.hint("rebalance").write.options(
            rowTag="Row", rootTag=name.title(), declaration="", maxRecordsPerFile=_ROWS_A_FILE
        ).xml(f"{base}/kind={name}")
    return read_xml(spark, f"{base}/*", "Row").table


def xml_max_rows(spark, sf):
    """At most 20 rows of each file; how many each has, not which, is what can be compared."""
    folder = _saved(spark, t.load(spark, sf, "part").select(F.col("p_partkey").alias("Key")), "Row", "Rows", files=4)
    table = read_xml(spark, folder, "Row", max_rows=20, with_file_name=True).table
    return table.groupBy("__file").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("Key").alias("keys")).select("rows", "keys")


def xml_metadata(spark, sf):
    """What reading says about itself: records, rows, columns, paths that were cut, items left out."""
    part = t.load(spark, sf, "part").select(
        F.col("p_partkey").alias("@id"), F.split("p_name", " ").alias("Word"),
        F.struct(F.struct(F.col("p_size").alias("Deep")).alias("Inner")).alias("Outer"))
    found = read_xml(spark, _saved(spark, part, "Row", "Rows"), "Row", list_strategy="indexed", max_indexed_items=1,
                     max_depth=1, column_order="alpha")
    found.table.write.format("noop").mode("overwrite").save()
    seen = found.metadata()
    row = (seen["records"], seen["rows"], seen["items_left_out"], ",".join(found.table.columns), ",".join(found.truncated_paths))
    return spark.createDataFrame([row], "records long, rows long, items_left_out long, columns string, truncated string")


def _text(spark, lines, name):
    """Lines as they are, in files that end in .csv."""
    folder = f"{scratch_folder(spark)}/{name}"
    lines.write.option("compression", "none").text(folder)
    return folder


def csv_ragged(spark, sf):
    """Orders with as many cells as their priority has words, under a header of two."""
    line = F.concat(F.col("o_orderkey"), F.lit(","), F.regexp_replace("o_orderpriority", "[- ]", ","))
    rows = t.orders(spark, sf).select(line.alias("value"))
    head = spark.createDataFrame([("key,first",)], "value string")
    return read_csv(spark, _text(spark, head.unionByName(rows).coalesce(1), "ragged"))


def csv_cells(spark, sf):
    """The same rows as lists of all their cells, then squared."""
    line = F.concat(F.col("o_orderkey"), F.lit(',"'), F.regexp_replace("o_orderpriority", "[- ]", '","'), F.lit('"'))
    found = read_cells(spark, _text(spark, t.orders(spark, sf).select(line.alias("value")), "cells"))
    squared = square_rows(found.withColumn("n", F.size("cells")), "cells", 3)
    return squared.select("n", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])


def csv_mixed_headers(spark, sf):
    """Files of one folder whose headers have other columns in another order."""
    base = f"{scratch_folder(spark)}/mixed"
    customer, supplier = t.load(spark, sf, "customer"), t.load(spark, sf, "supplier")
    write_csv(customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), f"{base}/kind=a", quoting="QUOTE_ALL")
    write_csv(supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key")), f"{base}/kind=b")
    return read_csv(spark, f"{base}/*", convert_numbers=True)


def csv_header_row(spark, sf):
    """Files that begin with two lines above the header."""
    folder = f"{scratch_folder(spark)}/report"
    lines = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")
    head = F.concat(F.lit("Report of customers\n\"not, a\" header\nkey,name,segment\n"), lines)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = t.load(spark, sf, "customer").repartition(3)
    rows.select(F.when(first, head).otherwise(lines).alias("value")).write.text(folder)
    return read_csv(spark, folder, header_row_index=2)


def csv_nonnumeric(spark, sf):
    """Cells without quote marks are numbers."""
    folder = f"{scratch_folder(spark)}/nonnumeric"
    write_csv(t.orders(spark, sf).select("o_orderkey", "o_orderpriority", "cents"), folder, quoting="QUOTE_NONNUMERIC")
    return read_csv(spark, folder, quoting="QUOTE_NONNUMERIC")


def csv_date_format(spark, sf):
    """Dates written in one format and found again by it."""
    folder = f"{scratch_folder(spark)}/dates"
    write_csv(t.orders(spark, sf).select("o_orderkey", "o_orderdate"), folder, convert_dates=True, date_format="%d.%m.%Y")
    typed = read_csv(spark, folder, convert_dates=True, date_format="%d.%m.%Y")
    return typed.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit(dict(typed.dtypes)["o_orderdate"]).alias("type"))


def csv_broken_lines(spark, sf):
    """Documents with all their line breaks and quote marks, beside a cell with a stray mark."""
    folder = f"{scratch_folder(spark)}/broken"
    line = F.concat(F.col("doc_id"), F.lit(',5" nail,"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    t.load(spark, sf, "documents").select(line.alias("value")).write.text(folder)
    found = read_csv(spark, folder, header=False)
    return found.select(F.col("_c0").cast("bigint").alias("doc_id"), F.col("_c1").alias("size"), F.col("_c2").alias("text"))


def text_lines(spark, sf):
    """Documents as plain text, a row per line."""
    folder = f"{scratch_folder(spark)}/plain.txt"
    t.load(spark, sf, "documents").select("text").write.text(folder)
    return read_text(spark, folder)


def _tagged(spark, sf):
    return t.load(spark, sf, "part").select(
        F.col("p_partkey").alias("@id"), F.col("p_name").alias("Name"), F.struct(F.col("p_size").alias("@cm"), F.col("p_brand").alias("#text")).alias("Box"))


def flatten_force_list(spark, sf):
    """An element that comes once treated as a list."""
    return flatten(_tagged(spark, sf), list_strategy="aggregate", force_list=("Name",)).table


def flatten_residual_dict(spark, sf):
    """What is left over stays a structure, out of which single values are taken afterwards."""
    found = flatten(_tagged(spark, sf), max_depth=0, residual_format="dict").table
    part = F.variant_get(names.col("Box.residual"), '$["#text"]', "string")
    return found.select("`@id`", part.alias("brand"), F.expr("typeof(`Box.residual`)").alias("type"))


def flatten_without_attributes(spark, sf):
    return flatten(_tagged(spark, sf), include_attributes=False).table


def flatten_without_text(spark, sf):
    return flatten(_tagged(spark, sf), include_text=False).table


def flatten_max_columns(spark, sf):
    """The first columns only, with a warning that says how many are left out."""
    found = flatten(_tagged(spark, sf), max_columns=2)
    return found.table.withColumn("warning", F.lit(found.warnings[0]))


def safe_numbers(spark, sf):
    """Numbers where there are some, the default elsewhere."""
    words = t.load(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_size"), F.when(F.col("p_size") % 3 == 0, "x").otherwise("")).alias("v"))
    return words.select("p_partkey", cells.safe_number(F.col("v"), T.StringType(), -1.0).alias("number"))


def first_two_columns(spark, sf):
    return first_columns(t.load(spark, sf, "customer"), 2)


def table_set_both(spark, sf):
    """Both tables of a set, one below the other."""
    folder = scratch_folder(spark) + "/both"
    write_tables({n: t.load(spark, sf, n) for n in ("customer", "supplier")}, folder)
    found = read_tables(spark, folder)
    return found["customer"].select("c_custkey", "c_name").unionByName(
        found["supplier"].select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")))


QUERIES = {
    "flatten_force_list": flatten_force_list,
    "flatten_residual_dict": flatten_residual_dict,
    "flatten_without_attributes": flatten_without_attributes,
    "flatten_without_text": flatten_without_text,
    "flatten_max_columns": flatten_max_columns,
    "safe_numbers": safe_numbers,
    "first_columns": first_two_columns,
    "table_set_both": table_set_both,
    "csv_ragged": csv_ragged,
    "csv_cells": csv_cells,
    "csv_mixed_headers": csv_mixed_headers,
    "csv_header_row": csv_header_row,
    "csv_nonnumeric": csv_nonnumeric,
    "csv_date_format": csv_date_format,
    "csv_broken_lines": csv_broken_lines,
    "text_lines": text_lines,
    "xml_read_records": xml_read_records,
    "xml_cousins": xml_cousins,
    "xml_late_context": xml_late_context,
    "xml_folder": xml_folder,
    "xml_max_rows": xml_max_rows,
    "xml_metadata": xml_metadata,
}

_WORD = "coalesce(regexp_split_to_array(o_orderpriority, '[- ]')[{0}], '')"

SQL = {
    "flatten_force_list": """SELECT CAST(p_partkey AS VARCHAR) AS "@id", '["' || p_name || '"]' AS "Name", CAST(p_size AS VARCHAR) AS "Box.@cm", p_brand AS "Box.#text" FROM part""",
    "flatten_residual_dict": """SELECT CAST(p_partkey AS VARCHAR) AS "@id", p_brand AS brand, 'variant' AS type FROM part""",
    "flatten_without_attributes": """SELECT p_name AS "Name", p_brand AS "Box" FROM part""",
    "flatten_without_text": """SELECT CAST(p_partkey AS VARCHAR) AS "@id", CAST(p_size AS VARCHAR) AS "Box.@cm" FROM part""",
    "flatten_max_columns": """SELECT CAST(p_partkey AS VARCHAR) AS "@id", p_name AS "Name", '2 column(s) left out, more than max_columns=2' AS warning FROM part""",
    "safe_numbers": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS number FROM part",
    "first_columns": "SELECT c_custkey, c_name FROM customer",
    "table_set_both": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    "csv_ragged": f"""SELECT CAST(o_orderkey AS VARCHAR) AS key, {_WORD.format(1)} AS first, {_WORD.format(2)} AS _c2, {_WORD.format(3)} AS _c3 FROM orders""",
    "csv_cells": f"""SELECT CAST(1 + len(regexp_split_to_array(o_orderpriority, '[- ]')) AS INTEGER) AS n, CAST(o_orderkey AS VARCHAR) AS c0,
        {_WORD.format(1)} AS c1, {_WORD.format(2)} AS c2 FROM orders""",
    "csv_mixed_headers": """SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, NULL::BIGINT AS nation FROM customer
        UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) FROM supplier""",
    "csv_header_row": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment FROM customer",
    "csv_nonnumeric": f"WITH {t.ORDERS} SELECT o_orderkey, o_orderpriority, cents FROM orders_c",
    "csv_date_format": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'timestamp' AS type FROM orders",
    "csv_broken_lines": """SELECT doc_id, '5" nail' AS size, text FROM documents""",
    "text_lines": "SELECT unnest(string_split(text, chr(10))) AS value FROM documents",
    "xml_read_records": """SELECT p_brand AS "Shelf.@brand", CAST(p_partkey AS VARCHAR) AS "@id", p_name AS "Name", CAST(p_size AS VARCHAR) AS "Size" FROM part
        UNION ALL SELECT '', CAST(p_partkey AS VARCHAR), p_type, CAST(p_size * 2 AS VARCHAR) FROM part
        UNION ALL SELECT '', CAST(p_partkey AS VARCHAR), p_name, CAST(p_size * 3 AS VARCHAR) FROM part""",
    "xml_cousins": """SELECT CAST(p_partkey AS VARCHAR) AS "@id", p_name AS "Name", CAST(p_size AS VARCHAR) AS "Size" FROM part
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_type, CAST(p_size * 2 AS VARCHAR) FROM part""",
    "xml_late_context": f"""WITH {t.ORDERS} SELECT CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'late' ELSE '' END AS "Order.@region",
        CAST(o_orderkey AS VARCHAR) AS "Key", CAST(cents AS VARCHAR) AS "Cents" FROM orders_c""",
    "xml_folder": """SELECT CAST(c_custkey AS VARCHAR) AS "Key", c_name AS "Name", '' AS "Nation" FROM customer
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '', CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "xml_max_rows": "SELECT CAST(20 AS BIGINT) AS rows, CAST(20 AS BIGINT) AS keys FROM range(4)",
    "xml_metadata": """SELECT count(*) AS records, count(*) AS rows, CAST(sum(len(string_split(p_name, ' ')) - 1) AS BIGINT) AS items_left_out,
        '@id,Outer.Inner.residual,Word.0' AS columns, 'Outer.Inner' AS truncated FROM part""",
}
