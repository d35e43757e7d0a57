"""Profiles, type conversion, files, chunked messages and cell predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..operators.columns import extract_column, spread_cells, strip_cells, union_tables
from ..operators.messages import decode_payload, encode_binary, parse_envelopes, reassemble, split_messages
from ..operators.profile import column_uniqueness, profile, snapshot_rows
from ..plans.durable import scratch_folder
from ..sources.delimited import convert_types, read_csv, sniff_delimiter, write_csv, write_text
from ..sources.dispatch import read_table, read_tables, write_tables
from . import tables as t


def unique_values(spark, sf):
    return column_uniqueness(t.load(spark, sf, "lineitem"), "l_orderkey")[0]


def non_unique_values(spark, sf):
    return column_uniqueness(t.load(spark, sf, "lineitem"), "l_orderkey")[1]


def profile_orders(spark, sf):
    return profile(t.orders(spark, sf), order_by=["o_orderkey"], distinct=False)


def snapshot_events(spark, sf):
    return snapshot_rows(t.load(spark, sf, "events"), order_by=["event_id"])


def extract(spark, sf):
    return extract_column(t.load(spark, sf, "customer"), 1)


def union_headers(spark, sf):
    """Customers and suppliers under one header."""
    return union_tables([t.load(spark, sf, "customer"), t.load(spark, sf, "supplier")])


def square_cells(spark, sf):
    """Ragged cells squared to three columns."""
    parts = t.load(spark, sf, "orders").select(F.split("o_orderpriority", "[- ]").alias("cells"))
    return spread_cells(parts, "cells", ["first", "second", "third"])


def strip_text(spark, sf):
    return strip_cells(t.load(spark, sf, "documents").select("doc_id", F.concat(F.lit("\t "), "text", F.lit(" \n")).alias("text")))


def cell_types(spark, sf):
    """What every document and every order date, price and priority looks like."""
    documents = t.load(spark, sf, "documents").select(F.lit("text").alias("cell"), F.col("text").alias("v"))
    orders = t.orders(spark, sf)
    stacked = documents.unionByName(orders.select(F.lit("date").alias("cell"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("v")))
    stacked = stacked.unionByName(orders.select(F.lit("price").alias("cell"), F.col("cents").cast("string").alias("v")))
    stacked = stacked.unionByName(orders.select(F.lit("priority").alias("cell"), F.col("o_orderpriority").alias("v")))
    kind = cells.cell_type(F.col("v"), T.StringType())
    return stacked.groupBy("cell", kind.alias("kind")).agg(F.count(F.lit(1)).alias("cells"))


def convert_types_lineitem(spark, sf):
    """All line items as text and back to numbers and dates."""
    lines = t.load(spark, sf, "lineitem")
    as_text = lines.select(*[
        (F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "l_shipdate" else F.col(c).cast("string")).alias(c) for c in lines.columns
    ])
    typed = convert_types(as_text, True, True, "%Y-%m-%d %H:%M:%S")
    return typed.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


def csv_round_trip(spark, sf):
    """Documents with quotes, line breaks and delimiters through delimited files."""
    path = scratch_folder(spark) + "/documents.csv"
    write_csv(t.load(spark, sf, "documents").select("doc_id", "text"), path, quoting="QUOTE_ALL")
    return read_csv(spark, path, convert_numbers=True)


def tsv_round_trip(spark, sf):
    path = scratch_folder(spark) + "/orders.txt"
    write_text(t.orders(spark, sf).select("o_orderkey", "o_orderpriority", "cents"), path)
    return read_csv(spark, path, delim="\t", quoting="QUOTE_NONE", convert_numbers=True)


def table_set_round_trip(spark, sf):
    folder = scratch_folder(spark) + "/set"
    write_tables({n: t.load(spark, sf, n) for n in ("customer", "supplier")}, folder)
    return read_tables(spark, folder, "customer")["customer"]


def sniffed_delimiter(spark, sf):
    """Customers written with semicolons and read without saying so."""
    path = scratch_folder(spark) + "/customer.dat"
    write_csv(t.load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, delim=";")
    delim, width = sniff_delimiter(spark, path)
    return read_table(spark, path).select("*", F.lit(delim).alias("delim"), F.lit(width).alias("width"))


def _chunks(spark, sf):
    documents = t.load(spark, sf, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("session"), "text", F.concat("source", F.lit(".txt")).alias("file"))
    return split_messages(documents, "session", "text", "file", error_correction="M")


def message_chunk(spark, sf):
    return _chunks(spark, sf)


def message_reassemble(spark, sf):
    """Every document cut to chunks, each chunk sent twice, put together again."""
    chunks = _chunks(spark, sf).select("envelope", F.col("seq").alias("at"))
    sent = chunks.unionByName(chunks.withColumn("at", F.col("at") + 1_000_000))
    return reassemble(sent, "envelope", "at").select("session", "total", "chunks", "complete", "filename", "content")


def message_parse(spark, sf):
    """Chunks among foreign texts."""
    texts = _chunks(spark, sf).select("envelope").unionByName(t.load(spark, sf, "conversations").select(F.col("text").alias("envelope")))
    return parse_envelopes(texts, "envelope").groupBy("is_foreign", "encoding", "filename").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("payload")).alias("chars"))


def base64_round_trip(spark, sf):
    documents = t.load(spark, sf, "documents")
    encoded = encode_binary(F.encode("text", "UTF-8"))
    return documents.select("doc_id", encoded.alias("encoded"),
                            F.decode(decode_payload(encoded, F.lit("base64")), "UTF-8").alias("decoded"))


QUERIES = {
    "unique_values": unique_values,
    "non_unique_values": non_unique_values,
    "profile": profile_orders,
    "snapshot": snapshot_events,
    "extract_column": extract,
    "union_headers": union_headers,
    "square_cells": square_cells,
    "strip_cells": strip_text,
    "cell_types": cell_types,
    "convert_types": convert_types_lineitem,
    "csv_round_trip": csv_round_trip,
    "tsv_round_trip": tsv_round_trip,
    "table_set_round_trip": table_set_round_trip,
    "sniff_delimiter": sniffed_delimiter,
    "message_chunk": message_chunk,
    "message_reassemble": message_reassemble,
    "message_parse": message_parse,
    "base64_round_trip": base64_round_trip,
}

_COUNTED = "SELECT l_orderkey AS value, count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(*) {0} 1"
_PROFILED = [
    ("o_orderkey", "A", "bigint", "CAST({0} AS VARCHAR)"), ("o_custkey", "B", "bigint", "CAST({0} AS VARCHAR)"),
    ("o_orderstatus", "C", "string", "{0}"), ("o_orderpriority", "D", "string", "{0}"),
    ("o_orderdate", "E", "timestamp_ntz", t.STAMP), ("cents", "F", "bigint", "CAST({0} AS VARCHAR)"),
]
_PROFILE = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{letters}' AS letters, '{c}' AS name, '{kind}' AS type, count(*) AS row_count, count({c}) AS filled,
    {text.format(f"arg_min({c}, o_orderkey)")} AS first_value, {text.format(f"min({c})")} AS smallest, {text.format(f"max({c})")} AS largest
    FROM orders_c"""
    for i, (c, letters, kind, text) in enumerate(_PROFILED)
)
_MONTHS = "|".join(cells.MONTH_TOKENS)
_TWICE = " OR ".join(f"length(v) - length(replace(v, '{ch}', '')) >= 2" for ch in ("/", "\\", "-", "."))

# Rounds of "how many chunks, if the header is for that many", starting from one chunk.
_ROUND = """n{1} AS (SELECT session, file, text, total_of AS guess, room_of AS room, greatest(1, CAST(ceil(length(text) / room_of) AS BIGINT)) AS total_of2
  FROM (SELECT *, 2331 - 20 - length(session) - length(file) - 2 * length(CAST(total_of AS VARCHAR)) AS room_of
        FROM (SELECT session, file, text, {0} AS total_of FROM n{2})))"""
_ENVELOPES = (
    """n0 AS (SELECT 'doc' || doc_id AS session, source || '.txt' AS file, text, 1 AS total_of2 FROM documents), """
    + ", ".join(_ROUND.format("total_of2", i + 1, i) for i in range(5))
    + """,
seqs AS (SELECT session, file, text, total_of2 AS total, room, unnest(generate_series(1, total_of2)) AS seq FROM n5),
chunks AS (SELECT session, file, seq, total, substring(text, (seq - 1) * room + 1, room) AS payload FROM seqs)"""
)

SQL = {
    "unique_values": _COUNTED.format("="),
    "non_unique_values": _COUNTED.format(">"),
    "profile": f"WITH {t.ORDERS} {_PROFILE}",
    "snapshot": """SELECT CAST(event_id AS VARCHAR) AS event_id,
        CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts,
        CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(value AS VARCHAR) AS value, props
        FROM events ORDER BY events.event_id LIMIT 250""",
    "extract_column": "SELECT c_name FROM customer",
    "union_headers": """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name,
        NULL::INTEGER AS s_nationkey, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""",
    "square_cells": """SELECT regexp_split_to_array(o_orderpriority, '[- ]')[1] AS first, regexp_split_to_array(o_orderpriority, '[- ]')[2] AS second,
        coalesce(regexp_split_to_array(o_orderpriority, '[- ]')[3], '') AS third FROM orders""",
    "strip_cells": f"SELECT doc_id, trim(text, '{cells.WHITESPACE}') AS text FROM documents",
    "cell_types": f"""WITH {t.ORDERS}, stacked AS (
          SELECT 'text' AS cell, text AS v FROM documents UNION ALL SELECT 'date', strftime(o_orderdate, '%d.%m.%Y') FROM orders_c
          UNION ALL SELECT 'price', CAST(cents AS VARCHAR) FROM orders_c UNION ALL SELECT 'priority', o_orderpriority FROM orders_c)
        SELECT cell, CASE WHEN v IS NULL OR v = '' THEN 'BLANK'
          WHEN length(v) >= 6 AND regexp_matches(v, '[0-9]') AND ({_TWICE} OR regexp_matches(lower(v), '{_MONTHS}')) THEN 'DATE'
          WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'NUMBER' ELSE 'TEXT' END AS kind, count(*) AS cells FROM stacked GROUP BY 1, 2""",
    "convert_types": """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem""",
    "csv_round_trip": "SELECT doc_id, text FROM documents",
    "tsv_round_trip": f"WITH {t.ORDERS} SELECT o_orderkey, o_orderpriority, cents FROM orders_c",
    "table_set_round_trip": "SELECT * FROM customer",
    "sniff_delimiter": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, ';' AS delim, 3 AS width FROM customer""",
    "message_chunk": f"""WITH {_ENVELOPES} SELECT session, seq, total,
        'TTKQR1|' || session || '|' || seq || '/' || total || '|utf8|' || file || '|' || payload AS envelope FROM chunks""",
    "message_reassemble": f"""WITH {_ENVELOPES} SELECT session, max(total) AS total, count(*) AS chunks, TRUE AS complete, max(file) AS filename,
        string_agg(payload, '' ORDER BY seq) AS content FROM chunks GROUP BY session""",
    "message_parse": f"""WITH {_ENVELOPES} SELECT FALSE AS is_foreign, 'utf8' AS encoding, file AS filename, count(*) AS texts,
        CAST(sum(length(payload)) AS BIGINT) AS chars FROM chunks GROUP BY file
        UNION ALL SELECT TRUE, NULL, NULL, count(*), NULL FROM conversations""",
    "base64_round_trip": "SELECT doc_id, to_base64(encode(text)) AS encoded, text AS decoded FROM documents",
}
