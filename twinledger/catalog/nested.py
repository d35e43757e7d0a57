"""Nested records: flattening, XML in columns, archives of XML members."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators.flatten import expected_rows, flatten, select_records
from ..sources.xml import members_of, parse_documents
from . import tables as t


def _nested_documents(spark, sf):
    """Documents with their lines as a list and their origin as a struct."""
    return t.load(spark, sf, "documents").select(
        F.col("doc_id").alias("@id"),
        F.struct(F.col("lang").alias("@lang"), F.col("source")).alias("origin"),
        F.struct(F.split("text", "\n").alias("line")).alias("body"),
    )


def _nested_orders(spark, sf):
    """Orders with two independent lists, one of structs."""
    words = F.split("o_orderpriority", "-")
    return t.orders(spark, sf).select(
        F.col("o_orderkey").alias("@id"),
        F.col("o_orderstatus").alias("status"),
        F.struct(words.alias("Tag")).alias("Tags"),
        F.struct(
            F.array(
                F.struct(F.lit("net").alias("@kind"), F.col("cents").alias("Value")),
                F.struct(F.lit("double").alias("@kind"), (F.col("cents") * 2).alias("Value")),
            ).alias("Amount")
        ).alias("Amounts"),
    )


def flatten_explode(spark, sf):
    return flatten(_nested_documents(spark, sf)).table


def flatten_two_lists(spark, sf):
    return flatten(_nested_orders(spark, sf)).table


def flatten_aggregate(spark, sf):
    return flatten(_nested_orders(spark, sf), list_strategy="aggregate").table


def flatten_delimited(spark, sf):
    return flatten(_nested_documents(spark, sf), list_strategy="aggregate", aggregate_format="delimited", aggregate_delimiter="#").table


def flatten_indexed(spark, sf):
    return flatten(_nested_orders(spark, sf), list_strategy="indexed").table


def flatten_residual(spark, sf):
    return flatten(_nested_orders(spark, sf), list_strategy="residual", residual_format="xml").table


def flatten_overrides(spark, sf):
    return flatten(_nested_orders(spark, sf), list_strategy_overrides={"Tags/Tag": "residual"}, residual_format="json",
                   path_separator="/", column_order="alpha").table


def flatten_max_depth(spark, sf):
    return flatten(_nested_orders(spark, sf), max_depth=1, residual_format="json").table


def flatten_events_json(spark, sf):
    """The JSON cell of every event parsed and flattened."""
    events = t.load(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(events, empty_value="<none>").table


def flatten_expected_rows(spark, sf):
    return expected_rows(_nested_documents(spark, sf))


def _part_documents(spark, sf):
    """Every part as an XML document with a group above two records."""
    item = F.struct(F.col("p_partkey").alias("_id"), F.col("p_name").alias("Name"), F.col("p_size").alias("Size"))
    twin = F.struct((-F.col("p_partkey") - 1).alias("_id"), F.col("p_type").alias("Name"), (F.col("p_size") * 2).alias("Size"))
    group = F.struct(F.struct(F.col("p_brand").alias("_brand"), F.array(item, twin).alias("Item")).alias("Group"))
    return t.load(spark, sf, "part").select("p_partkey", F.to_xml(group, {"rowTag": "Root"}).alias("xml"))


_PART_SCHEMA = "Group struct<`@brand`: string, Item: array<struct<`@id`: string, Name: string, Size: string>>>"


def _parsed_parts(spark, sf):
    schema = spark.createDataFrame([], _PART_SCHEMA).schema
    return parse_documents(_part_documents(spark, sf), "xml", schema=schema)


def flatten_xml_records(spark, sf):
    """Documents to XML text and back, one row per record with the context of its group."""
    records = select_records(_parsed_parts(spark, sf), "Root.Group.Item", root="Root", carry=("p_partkey",))
    return flatten(records, carry=("p_partkey",)).table


def flatten_detected_records(spark, sf):
    """The same without naming the record: the shallowest repeated element is found."""
    records = select_records(_parsed_parts(spark, sf), carry=("p_partkey",))
    return flatten(records, carry=("p_partkey",)).table


def _packed(spark, sf):
    """Documents packed into compressed archives, one per batch of rows."""
    documents = t.load(spark, sf, "documents").select(
        "doc_id", F.to_xml(F.struct("lang", "source", F.col("n_chars").alias("chars")), {"rowTag": "Document"}).alias("xml"))

    def pack(batches):
        for batch in batches:
            if batch.empty:
                continue
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
                for doc_id, xml in zip(batch["doc_id"], batch["xml"]):
                    for name, text in ((f"docs/{doc_id}.xml", xml), (f"docs/{doc_id}.txt", "not xml")):
                        data = text.encode("utf-8")
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
            yield pd.DataFrame({"archive": [f"from {batch['doc_id'].iloc[0]}"], "content": [buffer.getvalue()]})

    return documents.mapInPandas(pack, "archive string, content binary")


def archive_members(spark, sf):
    members = members_of(_packed(spark, sf))
    schema = spark.createDataFrame([], "lang string, source string, chars string").schema
    documents = parse_documents(members.select("member", "text"), "text", schema=schema)
    return flatten(documents, carry=("member",)).table


QUERIES = {
    "flatten_explode": flatten_explode,
    "flatten_two_lists": flatten_two_lists,
    "flatten_aggregate": flatten_aggregate,
    "flatten_delimited": flatten_delimited,
    "flatten_indexed": flatten_indexed,
    "flatten_residual": flatten_residual,
    "flatten_overrides": flatten_overrides,
    "flatten_max_depth": flatten_max_depth,
    "flatten_events_json": flatten_events_json,
    "flatten_expected_rows": flatten_expected_rows,
    "flatten_ancestors": flatten_xml_records,
    "flatten_detected_records": flatten_detected_records,
    "archive_members": archive_members,
}

_PARTS = f"SELECT CAST(o_orderkey AS VARCHAR) AS \"@id\", o_orderstatus AS status, o_orderpriority, cents FROM orders_c"
_AMOUNTS = """'[{"@kind":"net","Value":' || cents || '},{"@kind":"double","Value":' || (cents * 2) || '}]'"""
_TAGS = """'["' || replace(o_orderpriority, '-', '","') || '"]'"""
_ITEMS = """SELECT p_partkey, p_brand AS "Group.@brand", CAST(p_partkey AS VARCHAR) AS "@id", p_name AS "Name", CAST(p_size AS VARCHAR) AS "Size" FROM part
    UNION ALL SELECT p_partkey, p_brand, CAST(-p_partkey - 1 AS VARCHAR), p_type, CAST(p_size * 2 AS VARCHAR) FROM part"""

SQL = {
    "flatten_explode": """SELECT CAST(doc_id AS VARCHAR) AS "@id", lang AS "origin.@lang", source AS "origin.source",
        unnest(string_split(text, chr(10))) AS "body.line" FROM documents""",
    "flatten_two_lists": f"""WITH {t.ORDERS}, p AS ({_PARTS}), amounts AS (
          SELECT *, 'net' AS kind, cents AS v FROM p UNION ALL SELECT *, 'double', cents * 2 FROM p)
        SELECT "@id", status, unnest(string_split(o_orderpriority, '-')) AS "Tags.Tag", kind AS "Amounts.Amount.@kind",
               CAST(v AS VARCHAR) AS "Amounts.Amount.Value" FROM amounts""",
    "flatten_aggregate": f"""WITH {t.ORDERS}, p AS ({_PARTS})
        SELECT "@id", status, {_TAGS} AS "Tags.Tag", {_AMOUNTS} AS "Amounts.Amount" FROM p""",
    "flatten_delimited": """SELECT CAST(doc_id AS VARCHAR) AS "@id", lang AS "origin.@lang", source AS "origin.source",
        array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{ws}')), '#') AS "body.line" FROM documents""",
    "flatten_indexed": f"""WITH {t.ORDERS}, p AS ({_PARTS})
        SELECT "@id", status, split_part(o_orderpriority, '-', 1) AS "Tags.Tag.0", split_part(o_orderpriority, '-', 2) AS "Tags.Tag.1",
               'net' AS "Amounts.Amount.0.@kind", CAST(cents AS VARCHAR) AS "Amounts.Amount.0.Value",
               'double' AS "Amounts.Amount.1.@kind", CAST(cents * 2 AS VARCHAR) AS "Amounts.Amount.1.Value" FROM p""",
    "flatten_residual": f"""WITH {t.ORDERS}, p AS ({_PARTS})
        SELECT "@id", status, '<Tag>' || replace(o_orderpriority, '-', '</Tag><Tag>') || '</Tag>' AS "Tags.Tag.residual",
               '<Amount kind="net"><Value>' || cents || '</Value></Amount><Amount kind="double"><Value>' || (cents * 2) || '</Value></Amount>'
                 AS "Amounts.Amount.residual" FROM p""",
    "flatten_overrides": f"""WITH {t.ORDERS}, p AS ({_PARTS}), amounts AS (
          SELECT *, 'net' AS kind, cents AS v FROM p UNION ALL SELECT *, 'double', cents * 2 FROM p)
        SELECT "@id", status, {_TAGS} AS "Tags/Tag/residual", kind AS "Amounts/Amount/@kind",
               CAST(v AS VARCHAR) AS "Amounts/Amount/Value" FROM amounts""",
    "flatten_max_depth": f"""WITH {t.ORDERS}, p AS ({_PARTS}), amounts AS (
          SELECT *, '{{"@kind":"net","Value":' || cents || '}}' AS v FROM p UNION ALL
          SELECT *, '{{"@kind":"double","Value":' || (cents * 2) || '}}' FROM p)
        SELECT "@id", status, '"' || unnest(string_split(o_orderpriority, '-')) || '"' AS "Tags.Tag.residual",
               v AS "Amounts.Amount.residual" FROM amounts""",
    "flatten_events_json": """SELECT CAST(event_id AS VARCHAR) AS event_id,
        coalesce(json_extract_string(props, '$.k'), '<none>') AS "props.k" FROM events""",
    "flatten_expected_rows": """SELECT count(*) AS records, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS expected_rows FROM documents""",
    "flatten_ancestors": _ITEMS,
    "flatten_detected_records": _ITEMS,
    "archive_members": """SELECT 'docs/' || doc_id || '.xml' AS member, CAST(n_chars AS VARCHAR) AS chars, lang, source FROM documents""",
}

from ..functions.cells import WHITESPACE  # noqa: E402

SQL["flatten_delimited"] = SQL["flatten_delimited"].replace("{ws}", WHITESPACE)
