"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

# A run of white space that is not already one blank.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Each run of white space as one blank; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash128: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The groups are one aggregation by hash. Besides the count and the smallest id it carries the
    smallest and the largest text, which are equal exactly when all bytes in the group are. Copies
    collapse before the shuffle, so a group with a third of all rows sends one row per task. Groups
    whose bytes differ (hash collisions) are grouped again by the text itself. The groups are then
    joined to narrow rows (id, hash), a join that adaptive execution splits for a hot hash.

    Null texts count as empty. A null id counts as the largest: such a row stays only if no row of
    its group has an id, and all rows of such a group stay. Rows repeated with the same id all stay
    if that id does. Only the two named columns are read, so others may have any name. An empty
    table gives an empty result. ``hash128`` (over column ``norm``) is there for tests of collisions.
    """
    scratch = Scratch(docs.sparkSession)
    hashed = F.unhex(F.md5("norm")) if hash128 is None else hash128
    texts = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm")).withColumn("hash", hashed)
    groups = scratch.write(
        texts.groupBy("hash").agg(
            F.min("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            (F.min("norm") == F.max("norm")).alias("same"),
        )
    )
    rows = texts.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    result = rows.join(groups.where("same"), "hash")
    collided = groups.where("NOT same").select("hash")
    if not collided.isEmpty():
        apart = texts.join(collided, "hash", "left_semi")
        by_text = apart.groupBy("hash", "norm").agg(
            F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.lit(True).alias("same")
        )
        again = apart.join(by_text, ["hash", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        result = result.unionByName(again.select(*result.columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return result.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
