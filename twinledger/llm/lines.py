"""Line dedup: lines found in several documents are dropped from all but the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, Scratch, lower_ascii


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text, n_lines, n_dropped`` with the text that is left.

    A text is split at ``\\n``. Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` distinct documents lose all their lines, except in the document with the smallest id.

    Lines are exploded once into narrow rows (id, position, 128-bit key hash) in the shared folder.
    Counting combines in the tasks before its shuffle. The join of lines with repeated keys is
    split by adaptive execution where a key is hot. Only positions of dropped lines come back to the
    documents, whose text crosses one shuffle.

    Null and empty texts are one empty line. A null id counts as the largest; a line in documents
    without id only is kept. Rows with the same id are one document for counting, and each
    keeps a row of its own in the result. Only the two named columns are read. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("row_hash", F.xxhash64("text"))
    keyed = (
        texts.select("doc_id", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))
    )
    lines = scratch.write(keyed)
    by_key = lines.groupBy("h1", "h2")
    no_id = F.count_if(F.col("doc_id").isNull()) > 0
    if min_docs == 2:  # two ids differ when the smallest and the largest do: no distinct count needed
        counted = by_key.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), no_id.alias("no_id"))
        often = (F.col("first") < F.col("last")) | F.col("no_id")
    else:
        counted = by_key.agg(F.min("doc_id").alias("first"), F.countDistinct("doc_id").alias("n"), no_id.alias("no_id"))
        often = F.col("n") + F.col("no_id").cast("int") >= min_docs
    # Written, so that both sides of the next join are plain shuffles, which can be split for a hot key.
    repeated = scratch.write(counted.where(F.col("first").isNotNull() & often).select("h1", "h2", "first"))
    dropped = (
        lines.join(repeated, ["h1", "h2"])
        .where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
        .groupBy(F.col("doc_id").alias("d_id"), F.col("row_hash").alias("d_hash"))
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = texts.join(
        dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row_hash") == F.col("d_hash")), "left"
    )
    parts = joined.select(
        "doc_id", F.split("text", "\n", -1).alias("lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    return parts.select(
        "doc_id", left.alias("text"), F.size("lines").cast("bigint").alias("n_lines"),
        F.size("dropped").cast("bigint").alias("n_dropped"),
    )
