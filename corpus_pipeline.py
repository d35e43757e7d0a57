"""A training corpus from raw documents: each stage applies one operator to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm import exact, minhash, mixing, pieces, tokens, toxicity
from twinledger.llm.shared import Scratch


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id is in ``ids`` (one column, null is an id too)."""
    ids = ids.select(F.col(ids.columns[0]).alias("__kept_id"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3 stay; the model learns from the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, toxicity.score(docs, model).where("predicted = 0").select("doc_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return _only(docs, exact.exact_groups(docs).where("kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarities of 0.8 or more (5-word shingles) the smallest id stays."""
    return _only(docs, minhash.near_groups(docs).where("kept").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole documents.

    A document whose words the mix takes half or less of once is left out, as is one without words; one
    that it takes twice comes as two equal rows.
    """
    taken = mixing.taken(*mixing.mix(docs))
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    times = taken.where("taken > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max(times).alias("__times"))
    joined = docs.join(times.where("__times > 0"), F.col("doc_id").eqNullSafe(F.col("__id")))
    repeated = joined.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of every document (little-endian), and a checksum of the text they decode to.

    Rows that the mix repeats are numbered, so that each pass has its own merge dropout.
    """
    model = pieces.Pieces.load(tokens.tokenizer_file("piece_bpe_32k.model"))
    equal = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    numbered = docs.select("doc_id", "text", F.row_number().over(equal).alias("pass"))
    decoded = pieces.round_trip(numbered, model, pass_col="pass")
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("subword encoding", encode_pieces),
]

# Classifier scores and tokenizer output are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
