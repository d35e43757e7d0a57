"""The registered queries of these operators, each over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, exact, language, lines, minhash, mixing, packing, pieces, quality, spelling, tokens, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_aggregate([CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END FOR x IN embedding], 'sum') = 0
    AND list_aggregate([abs(x) FOR x IN embedding], 'max') > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id,
       e.vec_id = component_id AS kept
FROM embeddings e JOIN component ON a = e.vec_id"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = tokens.write_shards(_table(spark, sf_dir, "documents"), tokens.tokenizer_file())
    return tokens.read_shards(listing).drop("ids")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(_table(spark, sf_dir, "documents")))


def op7_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and read back: numbers of pieces, a checksum of the ids, and of the text they decode to."""
    model = pieces.Pieces.load(tokens.tokenizer_file("piece_bpe_32k.model"))
    decoded = pieces.round_trip(_table(spark, sf_dir, "documents"), model)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"), words=2)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b
    ON a.e = b.e AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN component ON a = doc_id"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (
  SELECT k.*, coalesce(k.doc_id > r.first, false) AS dropped
  FROM keyed k LEFT JOIN (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2) r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)"""


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_of = packing.pack(_table(spark, sf_dir, "documents"), tokens.tokenizer_file())
    return pieces_of.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the operator's result, the deviation as long (null beyond that)."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_token_output": op5_token_output,
    "op6_source_mixing": op6_source_mixing,
    "op7_subwords": op7_subwords,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_packing": op11_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op2_embedding_dedup": OP2_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
