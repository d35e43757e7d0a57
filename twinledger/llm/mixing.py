"""Mixing sources to target weights by a low-discrepancy schedule of slots over shuffled blocks of documents."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_CLASS, Scratch

#: The golden ratio's fraction of 2**64: slot k lies at k times it, modulo 2**64.
_GOLDEN = 0x9E3779B97F4A7C15
_SEGMENT_BITS = 12


@dataclass
class Share:
    """One source: its words, the words it shall give, and how its stream is cut into blocks."""

    source: str | None
    size: int
    target: float
    block: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)


def shares(sizes: dict[str | None, int], weights: tuple[int, ...], max_passes: int, block_tokens: int) -> list[Share]:
    """Targets: all sizes shared by weight, no source above ``max_passes`` times its size, the excess reshared.

    Sources are in order of code points, null last; the weights repeat over them.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target: dict[str | None, Fraction] = {}
    rest, open_ = Fraction(sum(sizes.values())), set(names)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > max_passes * sizes[s]]
        for s in full or list(open_):
            target[s] = Fraction(max_passes * sizes[s]) if full else weight[s] * unit
            rest -= target[s]
            open_.remove(s)
    # A source of few words has smaller blocks, so that it too has slots enough to come near its target.
    fine = {s: int(min(sizes[s], target[s])) // 256 for s in names}
    return [Share(s, sizes[s], float(target[s]), max(1, min(block_tokens, fine[s]))) for s in names]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3, block_tokens: int = 1024,
        seed: int = 0, max_sources: int = 100_000, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The placed documents and the mix.

    Placed: one row per document, ``doc_id, size, source_no, source_size, target, start``, where ``start``
    is the document's place (in words) in the shuffled stream of its source. Mix: ``slot, pass, source_no,
    start, doc_id, from_word, n_words``: in order of ``slot``, which words of which document come.

    Each source's documents are shuffled by a seeded hash and its stream is cut into blocks of equal
    numbers of words. Slot k of the schedule lies at the fraction k times the golden ratio of the sources'
    cumulative shares, which names its source; the slot's rank among that source's slots names the block
    (rank modulo blocks) and the pass. Slots are numbered within segments of 4096 and documents summed
    within buckets of a hash, so neither a hot source nor the whole schedule is ever in one task;
    only totals of segments and buckets are added up by source. The sources themselves are a catalogue
    of at most ``max_sources`` rows, which is what the driver handles and what is broadcast.

    Null and blank texts have size 0 and are not in the mix. Null is a source like any other. Rows that repeat
    an id are documents of their own. An empty table gives two empty results. Only the three named
    columns are read. Equal seeds give equal mixes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.write(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_CLASS)), F.lit(0)).cast("bigint").alias("size"),
    ))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    plan = shares({r["source"]: r["size"] for r in totals}, weights, max_passes, block_tokens)
    catalogue = F.broadcast(spark.createDataFrame(
        [(i, s.source, s.size, s.target, s.block, s.blocks) for i, s in enumerate(plan)],
        "source_no int, source_name string, source_size long, target double, block_words long, blocks long",
    ))

    bits = min(24, max(8, ceil(log2(max(sum(r["n"] for r in totals), 1) / 4096))))
    known = sized.join(catalogue, F.col("source").eqNullSafe(F.col("source_name"))).select(
        "doc_id", "size", "source_no", "source_size", "target", "block_words", F.xxhash64(F.lit(seed), "doc_id").alias("order")
    ).withColumn("bucket", F.shiftrightunsigned("order", 64 - bits))
    in_bucket = Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "size")
    in_source = Window.partitionBy("source_no").orderBy("bucket")
    buckets = scratch.write(known.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")))
    buckets = buckets.withColumn("bucket_start", F.sum("words").over(in_source) - F.col("words")).drop("words")
    placed = scratch.write(
        known.withColumn("before", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(buckets, ["source_no", "bucket"])
        .select("doc_id", "size", "source_no", "source_size", "target", "block_words",
                (F.col("bucket_start") + F.col("before")).alias("start"))
    )

    slots = _schedule(spark, plan, max_passes, catalogue)
    last = F.expr("(start + size - 1) div block_words")
    pieces = placed.where("size > 0").select(
        "source_no", "start", "doc_id", "size", "block_words",
        F.explode(F.sequence(F.expr("start div block_words"), last)).alias("block"),
    )
    begin = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    mixed = slots.join(pieces, ["source_no", "block"]).select(
        "slot", "pass", "source_no", "start", "doc_id", (begin - F.col("start")).alias("from_word"),
        (end - begin).alias("n_words"),
    )
    return placed.drop("block_words"), mixed


def _schedule(spark, plan: list[Share], max_passes: int, catalogue: DataFrame) -> DataFrame:
    """``slot, source_no, block, pass`` for every slot."""
    wanted = np.array([s.target / s.block for s in plan])
    total = int(round(wanted.sum()))
    limits = np.cumsum(wanted) / max(wanted.sum(), 1e-300)

    def assigned(frames):
        for frame in frames:
            slot = frame["id"].to_numpy()
            point = (slot.astype(np.uint64) * np.uint64(_GOLDEN) >> np.uint64(11)).astype(np.float64) / 2.0**53
            source = np.minimum(np.searchsorted(limits, point, side="right"), len(limits) - 1)
            yield pd.DataFrame({"slot": slot, "source_no": source})

    parts = max(1, min(total >> _SEGMENT_BITS, 1000))
    slots = spark.range(0, total, 1, parts).mapInPandas(assigned, "slot long, source_no int")
    slots = slots.withColumn("segment", F.shiftright("slot", _SEGMENT_BITS))
    counts = slots.groupBy("source_no", "segment").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("source_no").orderBy("segment")
    before = counts.select("source_no", "segment", (F.sum("n").over(by_source) - F.col("n")).alias("earlier"))
    within = Window.partitionBy("source_no", "segment").orderBy("slot")
    ranked = (
        slots.withColumn("rank", F.row_number().over(within) - 1)
        .join(before, ["source_no", "segment"])
        .withColumn("rank", F.col("rank") + F.col("earlier"))
        .join(catalogue.select("source_no", "blocks"), "source_no")
    )
    # The schedule is off by a few slots at most; none may begin a pass too many.
    ranked = ranked.where(F.col("rank") < F.col("blocks") * max_passes)
    return ranked.select(
        "slot", "source_no", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("pass")
    )


def taken(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: per document the words that the mix takes, repeats counted."""
    words = mixed.groupBy("source_no", "start").agg(F.sum("n_words").alias("words"))
    words = words.withColumn("has_words", F.lit(True))
    marked = placed.withColumn("has_words", F.col("size") > 0)
    joined = marked.join(words, ["source_no", "start", "has_words"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))
