"""Packing of documents into sequences of bounded length, as a cutting-stock problem by column generation.

Whole sequences are cut off long documents first. What is left of each document is a piece whose length
falls into a bin. A pattern says how many pieces of each bin fill a sequence; how often each is used is a
linear program over the histogram of bins, whose patterns are priced by a knapsack dynamic program. The
rounded patterns then take pieces by their rank within the bin. The histogram has a bounded number of
bins whatever the number of documents, and it alone is what the driver sees.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .tokens import WordEncoder, word_encoder

_PLACE_BITS = 12  # rows are ranked within segments of so many rows of one task


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best total value of items of lengths 1, 2, ... (any number of each), and how many of each."""
    n = len(values)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    reversed_values = values[:n][::-1]
    for room in range(1, capacity + 1):
        m = min(n, room)
        sums = best[room - m : room] + reversed_values[n - m :]
        i = int(sums.argmax())
        best[room], choice[room] = sums[i], m - i
        if best[room - 1] >= best[room]:
            best[room], choice[room] = best[room - 1], 0
    pattern, room = np.zeros(len(values), dtype=np.int64), capacity
    while room:
        if choice[room]:
            pattern[choice[room] - 1] += 1
        room -= max(int(choice[room]), 1)
    return float(best[capacity]), pattern


def fractional_patterns(demand: np.ndarray, capacity: int, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used, fractions allowed, so that few sequences are used.

    ``demand[k]`` pieces have length ``k + 1``. The simplex method over all patterns: those in use are
    the basis, and the one that enters is priced by the knapsack with the dual values. It ends when the
    number of sequences is within ``tolerance``, or a quarter of a sequence, of the bound that the total length
    or the dual values prove. Demands are raised by less than a millionth of a piece, each by another
    amount, so that no two patterns run out together and the method cannot go round in circles.
    """
    lengths = np.flatnonzero(demand > 0)
    wanted = demand[lengths] + np.random.default_rng(0).uniform(1e-7, 1e-6, len(lengths))
    bound = wanted @ (lengths + 1) / capacity
    each = capacity // (lengths + 1)
    basis = np.diag(each).astype(float)
    inverse, used = np.diag(1.0 / each), wanted / each
    pivots = 0
    while True:
        dual = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[lengths] = dual
        best, pattern = knapsack(values, capacity)
        bound = max(bound, (dual * wanted).sum() / best)
        if best <= 1 + 1e-9 or used.sum() <= bound + max(0.25, tolerance * bound):
            break
        entering = pattern[lengths].astype(float)
        few = np.flatnonzero(entering)
        direction = (inverse[:, few] * entering[few]).sum(axis=1)
        steps = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(steps.argmin())
        if not np.isfinite(steps[leave]):
            break
        used = np.maximum(used - steps[leave] * direction, 0)
        used[leave] = steps[leave]
        basis[:, leave] = entering
        inverse[leave] /= direction[leave]
        direction[leave] = 0
        inverse -= direction[:, None] * inverse[leave]
        pivots += 1
        if pivots % 100 == 0 and np.abs((basis * used).sum(axis=1) - wanted).max() > 1e-7 * wanted.max():
            inverse = np.linalg.inv(basis)  # rounding errors have added up
            used = np.maximum((inverse * wanted).sum(axis=1), 0)
        if pivots > 50 * len(lengths) + 1000:
            break  # what there is can be used as it is, only more sequences than needed
    patterns = np.zeros((len(lengths), len(demand)), dtype=np.int64)
    patterns[:, lengths] = basis.T.round().astype(np.int64)
    return patterns, used


def _fullest(left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern with the longest piece that is left and whatever fills the rest best."""
    pattern = np.zeros_like(left)
    longest = int(np.flatnonzero(left)[-1])
    pattern[longest] = 1
    room = capacity - longest - 1
    # reached[r]: the length last added on the way to a filling of r, with pieces from long to short.
    reached = np.full(room + 1, -1)
    reached[0] = 0
    for k in np.flatnonzero(left)[::-1]:
        size = int(k) + 1
        for _ in range(min(int(left[k] - pattern[k]), room // size)):
            new = np.zeros(room + 1, dtype=bool)
            new[size:] = reached[: room + 1 - size] >= 0
            new &= reached < 0
            if not new.any():
                break
            reached[new] = size
        if reached[room] >= 0:
            break
    # Lengths fall on the way up, so going down takes each piece as often as it was added at most.
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        pattern[reached[at] - 1] += 1
        at -= int(reached[at])
    return np.minimum(pattern, left)


def whole_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of uses that take each piece exactly once."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if not left.any():
        return out
    patterns, used = fractional_patterns(left, capacity)
    whole = np.floor(used + 1e-6).astype(np.int64)
    for i in np.argsort(-used, kind="stable"):
        takes = patterns[i] > 0
        times = int(min(whole[i], (left[takes] // patterns[i][takes]).min())) if takes.any() else 0
        if times:
            out.append((patterns[i], times))
            left = left - times * patterns[i]
    for i in np.argsort(-(used - whole), kind="stable"):  # uses that rounding down left out, if pieces suffice
        if used[i] - whole[i] > 0.5 and (left >= patterns[i]).all():
            out.append((patterns[i], 1))
            left = left - patterns[i]
    while left.any():
        pattern = _fullest(left, capacity)
        takes = pattern > 0
        times = int((left[takes] // pattern[takes]).min())
        out.append((pattern, times))
        left = left - times * pattern
    return out


def allocation(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``length, from_rank, to_rank, sequence, each``: which ranks of a length go to which sequences.

    Rank ``r`` goes to sequence ``sequence + (r - from_rank) // each``. Pieces as long as a sequence have one
    of their own.
    """
    rows, sequence, taken = [], 0, np.zeros(len(demand), dtype=np.int64)
    for k in range(capacity - 1, len(demand)):
        rows.append((k + 1, 0, int(demand[k]), sequence, 1))
        sequence += int(demand[k])
    for pattern, times in whole_patterns(demand[: capacity - 1], capacity):
        for k in np.flatnonzero(pattern):
            n = int(pattern[k]) * times
            rows.append((int(k) + 1, int(taken[k]), int(taken[k]) + n, sequence, int(pattern[k])))
            taken[k] += n
        sequence += times
    return rows


def _encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``part, place, doc_id, n, ids``: token ids of every document, and where the row stood in its task."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    kind = WordEncoder(tokenizer_json).kind
    tail = np.array([end_id], dtype=kind).tobytes()

    def encoded(frames):
        encoder, part, place = word_encoder(tokenizer_json), TaskContext.get().partitionId(), 0
        for frame in frames:
            for start in range(0, len(frame), 500):
                some = frame.iloc[start : start + 500]
                ids = [b + tail for b in encoder.encode(some["text"].tolist())]
                n = np.array([len(b) for b in ids]) // len(tail)
                yield pd.DataFrame({"part": part, "place": place + np.arange(len(ids)), "doc_id": some["doc_id"].to_numpy(),
                                    "no_id": some["no_id"].to_numpy(), "n": n, "ids": ids})
                place += len(ids)

    doc_id = F.col(id_col).cast("bigint")
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(encoded, "part int, place long, doc_id long, no_id boolean, n long, ids binary"), kind


def _ranked(pieces: DataFrame, by: str) -> DataFrame:
    """``rank`` of each piece among those with equal ``by``, from 0.

    Pieces are numbered within segments of a few thousand documents of one task, and segments (a narrow row
    each) are added up per bin, so that a bin with a third of all pieces is never in one task.
    """
    segment = [by, "part", "segment"]
    counts = pieces.groupBy(*segment).agg(F.count(F.lit(1)).alias("in_segment"))
    earlier = Window.partitionBy(by).orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*segment, F.coalesce(F.sum("in_segment").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*segment).orderBy("place", "start")
    numbered = pieces.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(before, segment).withColumn("rank", F.col("before") + F.col("within")).drop("before", "within")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, grain: int = 8, fill: float = 0.97,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned 32-bit, little-endian).

    Documents are encoded whole, with ``end_id`` behind each; a null or empty text is that id alone. A sequence
    holds at most ``capacity`` ids. As many whole sequences as a document has are pieces of their own, the rest
    of it is one piece. Lengths are rounded up to multiples of ``grain`` for the patterns, so a sequence
    is padded by about half of that per piece. A sequence filled to less than ``fill`` (the last few) is cut at
    powers of two, which need no padding; only there is the rest of a document cut again.

    Sequence ids are unique, not consecutive. Rows without id, or that repeat one, are documents of
    their own, packed by their place in the table; equal files and settings give equal packings. Only the
    two named columns are read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    encoded, kind = _encoded(docs, tokenizer_path, end_id, id_col, text_col)
    encoded = scratch.write(encoded)
    units = -(-capacity // grain)
    # A sequence that is cut has as many parts as its length has binary digits, the largest power first.
    powers = [1 << i for i in reversed(range(max(capacity - 1, 1).bit_length()))]
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint")))
    length = F.least(F.col("n") - F.col("start"), F.lit(capacity))
    placed = encoded.select("part", "place", "n", start.alias("start")).select(
        "part", "place", F.shiftright("place", _PLACE_BITS).alias("segment"), "start", length.alias("length")
    )
    placed = placed.withColumn("bin", F.when(F.col("length") == capacity, units).otherwise(F.ceil(F.col("length") / grain)).cast("int"))
    ranked = scratch.write(_ranked(placed, "bin"))
    demand = np.zeros(units, dtype=np.int64)
    for r in ranked.groupBy("bin").count().collect():  # a row per bin
        demand[r["bin"] - 1] = r["count"]
    # As many rows as patterns have bins: some for each bin, however many pieces there are.
    rows = allocation(demand, capacity // grain)
    plan = F.broadcast(spark.createDataFrame(rows, "of_bin int, from_rank long, to_rank long, sequence long, each int"))
    fits = (F.col("bin") == F.col("of_bin")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    taken = ranked.join(plan, fits).select(
        "part", "place", "start", "length", "rank", "bin",
        F.expr(f"(sequence + (rank - from_rank) div each) * {len(powers) + 1}").alias("sequence_id"),
    )
    # At most `capacity` pieces share a sequence.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank")
    filled = taken.withColumn("end", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "used", F.sum("length").over(Window.partitionBy("sequence_id"))
    )
    filled = filled.withColumn("begin", F.col("end") - F.col("length"))
    bounds = F.array(*[F.struct(
        F.lit(i).alias("part"), (F.col("used") - F.col("used") % (2 * p)).alias("low"),
        (F.col("used") - F.col("used") % p).alias("high")) for i, p in enumerate(powers)])
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("low"), F.col("used").alias("high")))
    parts = F.when(F.col("used") >= math.ceil(fill * capacity), whole).otherwise(bounds)
    meets = F.filter(parts, lambda b: (b["low"] < b["high"]) & (b["low"] < F.col("end")) & (b["high"] > F.col("begin")))
    cut = filled.withColumn("b", F.explode(meets)).select(
        "part", "place", (F.col("start") + F.greatest(F.col("b.low") - F.col("begin"), F.lit(0))).alias("start"),
        (F.least("b.high", "end") - F.greatest("b.low", "begin")).alias("length"),
        (F.col("sequence_id") + F.col("b.part")).alias("sequence_id"),
        F.greatest(F.col("begin") - F.col("b.low"), F.lit(0)).alias("offset"),
    )
    # All pieces of a document together are no longer than its ids beside them.
    lists = cut.groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    lists = lists.select("part", "place", *[F.col(f"pieces.{c}").alias(c) for c in ("start", "length", "sequence_id", "offset")])
    joined = encoded.join(lists, ["part", "place"]).drop("part", "place")

    width = np.dtype(kind).itemsize

    def sliced(frames):
        for frame in frames:
            # A bounded number of bytes at a time, as they double here and some documents are very long.
            sizes = np.array([len(b) for b in frame["ids"]])
            for group in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(np.cumsum(sizes) >> 23)) + 1):
                some = frame.iloc[group]
                counts = np.array([len(s) for s in some["start"]])
                start, length, sequence, offset = (np.concatenate(some[c].to_list()) for c in ("start", "length", "sequence_id", "offset"))
                data = np.frombuffer(b"".join(some["ids"]), dtype=kind).astype("<u4").tobytes()
                first = np.repeat(np.cumsum(sizes[group]) - sizes[group], counts) // width + start
                doc_id = some["doc_id"].astype("Int64").mask(some["no_id"])
                yield pd.DataFrame({
                    "doc_id": doc_id.repeat(counts).array, "start": start, "length": length, "doc_tokens": np.repeat(some["n"].to_numpy(), counts),
                    "sequence_id": sequence, "offset": offset,
                    "ids": [data[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist())],
                })

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return joined.mapInPandas(sliced, schema)
