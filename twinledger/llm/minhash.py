"""Near-duplicate documents: b-bit minhash signatures under a multi-index Hamming join, links confirmed on full sets.

A signature has ``chunks * values`` minhashes of 16 bits; the distance of two is the number of values that
differ. Signatures are split into chunks. With ``errors`` errors allowed per chunk, two signatures that
differ in fewer than ``chunks * (errors + 1)`` values agree, in one chunk at least, up to ``errors`` values
(pigeonhole). The allowed errors are enumerated as keys: a chunk without each choice of ``errors`` values.
So every pair under that distance shares a key, and a pair of similarity 0.8 exactly shares one with a
probability above 0.9999.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .hashing import mixed, shingles, word_hashes
from .shared import Scratch

_SKETCH = 64
_RANDOM = np.random.default_rng(31)
_FLIPS = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n) minhashes of non-empty sets of mixed 64-bit hashes."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), dtype=np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((values ^ _FLIPS[k]) * _FACTORS[k], starts)
    return mixed(out)


def chunk_keys(values: np.ndarray, chunks: int, errors: int) -> np.ndarray:
    """(rows, keys): each chunk of 16-bit values without each choice of ``errors`` of them, hashed."""
    rows, n = values.shape
    place = np.arange(n, dtype=np.uint64) << np.uint64(32)
    parts = mixed((values >> np.uint64(48)) | place).reshape(rows, chunks, n // chunks)
    whole = parts.sum(axis=2)
    left_out = list(combinations(range(n // chunks), errors))
    keys = [mixed(whole - parts[:, :, list(c)].sum(axis=2) + np.uint64(i)) for i, c in enumerate(left_out)]
    return np.stack(keys, axis=2).reshape(rows, -1)


def _signatures(docs: DataFrame, words: int, values: int) -> DataFrame:
    """``doc_id, n_shingles, set_1, set_2, sketch, values``: size, 128-bit hash and signature of each set."""

    def signed(frames):
        for frame in frames:
            texts, rows = frame["text"].tolist(), []
            for start in range(0, len(texts), 512):
                some = [shingles(w, words) for w in word_hashes(texts[start : start + 512])]
                filled = [s for s in some if len(s)]
                signs = iter(minhashes(filled, max(values, _SKETCH)) if filled else ())
                for s in some:
                    if not len(s):
                        rows.append((0, 0, 0, 0, b""))
                        continue
                    sign = next(signs)
                    sketch = np.packbits(sign[:_SKETCH].astype(np.uint8) & 1).view(np.int64)[0]
                    sums = s.sum(dtype=np.uint64), mixed(s + np.uint64(7)).sum(dtype=np.uint64)
                    rows.append((len(s), *(int(x.astype(np.int64)) for x in sums), int(sketch), sign[:values].tobytes()))
            columns = ["n_shingles", "set_1", "set_2", "sketch", "values"]
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out

    schema = "doc_id long, n_shingles long, set_1 long, set_2 long, sketch long, values binary"
    return docs.mapInPandas(signed, schema)


def _keyed(signed: DataFrame, values: int, chunks: int, errors: int) -> DataFrame:
    """``key, id, n, sketch`` for every key of every signature."""

    def keyed(frames):
        for frame in frames:
            if len(frame):
                signs = np.frombuffer(b"".join(frame["values"]), dtype=np.uint64).reshape(-1, values)
                keys = chunk_keys(signs, chunks, errors)
                n = keys.shape[1]
                yield pd.DataFrame({"key": keys.ravel().astype(np.int64), **{c: np.repeat(frame[c].to_numpy(), n) for c in ("id", "n", "sketch")}})

    return signed.select("id", "n", "sketch", "values").mapInPandas(keyed, "key long, id long, n long, sketch long")


def _sketch_bound(percent: int) -> int:
    """Of 64 bits about 32 * (1 - similarity) differ; the bound lies six standard deviations above."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(_SKETCH * p + 6 * np.sqrt(_SKETCH * p * (1 - p))))


def _plausible(percent: int, other: str = "other_"):
    """Sizes that allow the similarity, and sketches as near as nearly all such pairs have them."""
    small, large = F.least("n", f"{other}n"), F.greatest("n", f"{other}n")
    return (small * 100 >= large * percent) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col(f"{other}sketch"))) <= _sketch_bound(percent))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough. ``texts`` has ``id, text``."""

    def linked(frames):
        for frame in frames:
            keep = np.zeros(len(frame), dtype=bool)
            for start in range(0, len(frame), 256):
                some = frame.iloc[start : start + 256]
                both = [[shingles(w, words) for w in word_hashes(some[c].tolist())] for c in ("text_a", "text_b")]
                for i, (x, y) in enumerate(zip(*both), start):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield frame.loc[keep, ["a", "b"]]

    sides = [texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    # hinted, as texts are never small at scale: the plan is the same at every size
    joined = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(linked, "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int = 8, values_per_chunk: int = 5,
                errors: int = 1, block_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    A document's set are its distinct shingles of ``words`` words (A-Z lower-cased), the whole sequence
    where it has fewer. Documents are linked where 100 * intersection >= ``percent`` * union of the full
    sets; ``component_id`` is the smallest id reachable.

    Equal sets become one row first, so copies are never paired. Two passes over the key buckets then find
    the links. The first pairs every row with one pivot of its bucket, and full sets decide. The second takes
    the buckets that still hold several components: their rows travel with their sets, and all rows of
    different components are compared in numpy; what leaves the task is a row per member, never one per pair.
    A bucket of more than ``block_rows`` rows is cut into blocks, each pair of which is a task of its own, so a
    hot bucket is split, never gathered. In either pass bounds on the sizes and on a 64-bit sketch come first.

    Null and blank texts have no set: ``n_shingles`` 0, linked with nothing. A null id is in the group of
    its text but never its smallest (kept only where the group has no id). Ids are taken to be unique;
    rows that repeat one get a row each. Only the two named columns are read; empty in, empty out.
    """
    scratch = Scratch(docs.sparkSession)
    values = chunks * values_per_chunk
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.write(_signatures(texts, words, values))
    same_set = ["set_1", "set_2", "n_shingles"]
    sets = scratch.write(signed.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("rep")))
    assigned = scratch.write(signed.join(sets.where("rep IS NOT NULL"), same_set, "left").select(
        "doc_id", "n_shingles", "rep", "sketch", F.when(F.col("doc_id") == F.col("rep"), F.col("values")).alias("values")
    ))
    scratch.drop(signed, sets)

    reps = assigned.where("values IS NOT NULL").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sketch", "values")
    rows = _keyed(reps, values, chunks, errors)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(F.xxhash64("id")).alias("first")).where("rows > 1")
    rows = scratch.write(rows.join(scratch.write(shared), "key").withColumn("order", F.xxhash64("id")).drop("rows"))

    pivots = rows.where("order = first").select("key", *(F.col(c).alias(f"other_{c}") for c in ("id", "n", "sketch")))
    near = _plausible(percent) & (F.col("id") != F.col("other_id"))
    pairs = scratch.write(rows.join(pivots, "key").where(near).select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct())
    involved = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts, scratch)
    links = scratch.write(_confirmed(pairs, involved, words, percent))
    scratch.drop(pairs, involved)

    # A row takes the first pivot it is linked with as label, then that pivot's label: equal labels are connected.
    pivot = links.groupBy(F.col("a").alias("id")).agg(F.min(F.xxhash64("b")).alias("label"))
    further = pivot.select(F.xxhash64("id").alias("label"), F.col("label").alias("next"))
    labels = scratch.write(pivot.join(further, "label", "left").select(F.col("id").alias("l_id"), F.coalesce("next", "label").alias("label")))
    labelled = scratch.write(rows.join(labels, F.col("id") == F.col("l_id"), "left").select(
        "key", "id", "n", "sketch", F.coalesce("label", "order").alias("label")
    ))
    scratch.drop(rows)
    # Two rows of one bucket have met as row and pivot; larger buckets with several labels are gone through whole.
    members = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = F.expr(f"CAST((rows + {block_rows - 1}) div {block_rows} AS INT)").alias("blocks")
    open_ = scratch.write(labelled.join(scratch.write(members.where("rows > 2 AND low < high").select("key", blocks)), "key"))
    scratch.drop(labelled)
    more = scratch.write(_block_links(open_, texts, words, percent, scratch))
    scratch.drop(open_)
    found = scratch.write(components(links.unionByName(more), scratch))

    result = assigned.join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _texts_of(ids: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, text`` of the documents in ``ids``, written."""
    ids = ids.distinct()
    return scratch.write(texts.join(ids.hint("merge"), texts.doc_id == ids.id).select("id", "text"))


def _block_links(rows: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: members of the buckets in ``rows`` with the smallest id they are linked to, over any steps."""

    def with_sets(frames):
        for frame in frames:
            sets = [shingles(w, words).tobytes() for w in word_hashes(frame["text"].tolist())]
            yield pd.DataFrame({"set_id": frame["id"], "elements": sets})

    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "sketch", "label"
    )
    sets = scratch.write(_texts_of(rows.select("id"), texts, scratch).mapInPandas(with_sets, "set_id long, elements binary"))
    wide = dealt.join(sets.hint("merge"), F.col("id") == F.col("set_id")).drop("set_id")
    run = ["key", "low", "high"]

    def compared(frames):
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            names = frame[run].to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cuts))
            kept = frame.iloc[bounds[-1] :]  # the last bucket may go on in the next batch
            yield from _linked_runs(frame, bounds, percent)
        if kept is not None:
            yield from _linked_runs(kept, np.array([0, len(kept)]), percent)

    return wide.repartition(*run).sortWithinPartitions(*run).mapInPandas(compared, "a long, b long")


def _linked_runs(frame: pd.DataFrame, bounds: np.ndarray, percent: int):
    """Links of the buckets that begin at ``bounds`` (all but the last of these)."""
    sets = [np.frombuffer(e, dtype=np.uint64) for e in frame["elements"]]
    ids, n, sketch, label, own, low, high = (frame[c].to_numpy() for c in ("id", "n", "sketch", "label", "own", "low", "high"))
    for start, end in zip(bounds[:-1], bounds[1:]):
        at = slice(start, end)
        apart = label[at, None] != label[at]
        if low[start] != high[start]:
            apart &= own[at, None] != own[at]
        apart &= np.minimum(n[at, None], n[at]) * 100 >= np.maximum(n[at, None], n[at]) * percent
        apart &= np.bitwise_count(sketch[at, None] ^ sketch[at]) <= _sketch_bound(percent)
        members = np.flatnonzero(apart.any(axis=1))
        if not len(members):
            continue
        common = _intersections([sets[start + m] for m in members])
        sizes = n[at][members]
        linked = apart[np.ix_(members, members)] & (100 * common >= percent * (sizes[:, None] + sizes - common))
        least = names = ids[at][members]
        while True:
            lower = np.minimum(least, np.where(linked, least, np.iinfo(np.int64).max).min(axis=1))
            if (lower == least).all():
                break
            least = lower
        if (least != names).any():
            yield pd.DataFrame({"a": names, "b": least})[least != names]


def _intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of incidence matrices of the shared elements."""
    elements, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, number = row[number >= 0], number[number >= 0]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for start in range(0, int(shared.sum()), columns):
        some = (number >= start) & (number < start + columns)
        inside = np.zeros((len(sets), columns), dtype=np.float32)
        inside[row[some], number[some] - start] = 1
        common += inside @ inside.T
    return common
