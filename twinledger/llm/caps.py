"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction; a vector is in it if their inner product exceeds a bound ``t``. Two vectors with a
high cosine are together in some filter almost surely if there are enough of them, while others rarely
are. The directions form a product code: the space is cut into blocks, each has a small random code, and
a direction is one codeword per block. So all filters of a vector are listed by extending partial sums
block by block and dropping those that cannot reach the bound, without looking at every direction.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import Scratch


def _tail(t: float) -> float:
    return 0.5 * erfc(t / sqrt(2))


def _both(t: float, cosine: float) -> float:
    """The share of directions that exceed ``t`` for both of two unit vectors with this cosine."""
    x = np.linspace(t, t + 8, 4001)
    density = np.exp(-x * x / 2) / sqrt(2 * np.pi)
    spread = sqrt(max(1 - cosine * cosine, 1e-12))
    upper = np.array([_tail((t - cosine * v) / spread) for v in x])
    return float(np.trapezoid(density * upper, x))


@dataclass(frozen=True)
class Code:
    """Bound, number of blocks, codewords per block, and how many independent codes there are."""

    bound: float
    blocks: int
    words: int
    codes: int

    @classmethod
    def fitting(cls, vectors: int, cosine: float, shared: int, per_filter: float = 4.0) -> Code:
        """A filter holds about ``per_filter`` of so many unrelated vectors.

        A pair at ``cosine`` is expected to share one filter of each code and ``shared`` of all. Filters of
        one code depend on each other, so many small codes miss far fewer pairs than one large code.
        """
        low, high = 1.5, 7.0
        while high - low > 1e-3:
            middle = (low + high) / 2
            low, high = (middle, high) if vectors * _tail(middle) > per_filter else (low, middle)
        filters = 1 / _both(low, cosine)
        blocks = 2 if filters < 1e8 else 3
        return cls(low, blocks, ceil(filters ** (1 / blocks)), shared)

    def codewords(self, size: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """A random rotation, which evens out the blocks, and the codewords of each block."""
        random = np.random.default_rng([number, size, self.words])
        rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
        return rotation, [random.normal(size=(len(part), self.words)) for part in np.array_split(np.arange(size), min(self.blocks, size))]

    def filters(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``units`` and the filters they are in, in order of both."""
        found = [self._filters(units, number) for number in range(self.codes)]
        row = np.concatenate([r for r, _ in found])
        name = np.concatenate([n + k * self.words**self.blocks for k, (_, n) in enumerate(found)])
        order = np.lexsort((name, row))
        return row[order], name[order]

    def _filters(self, units: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        rotation, code = self.codewords(units.shape[1], number)
        turned = units @ rotation
        edges = np.cumsum([0] + [len(c) for c in code])
        scores = [turned[:, a:b] @ c for a, b, c in zip(edges, edges[1:], code)]
        rest = np.cumsum([np.zeros(len(units))] + [s.max(axis=1) for s in scores[:0:-1]], axis=0)[::-1]
        row, name, total = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
        for score, reach in zip(scores, rest):
            parts = []
            for start in range(0, max(len(row), 1), 4096):
                r, n, s = row[start : start + 4096], name[start : start + 4096], total[start : start + 4096]
                sums = score[r] + s[:, None]
                i, word = np.nonzero(sums >= (self.bound - reach[r])[:, None])
                parts.append((r[i], n[i] * self.words + word, sums[i, word]))
            row, name, total = (np.concatenate(p) for p in zip(*parts))
        return row, name


def _scaled(values: np.ndarray) -> np.ndarray:
    """Doubles scaled by a power of two, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(values).max(axis=1))
    return np.ldexp(values, -exponent[:, None])


def _linked(vectors: np.ndarray, cosine: float) -> np.ndarray:
    values = _scaled(vectors.astype(np.float64))
    norms = np.sqrt((values * values).sum(axis=1))
    linked = values @ values.T / (norms[:, None] * norms) >= cosine
    np.fill_diagonal(linked, False)
    return linked


def _bucket_links(ids, weights, vectors, lists, sides, name, cosine):
    """For the members of a filter that have links: weights first seen here, and the smallest id they reach."""
    linked = _linked(vectors, cosine)
    if sides is not None:
        linked &= sides[:, None] != sides
    members = np.flatnonzero(linked.any(axis=1))
    if not len(members):
        return None
    linked, ids, weights = linked[np.ix_(members, members)], ids[members], weights[members]
    # A pair counts in the first filter it shares: not here if it shares an earlier one.
    earlier = [f[: np.searchsorted(f, name)] for f in (lists[m] for m in members)]
    known, column = np.unique(np.concatenate(earlier), return_inverse=True)
    inside = np.zeros((len(members), len(known)), dtype=np.float32)
    inside[np.repeat(np.arange(len(members)), [len(e) for e in earlier]), column] = 1
    new = linked & (inside @ inside.T == 0)
    label = ids.copy()
    while True:
        least = np.minimum(label, np.where(linked, label, np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            return ids, new @ weights, label
        label = least


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block_rows: int = 1024, shared: int = 24,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are linked where their cosine in double precision is at least ``cosine``. Equal vectors become
    one row with a weight first. Every vector goes to all its filters; the members of a filter are compared
    with each other in numpy, and what leaves the task is a row per member (the number of links not seen
    in an earlier filter, the smallest id reached), never a row per pair. A filter with more than
    ``block_rows`` members is cut into blocks, and each pair of blocks is a task of its own. The filters are
    chosen for the number of vectors, so that unrelated vectors seldom meet at any size. A pair at exactly
    ``cosine`` is expected to share ``shared`` filters; closer ones share more.

    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing, nor do
    rows without id; vectors of different lengths do not link. Rows that repeat an id are vectors of their
    own (with the same component where their vectors are linked). Only the two named columns are
    read; empty in, empty out.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    vector = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(id_col).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(usable, vector).alias("vector"))
    hashes = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(i), "vector")).alias(f"h{i}") for i in (1, 2)]
    rows = scratch.write(rows.select("vec_id", "vector", *hashes))
    copies = scratch.write(
        rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    )
    assigned = scratch.write(rows.join(copies, ["h1", "h2"], "left").select(
        "vec_id", "rep", "weight", F.when(F.col("vec_id") == F.col("rep"), F.col("vector")).alias("vector")
    ))
    scratch.drop(rows)
    code = Code.fitting(max(copies.count(), 1), cosine, shared)

    def decoded(frames):
        for frame in frames:
            sizes = np.array([len(v) for v in frame["vector"]])
            for size in np.unique(sizes):
                some = frame[sizes == size]
                for start in range(0, len(some), 512):
                    part = some.iloc[start : start + 512]
                    values = np.stack(part["vector"].to_list()).astype(kind)
                    units = _scaled(values.astype(np.float64))
                    units /= np.sqrt((units * units).sum(axis=1))[:, None]
                    row, name = code.filters(units)
                    lists = np.split(name, np.searchsorted(row, np.arange(1, len(part))))
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "weight": part["weight"].to_numpy(),
                                        "vector": [v.tobytes() for v in values], "filters": lists})

    reps = assigned.where("vector IS NOT NULL").dropDuplicates(["rep"]).select("rep", "weight", "vector")
    filter_type = "int" if code.codes * code.words**code.blocks < 1 << 31 else "long"
    reps = scratch.write(reps.mapInPandas(decoded, f"rep long, weight long, vector binary, filters array<{filter_type}>"))
    places = reps.select("rep", F.octet_length("vector").alias("size"), F.explode("filters").alias("filter"))
    full = places.groupBy("filter", "size").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    full = scratch.write(full.select("filter", "size", F.expr(f"CAST((members + {block_rows - 1}) div {block_rows} AS INT)").alias("blocks")))
    # The blocks of a large filter: a row takes part in each pair of blocks that has its own.
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        places.join(full, ["filter", "size"]).withColumn("own", own)
        .select("rep", "filter", "size", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("rep", "filter", "size", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    )
    wide = dealt.join(reps, "rep").repartition("filter", "size", "low", "high").sortWithinPartitions("size", "filter", "low", "high")

    def compared(frames):
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            key = frame[["size", "filter", "low", "high"]].to_numpy()
            last = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            kept = frame.iloc[cut:]  # the last filter may go on in the next batch
            if cut:
                for _, some in frame.iloc[:cut].groupby("size"):
                    yield from _compared(some, kind, cosine)
        if kept is not None and len(kept) > 1:
            yield from _compared(kept, kind, cosine)

    links = scratch.write(wide.mapInPandas(compared, "rep long, links long, least long"))
    found = scratch.write(components(links.select(F.col("rep").alias("a"), F.col("least").alias("b")), scratch))
    counts = scratch.write(links.groupBy(F.col("rep").alias("c_rep")).agg(F.sum("links").alias("links")))
    result = assigned.join(found, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("c_rep"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return result.select(
        "vec_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _compared(frame: pd.DataFrame, kind: str, cosine: float):
    """``rep, links, least`` of all members of the frame's filters (or pairs of blocks) that have links."""
    key = frame[["filter", "low", "high"]].to_numpy()
    starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
    sizes = np.diff(np.append(starts, len(frame)))
    ids, weights, own = (frame[c].to_numpy() for c in ("rep", "weight", "own"))
    data, lists = frame["vector"].to_list(), frame["filters"].to_list()
    found = []
    for start, size in zip(starts[(near := _near_runs(data, starts, sizes, kind, cosine))], sizes[near]):
        part = slice(start, start + size)
        values = np.frombuffer(b"".join(data[part]), dtype=kind).reshape(size, -1)
        name, low, high = key[start]
        sides = None if low == high else own[part]
        found.append(_bucket_links(ids[part], weights[part], values, lists[part], sides, name, cosine))
    found = [f for f in found if f is not None]
    if found:
        rep, links, least = (np.concatenate(c) for c in zip(*found))
        yield pd.DataFrame({"rep": rep, "links": links, "least": least})


def _near_runs(data: list[bytes], starts: np.ndarray, sizes: np.ndarray, kind: str, cosine: float) -> np.ndarray:
    """Which filters may hold a link: the small ones all at once in single precision, the others as they are."""
    large = sizes > 32
    values = _scaled(np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1).astype(np.float64))
    units = (values / np.sqrt((values * values).sum(axis=1))[:, None]).astype(np.float32)
    run = np.repeat(np.arange(len(starts)), sizes)
    near = large.copy()
    for step in range(1, int(min(sizes.max(), 32))):
        i = np.flatnonzero((run[step:] == run[:-step]) & ~large[run[step:]])
        for part in np.array_split(i, len(i) // 65536 + 1):
            dots = np.einsum("ij,ij->i", units[part], units[part + step])
            near[run[part[dots > cosine - 1e-4]]] = True
    return near
