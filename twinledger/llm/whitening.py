"""Whitening of vectors from an exact covariance: bit planes of integers, AND and popcount.

Entries become integers. A batch of rows is packed dimension by dimension into planes: plane ``p`` of a
dimension holds bit ``p`` of its (shifted, so never negative) integers, 64 rows to a word. The sum of products
of two dimensions is then the sum over pairs of planes of ``2 ** (p + q)`` times the number of rows with both
bits, which is exact, like all that follows up to the division that makes the covariance.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

_ROWS = 8192  # rows packed together
_BLOCK = 1 << 19  # 64-bit words of one comparison of planes
_LIMIT = 1 << 50  # integers are held within this, so that sums of products fit a decimal
_FLAT = 1e-10  # an eigenvalue below this share of the largest one counts as none


def shifted_integers(vectors: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """``floor(scale * c) + shift`` of doubles as int64, held within 2**50 on both sides."""
    with np.errstate(over="ignore"):
        floors = np.floor(vectors * scale)
    return np.clip(floors, -float(_LIMIT), float(_LIMIT)).astype(np.int64) + shift


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of unsigned integers (rows by dimensions): planes by dimensions by words of 64 rows."""
    rows = -(-len(values) // 64) * 64
    bits = int(values.max(initial=0)).bit_length()
    out = np.zeros((bits, values.shape[1], rows // 64), dtype=np.uint64)
    padded = np.zeros((values.shape[1], rows), dtype=np.uint8)
    for p in range(bits):
        padded[:, : len(values)] = (values >> np.uint64(p)).T & np.uint64(1)
        out[p] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    return out


def cross_products(values: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of all pairs of dimensions, as Python integers."""
    planes = planes_of(values)
    bits, size, words = planes.shape
    # Within 63 bits the weighted counts are added up in int64, else as Python integers.
    small = 2 * bits + max(len(values), 1).bit_length() < 62
    total = np.zeros((size, size), dtype=np.int64 if small else object)
    step = max(1, _BLOCK // max(size * words, 1))
    for p in range(bits):
        for q in range(bits):
            weight = 1 << (p + q)
            for start in range(0, size, step):
                both = planes[p, start : start + step, None, :] & planes[q, None, :, :]
                counts = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
                total[start : start + step] += (counts if small else counts.astype(object)) * weight
    return total.astype(object)


@dataclass
class Scatter:
    """Number of rows, sums per dimension and sums of products, all exact."""

    size: int
    n: int = 0
    sums: np.ndarray | None = None
    products: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        low = x.min(axis=0)
        lifted = (x - low).astype(np.uint64)
        n, low = len(x), low.astype(object)
        raised = np.array([int(c.sum(dtype=np.uint64)) if c.max() < 1 << 44 else sum(map(int, c)) for c in lifted.T], dtype=object)
        products = cross_products(lifted) + np.outer(raised, low) + np.outer(low, raised) + n * np.outer(low, low)
        sums = raised + n * low
        self.sums = sums if self.n == 0 else self.sums + sums
        self.products = products if self.n == 0 else self.products + products
        self.n += n

    def rows(self):
        """As rows ``i, j, value``: the number of rows at (-1, -1), sums at (i, -1), products at i <= j."""
        yield -1, -1, self.n
        for i in range(self.size):
            yield i, -1, self.sums[i]
            for j in range(i, self.size):
                yield i, j, self.products[i, j]


@dataclass(frozen=True)
class Whitener:
    """What the fit list determines for vectors of one size."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray  # a column per component
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int], products: list[list[int]], components: int) -> Whitener:
        """Components of the covariance ``(n * products - sums x sums) / n**2``, centred as integers."""
        size = len(sums)
        centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
        covariance = np.array([[c / (n * n) for c in row] for row in centred])  # each division rounds once
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > _FLAT * max(values.max(), 0.0)]
        trace = sum(centred[i][i] for i in range(size)) / (n * n)
        return cls(n, tuple(sums), vectors[:, order], values[order], values[order] / trace if trace else values[order])

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows, and for each the exact sum over dimensions of ``(n * x - sums) ** 2``."""
        middle = np.array([round(s / self.n) if abs(s) < 1 << 50 else s // self.n for s in self.sums], dtype=np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, middle)]  # below n in size
        gap = x - middle
        if np.abs(gap).max(initial=0) < 1 << 20 and self.n < 1 << 36:
            offset = np.array(rest, dtype=np.int64)
        else:
            gap, offset = gap.astype(object), np.array(rest, dtype=object)
        squares, mixed = (gap * gap).sum(axis=1).tolist(), (gap * offset).sum(axis=1).tolist()
        rest_squared = sum(r * r for r in rest)
        deviation = [self.n * self.n * a - 2 * self.n * b + rest_squared for a, b in zip(squares, mixed)]
        centred = gap.astype(np.float64) - np.array([r / self.n for r in rest])
        return centred @ self.basis / np.sqrt(self.values), deviation


def _integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of rows whose vector is there and finite in all entries."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")).where(finite)


def _by_size(frame: pd.DataFrame, scale: float, shift: int):
    """Numbers of the rows of each vector size, and their integers."""
    sizes = np.array([len(v) for v in frame["vector"]], dtype=np.int64)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        for start in range(0, len(rows), _ROWS):
            some = rows[start : start + _ROWS]
            yield int(size), some, shifted_integers(np.stack(frame["vector"].iloc[some].to_list()), scale, shift)


def fit(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000,
        id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Whitener]:
    """The whitener of each vector size, from exact sums over all rows.

    A task sends one row per pair of dimensions however many rows it has; the sums of those are added up by
    Spark, and the driver gets one total per pair. So what it gets is bounded by the square of the size.
    """

    def summed(frames):
        scatters: dict[int, Scatter] = {}
        for frame in frames:
            for size, _, x in _by_size(frame, scale, shift):
                scatters.setdefault(size, Scatter(size)).add(x)
        for size, scatter in scatters.items():
            i, j, value = zip(*scatter.rows())
            yield pd.DataFrame({"size": size, "i": i, "j": j, "value": [Decimal(v) for v in value]})

    parts = _integers(vectors, id_col, vector_col).select("vector").mapInPandas(summed, "size int, i int, j int, value decimal(38,0)")
    totals = parts.groupBy("size", "i", "j").agg(F.sum("value").alias("value")).collect()
    by_size: dict[int, dict[tuple[int, int], int]] = {}
    for r in totals:
        by_size.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["value"])
    return {
        size: Whitener.of(t[-1, -1], [t[i, -1] for i in range(size)],
                          [[t[min(i, j), max(i, j)] for j in range(size)] for i in range(size)], components)
        for size, t in by_size.items()
    }


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    An entry ``c`` (as double) counts as ``x = floor(scale * c) + shift``. With ``n`` vectors and the sums ``S``
    of their entries, ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``, exact. Components are
    the unit eigenvectors of the covariance of ``x`` (divisor ``n``) by falling eigenvalue, from 1, at most
    ``components``; ``whitened`` is ``x - S / n`` projected on one, over the root of its eigenvalue, and
    ``explained`` the eigenvalue's share of the trace. ``identity_error`` is the largest absolute entry of the
    covariance of ``whitened``, measured on the rows, less the identity.

    Rows whose vector is null or holds a null or non-finite entry are dropped. Vectors of each size are a fit
    list of their own. Directions without variance (eigenvalue below 1e-10 of the largest, so all of them
    where all vectors are equal) are no components, and empty vectors have none. Rows that repeat an id,
    or have none, are rows like any other. Integers are held within 2**50 on both sides; a deviation of
    more than 38 digits is null. Only the two named columns are read; an empty table gives an empty
    result.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = _integers(vectors, id_col, vector_col)
    whiteners = fit(vectors, components, scale, shift, id_col, vector_col)

    def projected(frames):
        for frame in frames:
            for size, some, x in _by_size(frame, scale, shift):
                values, deviation = whiteners[size].apply(x)
                yield pd.DataFrame({
                    "vec_id": frame["vec_id"].iloc[some].astype("Int64"), "size": size,
                    "deviation": [Decimal(d) if d < 10**38 else None for d in deviation], "whitened": list(values),
                })

    whitened = scratch.write(rows.mapInPandas(projected, "vec_id long, size int, deviation decimal(38,0), whitened array<double>"))
    # Whitened entries have mean zero by construction, so products need no second centring.
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    entry = [F.sum(F.get("whitened", F.lit(a)) * F.get("whitened", F.lit(b))) / F.count(F.lit(1)) for a, b in pairs]
    off = F.array_max(F.array(*[F.abs(e - float(a == b)) for e, (a, b) in zip(entry, pairs)]))
    error = {r["size"]: r["error"] for r in whitened.groupBy("size").agg(off.alias("error")).collect()}
    facts = [
        (size, i + 1, w.n, float(w.explained[i]), error[size])
        for size, w in whiteners.items() for i in range(len(w.values))
    ]
    facts = vectors.sparkSession.createDataFrame(facts, "of_size int, component int, n long, explained double, identity_error double")
    # One row per vector size and component, as the driver made it.
    each = whitened.join(F.broadcast(facts), F.col("size") == F.col("of_size"))
    value = F.get("whitened", F.col("component") - 1)
    return each.select("vec_id", "component", "n", "deviation", value.alias("whitened"), "explained", "identity_error")
