"""Text classifiers over hashed n-gram indicators scaled by naive Bayes log-count ratios.

The parts that toxicity and quality share: how labelled rows are joined, counted and sampled, and how a
linear model is applied. What differs is the n-grams and how the linear model is fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, held_out, ship_package

#: From texts to, one at a time, the bucket numbers of the n-grams of each (with repeats).
Extractor = Callable[[list], "Iterator[np.ndarray]"]
_CHUNKS = 256


@dataclass
class Linear:
    """``weights`` over the chosen features, whose buckets ``feature`` maps (-1: not chosen)."""

    feature: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0

    def scores(self, extract: Extractor, texts: list) -> np.ndarray:
        margins = np.empty(len(texts))
        for i, buckets in enumerate(extract(texts)):
            margins[i] = self.bias + self.weights[_present(self.feature, buckets)].sum()
        return sigmoid(self.slope * margins)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _present(feature: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    found = feature[buckets]
    return np.unique(found[found >= 0])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, scratch: Scratch,
                  id_col: str, text_col: str) -> DataFrame:
    """Text and label of all rows that may be learned from, written once to the shared folder.

    Null labels are left out, repeated labels of an id count once (as 1 if they differ).
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    # Both grow with the data: always the join that shuffles, whatever the size of the labels.
    joined = texts.join(known.hint("merge"), texts.doc_id == known.label_id)
    return scratch.write(joined.select("text", "label", F.xxhash64("doc_id").alias("place")))


def class_counts(rows: DataFrame, extract: Extractor, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all labelled rows: documents of each class, and of those with each n-gram: (2,), (2, buckets).

    Every task sends the counts that are not zero, in chunks of buckets small enough that the counts of
    all tasks for one chunk are added up in little memory.
    """
    width = buckets // _CHUNKS

    def count(frames):
        found, docs = np.zeros((2, buckets), dtype=np.int32), np.zeros(2, dtype=np.int64)
        for frame in frames:
            for label, present in zip(frame["label"], extract(frame["text"].tolist())):
                found[label, present] += 1  # a bucket that repeats within the document counts once
                docs[label] += 1
        if docs.any():
            rows = []
            for i in range(_CHUNKS):
                chunk = found[:, i * width : (i + 1) * width].ravel()
                place = np.flatnonzero(chunk)
                rows.append((i, place.astype(np.int32).tobytes(), chunk[place].astype(np.int64).tobytes(), docs[0], docs[1]))
            yield pd.DataFrame(rows, columns=["chunk", "place", "counts", "n0", "n1"])

    def add(frame):
        total = np.zeros(2 * width, dtype=np.int64)
        for place, counts in zip(frame["place"], frame["counts"]):
            total[np.frombuffer(place, dtype=np.int32)] += np.frombuffer(counts, dtype=np.int64)
        place = np.flatnonzero(total)
        return pd.DataFrame({
            "chunk": frame["chunk"][:1], "place": [place.astype(np.int32).tobytes()], "counts": [total[place].tobytes()],
            "n0": [frame["n0"].sum()], "n1": [frame["n1"].sum()],
        })

    schema = "chunk int, place binary, counts binary, n0 long, n1 long"
    sums = rows.select("text", "label").mapInPandas(count, schema).groupBy("chunk").applyInPandas(add, schema).toPandas()
    docs, found = np.zeros(2, dtype=np.int64), np.zeros((_CHUNKS, 2 * width), dtype=np.int64)
    for chunk, place, counts, n0, n1 in sums.itertuples(index=False):
        docs[:] = n0, n1
        found[chunk, np.frombuffer(place, dtype=np.int32)] = np.frombuffer(counts, dtype=np.int64)
    return docs, found.reshape(_CHUNKS, 2, width).transpose(1, 0, 2).reshape(2, buckets)


def log_count_ratios(docs: np.ndarray, found: np.ndarray, features: int, smooth: float = 0.5
                     ) -> tuple[np.ndarray, np.ndarray]:
    """The map from buckets to chosen features, and the log-count ratio of each chosen feature.

    Chosen are the ``features`` buckets whose log-odds differ most from zero in units of their
    standard error, so that neither a rare nor an uninformative n-gram takes a place.
    """
    inside = found + smooth
    outside = docs[:, None] - found + smooth
    odds = np.log((inside[1] * outside[0]) / (inside[0] * outside[1]))
    error = np.sqrt((1 / inside).sum(axis=0) + (1 / outside).sum(axis=0))
    strength = np.where(found.sum(axis=0) > 1, np.abs(odds) / error, 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:features])
    chosen = chosen[strength[chosen] > 1]
    feature = np.full(found.shape[1], -1, dtype=np.int32)
    feature[chosen] = np.arange(len(chosen))
    totals = inside[:, chosen] / inside.sum(axis=1, keepdims=True)
    return feature, np.log(totals[1] / totals[0])


def class_quotas(n: np.ndarray, max_rows: int) -> np.ndarray:
    """How many rows of each class are sampled: in proportion, but of the rarer class a tenth or all it has."""
    if n.sum() <= max_rows:
        return n.copy()
    rare = int(n[1] < n[0])
    quotas = np.empty(2, dtype=np.int64)
    quotas[rare] = min(n[rare], max(round(max_rows * n[rare] / n.sum()), max_rows // 10, 1))
    quotas[1 - rare] = min(n[1 - rare], max(max_rows - quotas[rare], 1))
    return quotas


def sampled_features(rows: DataFrame, extract: Extractor, feature: np.ndarray, n: np.ndarray, max_rows: int
                     ) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Labels and feature numbers of about ``max_rows`` labelled rows at most, and a shift of the log-odds.

    Of each class those with the smallest hashes of the id are chosen (``class_quotas``), so both are there
    if ``n``, the rows of each, says so. The shift turns log-odds at the rates of the sample into those at the rates of ``n``.
    """
    chosen = rows
    for label, (there, quota) in enumerate(zip(n.tolist(), class_quotas(n, max_rows).tolist())):
        if quota < there:
            places = rows.where(F.col("label") == label).select("place").orderBy("place").limit(quota).collect()
            chosen = chosen.where((F.col("label") != label) | (F.col("place") <= places[-1][0]))

    def extracted(frames):
        for frame in frames:
            found = [_present(feature, b).astype(np.int32).tobytes() for b in extract(frame["text"].tolist())]
            yield pd.DataFrame({"place": frame["place"], "label": frame["label"], "found": found})

    frame = chosen.mapInPandas(extracted, "place long, label int, found binary").toPandas()
    frame = frame.sort_values(["place", "label"], kind="stable")
    labels = frame["label"].to_numpy()
    found = np.bincount(labels, minlength=2)
    shift = float(np.log(n[1] * found[0] / (n[0] * found[1])))
    return labels, [np.frombuffer(b, dtype=np.int32) for b in frame["found"]], shift


def score_documents(docs: DataFrame, model: Linear, extract: Extractor, parts: int, part: int, threshold: float,
                    id_col: str, text_col: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; each whole text is read, nothing else."""

    def scored(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"],
                                "score": model.scores(extract, frame["text"].tolist())})

    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    out = texts.mapInPandas(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def prior(docs: np.ndarray, buckets: int) -> Linear | None:
    """A constant model where there is no row of one of the classes, else None."""
    if docs.all():
        return None
    share = (docs[1] + 0.5) / (docs.sum() + 1)
    return Linear(np.full(buckets, -1, dtype=np.int32), np.zeros(1), float(np.log(share / (1 - share))))
