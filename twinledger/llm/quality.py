"""Quality: naive Bayes support vectors over n-grams of words and of word shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import ngrams
from .hashing import mixed, word_hashes
from .shared import Scratch

BUCKETS = 1 << 20
_KINDS = np.full(256, 8, dtype=np.uint8)  # punctuation
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 4, 16
_KINDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def _shapes(text: str, words: np.ndarray) -> np.ndarray:
    """For each word: the kinds of its bytes, its length class, whether it repeats the word before."""
    kinds = _KINDS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.concatenate(([False], kinds > 0, [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[0::2], change[1::2]
    shape = np.bitwise_or.reduceat(kinds, starts).astype(np.uint64)
    shape |= (kinds[starts] == 1).astype(np.uint64) << np.uint64(5)
    shape |= np.digitize(ends - starts, (2, 4, 7, 11, 21)).astype(np.uint64) << np.uint64(6)
    shape[1:] |= (words[1:] == words[:-1]).astype(np.uint64) << np.uint64(9)
    return shape


def word_ngrams(texts: list) -> Iterator[np.ndarray]:
    """Buckets of words, pairs of words, and one to three consecutive word shapes."""
    for text, words in zip(texts, word_hashes(texts, lower=False)):
        if not len(words):
            yield np.zeros(0, dtype=np.int64)
            continue
        found = [words, mixed(words[:-1] * np.uint64(5) + words[1:])]
        shape = _shapes(text, words)
        for n in (1, 2, 3):
            run = np.full(max(len(shape) - n + 1, 0), n, dtype=np.uint64)
            for i in range(n):
                run = run << np.uint64(10) | shape[i : len(shape) - n + 1 + i] if len(run) else run
            found.append(mixed(run + np.uint64(1 << 60)))
        yield (np.concatenate(found) >> np.uint64(44)).astype(np.int64)


def dual_coordinate_descent(labels: np.ndarray, rows: list[np.ndarray], ratios: np.ndarray, cost: float, passes: int,
                            seed: int = 0) -> tuple[np.ndarray, float]:
    """The hinge-loss linear model on indicators times ``ratios``; the bias is a feature that is always 1.

    Each row has one dual variable in [0, cost]; it moves to the optimum of its coordinate, and the
    weights follow. Rows come in a new seeded order in every pass.
    """
    signs = np.where(labels > 0, 1.0, -1.0)
    values = [ratios[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norms = np.array([(v * v).sum() + 1 for v in values])
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = signs[i] * (values[i] @ weights[rows[i]] + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            change = (new - alpha[i]) * signs[i]
            if change:
                weights[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return weights, bias


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps, smoothed targets)."""
    target = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = ngrams.sigmoid(slope * margins + offset)
        error, spread = p - target, p * (1 - p) + 1e-9
        g = np.array([(error * margins).sum() + 1e-3 * slope, error.sum()])
        h = np.array([[(spread * margins**2).sum() + 1e-3, (spread * margins).sum()], [(spread * margins).sum(), spread.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        slope, offset = slope - np.clip(step[0], -2, 2), offset - np.clip(step[1], -2, 2)
    return float(slope), float(offset)


class Quality(ngrams.Linear):
    """A linear model whose indicators are divided by the root of their number in the document."""

    def scores(self, extract, texts):
        margins = np.empty(len(texts))
        for i, buckets in enumerate(extract(texts)):
            present = ngrams._present(self.feature, buckets)
            margins[i] = self.weights[present].sum() / np.sqrt(max(len(present), 1))
        return ngrams.sigmoid(self.slope * margins + self.bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0,
          max_rows: int = 4000, features: int = 1 << 15, cost: float = 1.0, passes: int = 20,
          id_col: str = "doc_id", text_col: str = "text") -> ngrams.Linear:
    """Learn from ``labels`` (``doc_id``, 0 or 1) of rows whose crc32 of the id does not leave ``part``.

    Class counts of all n-grams come from all labelled rows. About ``max_rows`` of them at most, sampled by class, fit the
    hinge-loss model (four fifths) and the map from its margin to a probability (the rest).
    """
    scratch = Scratch(docs.sparkSession)
    rows = ngrams.labelled_rows(docs, labels, label, parts, part, scratch, id_col, text_col)
    n, found = ngrams.class_counts(rows, word_ngrams, BUCKETS)
    if (constant := ngrams.prior(n, BUCKETS)) is not None:
        return constant
    feature, ratios = ngrams.log_count_ratios(n, found, features)
    marks, present, shift = ngrams.sampled_features(rows, word_ngrams, feature, n, max_rows)
    scratch.drop(rows)
    # Every fifth row of each class is set aside; the first ones of either are always fitted.
    fit = np.where(marks > 0, np.cumsum(marks > 0), np.cumsum(marks == 0)) % 5 > 0
    weights, bias = dual_coordinate_descent(marks[fit], [p for p, f in zip(present, fit) if f], ratios, cost, passes)
    weights = weights * ratios
    check = ~fit if len(set(marks[~fit])) == 2 else fit
    margins = np.array([weights[p].sum() / np.sqrt(max(len(p), 1)) + bias for p, c in zip(present, check) if c])
    slope, offset = _platt(margins, marks[check])
    return Quality(feature, weights.astype(np.float32), slope * bias + offset + shift, slope)


def score(docs: DataFrame, model: ngrams.Linear, threshold: float = 0.3, parts: int = 5, part: int = 0,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and blank texts have no n-gram and get the score of the bias alone; long texts are read whole.
    Rows with the same id each get a row. Without labels of both classes every score is the smoothed
    share of the one class (0.5 without any). Only the two named columns are read.
    """
    return ngrams.score_documents(docs, model, word_ngrams, parts, part, threshold, id_col, text_col)
