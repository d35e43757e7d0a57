"""Toxicity: character n-grams scaled by naive Bayes log-count ratios under a logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import ngrams
from .shared import Scratch

BUCKETS = 1 << 20
SIZES = (3, 4, 5)


def character_ngrams(texts: list) -> Iterator[np.ndarray]:
    """Buckets of all character 3- to 5-grams of the lower-cased text, with a blank at each end."""
    for text in texts:
        line = f" {text.lower()} " if text else "  "
        chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        gram, found = chars, []
        for n in range(2, SIZES[-1] + 1):
            if len(chars) < n:
                break
            gram = (gram[:-1] ^ (gram[:-1] >> 15)) * np.uint32(0x85EBCA6B) + chars[n - 1 :]
            if n >= SIZES[0]:
                bucket = (gram ^ (gram >> 13)) * np.uint32(0xC2B2AE35)
                found.append(bucket >> np.uint32(12))
        yield np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def logistic(labels: np.ndarray, rows: list[np.ndarray], ratios: np.ndarray, penalty: float, steps: int
             ) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on indicators times ``ratios`` (already multiplied back), and its bias."""
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    values = ratios.astype(np.float32)[columns]
    share = labels.mean()
    weights, bias = np.zeros(len(ratios)), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(owner, values * weights.astype(np.float32)[columns], len(rows))
        error = (ngrams.sigmoid(margin) - labels) / len(rows)
        gradient = np.append(np.bincount(columns, values * error.astype(np.float32)[owner], len(ratios)) + penalty * weights, error.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights * ratios, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2,
          max_rows: int = 3000, features: int = 1 << 14, penalty: float = 1e-4, steps: int = 100,
          id_col: str = "doc_id", text_col: str = "text") -> ngrams.Linear:
    """Learn from ``labels`` (``doc_id``, 0 or 1) of rows whose crc32 of the id does not leave ``part``.

    Class counts of all n-grams come from all labelled rows; the linear weights are fitted on about
    ``max_rows`` of them at most, sampled by class.
    """
    scratch = Scratch(docs.sparkSession)
    rows = ngrams.labelled_rows(docs, labels, label, parts, part, scratch, id_col, text_col)
    n, found = ngrams.class_counts(rows, character_ngrams, BUCKETS)
    if (constant := ngrams.prior(n, BUCKETS)) is not None:
        return constant
    feature, ratios = ngrams.log_count_ratios(n, found, features)
    marks, present, shift = ngrams.sampled_features(rows, character_ngrams, feature, n, max_rows)
    scratch.drop(rows)
    weights, bias = logistic(marks, present, ratios, penalty, steps)
    return ngrams.Linear(feature, weights.astype(np.float32), bias + shift)


def score(docs: DataFrame, model: ngrams.Linear, threshold: float = 0.3, parts: int = 4, part: int = 2,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have no n-gram and get the score of the bias alone; long texts are read
    whole. Rows with the same id each get a row. Without labels of both classes every score is the
    smoothed share of the one class (0.5 without any). Only the two named columns are read.
    """
    return ngrams.score_documents(docs, model, character_ngrams, parts, part, threshold, id_col, text_col)
