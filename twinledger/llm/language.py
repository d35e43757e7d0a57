"""Language identification: a byte convolutional network over fixed-length windows of whole texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import batches
from .shared import held_out, ship_package

WINDOW = 128
WIDTHS = (2, 3, 4)
STEP = WINDOW - WIDTHS[-1] + 1
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Byte embeddings, filters of several widths, max pooling over a window, softmax."""

    languages: list[str]
    embedding: np.ndarray  # (256, e)
    filters: list[np.ndarray]  # per width: (width * e, f)
    shifts: list[np.ndarray]  # per width: (f,)
    dense: np.ndarray  # (len(WIDTHS) * f, languages)
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width the filter responses to two bytes at a time, so that a filter is one or two lookups."""
        size = self.embedding.shape[1]
        out = []
        for width, weights in zip(WIDTHS, self.filters):
            single = [self.embedding @ weights[i * size : (i + 1) * size] for i in range(width)]
            pairs = [
                (single[i][:, None] + single[i + 1][None]).reshape(1 << 16, -1).astype(np.float32)
                for i in range(0, width - 1, 2)
            ]
            out.append(pairs + [single[-1].astype(np.float32)] * (width % 2))
        return out

    def window_probabilities(self, tables: list[list[np.ndarray]], data: np.ndarray) -> np.ndarray:
        """Per window of ``STEP`` bytes (a whole number of them, each text ending in zeros) the softmax."""
        padded = np.concatenate([data, np.zeros(WIDTHS[-1], dtype=np.uint8)])
        pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
        pooled = []
        for width, parts, shift in zip(WIDTHS, tables, self.shifts):
            response = parts[0][pairs[: len(data)]]
            if width > 2:
                response += parts[1][(pairs if width % 2 == 0 else padded)[2 : 2 + len(data)]]
            pooled.append(np.maximum(response.reshape(-1, STEP, response.shape[1]).max(axis=1) + shift, 0))
        return _softmax(np.concatenate(pooled, axis=1) @ self.dense + self.offset)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its mean probability over all windows, weighted by their bytes."""
        tables, names, scores = self.tables(), [], []
        for group in batches(texts, 1 << 18):
            data = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in group]
            lengths = np.array([len(d) for d in data])
            windows = (lengths + WIDTHS[-1] - 1 + STEP - 1) // STEP
            ends = np.cumsum(windows)
            means = np.zeros((len(group), len(self.languages)))
            buffer = np.zeros(ends[-1] * STEP, dtype=np.uint8)
            for d, end, n in zip(data, ends, windows):
                at = (end - n) * STEP
                buffer[at : at + len(d)] = np.frombuffer(d, dtype=np.uint8)
            # 2048 windows at a time: the responses of a very long text are never held together
            size = 2048 * STEP
            found = np.concatenate([self.window_probabilities(tables, buffer[i : i + size]) for i in range(0, len(buffer), size)])
            filled = (buffer.reshape(-1, STEP) > 0).sum(axis=1) + 1e-9
            owner = np.repeat(np.arange(len(group)), windows)
            for c in range(len(self.languages)):
                means[:, c] = np.bincount(owner, found[:, c] * filled, len(group)) / np.bincount(owner, filled, len(group))
            best = means.argmax(axis=1)
            for k, i in enumerate(group):
                known = texts[i] is not None and _LETTER.search(texts[i])
                names.append(self.languages[best[k]] if known else UNKNOWN)
                scores.append(min(float(means[k, best[k]]), 1.0) if known else 0.0)
        return names, np.array(scores)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], embedding: int = 8, filters: int = 16,
        steps: int = 600, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Train by Adam on ``windows`` (n, WINDOW) of bytes, zeros after the end; gradients by hand."""
    rng = np.random.default_rng(seed)
    shapes = [(256, embedding)] + [(w * embedding, filters) for w in WIDTHS] + [(filters,)] * len(WIDTHS)
    shapes += [(filters * len(WIDTHS), len(languages)), (len(languages),)]
    params = [rng.normal(0, 1 / np.sqrt(s[0]) if i else 0.5, s) if len(s) > 1 else np.zeros(s) for i, s in enumerate(shapes)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_class = [np.flatnonzero(labels == c) for c in range(len(languages))]
    for step in range(1, steps + 1):
        # Classes alike often, whatever their share; some windows cut short, as texts are.
        pick = np.array([rng.choice(by_class[c]) for c in rng.integers(0, len(languages), batch)])
        data = windows[pick].copy()
        cut = np.where(rng.random(batch) < 0.3, rng.integers(8, WINDOW, batch), WINDOW)
        data[np.arange(WINDOW) >= cut[:, None]] = 0
        table, kernels, shifts, dense, offset = params[0], params[1:4], params[4:7], params[7], params[8]
        seen = table[data]
        pooled, places = [], []
        for width, kernel, shift in zip(WIDTHS, kernels, shifts):
            rolled = np.concatenate([seen[:, i : WINDOW - width + 1 + i] for i in range(width)], axis=2)
            response = rolled @ kernel
            place = response.argmax(axis=1)
            best = np.take_along_axis(response, place[:, None], axis=1)[:, 0] + shift
            picked = rolled[np.arange(batch)[:, None], place]  # (batch, f, width * e)
            pooled.append(best)
            places.append((place, picked))
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        error = _softmax(hidden @ dense + offset)
        error[np.arange(batch), labels[pick]] -= 1
        error /= batch
        back = (error @ dense.T) * (hidden > 0)
        grads = [np.zeros_like(p) for p in params]
        grads[7], grads[8] = hidden.T @ error, error.sum(axis=0)
        for k, (width, (place, picked)) in enumerate(zip(WIDTHS, places)):
            part = back[:, k * filters : (k + 1) * filters]
            grads[1 + k] = np.einsum("bf,bfe->ef", part, picked)
            grads[4 + k] = part.sum(axis=0)
            to_bytes = (part[:, :, None] * kernels[k].T[None]).reshape(-1, embedding)
            at = place[:, :, None] + np.arange(width)
            np.add.at(grads[0], data[np.arange(batch)[:, None, None], at].ravel(), to_bytes)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, params[0], list(params[1:4]), list(params[4:7]), params[7], params[8])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = 800, windows_per_text: int = 4, max_languages: int = 256, **settings) -> ByteNet | None:
    """Learn from rows with a language whose crc32 of the id does not leave 2 modulo 4.

    The sample is bounded: about ``per_language`` texts of each of the ``max_languages`` most frequent
    languages, chosen by a hash of the id, and up to ``windows_per_text`` windows of each, spread over the
    whole text. Without such rows the result is None.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("id").isNotNull() & ~held_out(F.col("id"), 4, 2))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    counts = sorted((r["lang"], r["count"]) for r in counts)
    share = F.create_map([F.lit(x) for lang, n in counts for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))])
    chosen = rows.withColumn("place", F.xxhash64("id")).where(F.pmod("place", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")))

    def cut(frames):
        for frame in frames:
            out = []
            for place, text, lang in zip(frame["place"], frame["text"], frame["lang"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                n = min(windows_per_text, len(data) // WINDOW + 1)
                for k, start in enumerate(np.linspace(0, max(len(data) - WINDOW, 0), n).astype(int)):
                    out.append((place, k, lang, data[start : start + WINDOW].tobytes()))
            yield pd.DataFrame(out, columns=["place", "k", "lang", "data"])

    frame = chosen.select("place", "text", "lang").mapInPandas(cut, "place long, k int, lang string, data binary").toPandas()
    if frame.empty:
        return None
    frame = frame.sort_values(["place", "k", "lang", "data"], kind="stable")
    languages = sorted(set(frame["lang"]))
    windows = np.zeros((len(frame), WINDOW), dtype=np.uint8)
    for i, data in enumerate(frame["data"]):
        windows[i, : len(data)] = np.frombuffer(data, dtype=np.uint8)
    return fit(windows, np.searchsorted(languages, frame["lang"]), languages, **settings)


def identify(docs: DataFrame, model: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    A text is cut into windows of fixed length, all of which count; windows of many texts go through
    the network together. A null text, one without a letter, and any text where there was nothing to
    learn from is ``und`` with score 0. Rows with the same id each get a row. Only the two named
    columns are read.
    """

    def predicted(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            names, scores = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": names, "score": scores})

    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.withColumn("held_out", held_out(F.col("doc_id"), 4, 2)).select("doc_id", "held_out", "text").mapInPandas(
        predicted, "doc_id long, held_out boolean, lang_pred string, score double"
    )
