"""Subword encoding of a merge-type vocabulary with seeded merge dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import batches
from .shared import ship_package

BLANK = "▁"
#: Blanks with what follows, up to the next blank or line feed: no piece reaches across these places.
_SEGMENT = regex.compile(r" +[^ \n]*|[^ \n]+|\n")
_SYMBOL = {" ": BLANK, BLANK: "\0mark"}
_MASK = (1 << 64) - 1
_NONE = (1 << 31) - 1
_SPREAD = 0x9E3779B97F4A7C15
_VARIANT = 0xC2B2AE3D27D4EB4F
#: Segments of up to so many characters are merged together.
_SIZES = (8, 12, 16, 24, 48)
#: Segments whose ids are looked up together: many, so that those with rare sets of skips still merge in large groups.
_TOGETHER = 1 << 18
#: A candidate is one number: its place, and below that its merge.
_MERGE_BITS = 26
_MERGE_MASK = (1 << _MERGE_BITS) - 1
_NO_SKIP = 1 << 30


def _skipped(key: int, place: int, merge: int, limit: int) -> bool:
    mixed = (key ^ (place * 0x165667B19E3779F9 + merge)) * 0xD6E8FEB86659FD93 & _MASK
    return ((mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 & _MASK) >> 32 < limit


def _skips(keys: np.ndarray, places: np.ndarray, merges: np.ndarray, limit: int) -> np.ndarray:
    """``_skipped`` of many candidates."""
    x = places.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + merges.astype(np.uint64)
    mixed = (keys ^ x) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32) < np.uint64(limit)


def variants_of(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A variant for each segment, by the hash of its document and its place there."""
    mixed = keys * np.uint64(0x9FB21C651E98DF25) + places.astype(np.uint64) * np.uint64(_SPREAD)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(32)) >> np.uint64(1)


@dataclass
class Pieces:
    """Ids and scores of the pieces, their order by score, the ids of single bytes, the bytes of every id."""

    pieces: dict[str, tuple[int, float]]
    order: dict[str, int]
    byte_ids: list[int]
    surface: list[bytes]
    kind: str = "<u2"
    seed: int = 0
    dropout: float = 0.1
    remember: int = 600_000
    outcomes: _Outcomes | None = None

    @classmethod
    def load(cls, path: str, **settings) -> Pieces:
        """Read a merge-type model file with byte fallback."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces, byte_ids, surface = {}, [-1] * 256, [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i, model.get_score(i)
                surface[i] = piece.replace(BLANK, " ").encode()
        if -1 in byte_ids:
            raise ValueError("the model has no byte fallback")
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("a piece of the model reaches across words")
        if len(pieces) > _MERGE_MASK:
            raise ValueError("the model has too many pieces")
        order = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: (-pieces[p][1], pieces[p][0])))}
        return cls(pieces, order, byte_ids, surface, "<u2" if size <= 1 << 16 else "<u4", **settings)

    def segment(self, text: str, variant: int) -> list[int]:
        """Ids of one segment (blanks as such): merges by score, then place, from an agenda.

        A candidate merge taken from the agenda is skipped if a hash of seed, variant, place and
        merged piece falls below the dropout; variant -1 skips none. Every occurrence of a segment has
        its own variant (``variants_of``).
        """
        # A literal mark in the text is spelt in bytes, as it would read back as a blank.
        symbols = [_SYMBOL.get(c, c) for c in text]
        ids, pieces = [], self.pieces
        for symbol in self._merged(symbols, *self._dropout(variant)):
            if symbol in pieces:
                ids.append(pieces[symbol][0])
            else:
                spelt = (BLANK if symbol == _SYMBOL[BLANK] else symbol).encode("utf-8", "surrogatepass")
                ids += [self.byte_ids[b] for b in spelt]
        return ids

    def _merged(self, symbols: list[str], key: int, limit: int) -> list[str]:
        order, n = self.order, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(order[x], i, x) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (x := a + b) in order]
        heapq.heapify(agenda)
        while agenda:
            best, i, joined = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != joined:
                continue  # one of its parts has merged otherwise
            if limit and _skipped(key, i, best, limit):
                continue
            symbols[i], symbols[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := joined + symbols[k]) in order:
                    heapq.heappush(agenda, (order[x], i, x))
            h = before[i]
            if h >= 0 and (x := symbols[h] + joined) in order:
                heapq.heappush(agenda, (order[x], h, x))
        return [s for s in symbols if s]

    def _dropout(self, variant: int) -> tuple[int, int]:
        """The key of the hash and the bound below which it skips a merge."""
        key = (self.seed * 0x9E3779B97F4A7C15 + variant * _VARIANT) & _MASK
        return key, int(self.dropout * (1 << 32)) if variant >= 0 else 0

    def segments(self, texts: list[str], variant: int) -> list[bytes]:
        """What ``segment`` gives for each, as bytes; all short ones together."""
        key, limit = self._dropout(variant)
        ids, counts = self._ids(texts, np.full(len(texts), variant), np.full(len(texts), key, dtype=np.uint64), limit)
        return self._cut(ids, np.cumsum(counts))

    def encode(self, texts: list[str | None], keys: list[int] | None = None) -> list[bytes]:
        """Ids of whole texts as little-endian integers; every segment has a variant of its own.

        It comes from the key of the document (a 64-bit hash) and the place of the segment in it.
        """
        split = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        ends = np.cumsum(sizes)
        places = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
        own = np.array(keys or [0] * len(texts), dtype=np.int64).astype(np.uint64)
        variants = variants_of(np.repeat(own, sizes), places)
        seed, limit = self._dropout(0)
        hashes = np.uint64(seed) + variants * np.uint64(_VARIANT)
        ids, counts = self._ids(list(chain.from_iterable(split)), variants, hashes, limit)
        return self._cut(ids, np.append(0, np.cumsum(counts))[ends])

    def _cut(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data, stops = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _ids(self, segments: list[str], variants: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and how many each has; ``keys`` are those of the hash."""
        parts, counts = [np.zeros(0, dtype=self.kind)], [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(segments), _TOGETHER):
            some = segments[start : start + _TOGETHER]
            if self.outcomes is None or self.outcomes.n > self.remember:
                pairs = self.outcomes.pairs if self.outcomes else _Pairs(self.pieces, self.order)
                self.outcomes = _Outcomes(pairs)
            known = self.outcomes
            node = known.find(some, keys[start : start + _TOGETHER], limit)
            n = np.where(node >= 0, known.n_ids.data[node], 0)
            single = {}
            for k in np.flatnonzero(node < 0).tolist():
                single[k] = self.segment(some[k], int(variants[start + k]))
                n[k] = len(single[k])
            begin = np.cumsum(n) - n
            source = np.repeat(np.where(node >= 0, known.ids_begin.data[node], 0) - begin, n) + np.arange(n.sum())
            ids = known.ids.data.take(source, mode="clip").astype(self.kind)
            for k, found in single.items():
                ids[begin[k] : begin[k] + n[k]] = found
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded: bytes of the pieces without the blank put before the text."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "surrogatepass")

    def __getstate__(self):
        return {**self.__dict__, "outcomes": None}


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind=np.int32):
        self.data, self.n = np.zeros(1 << 10, dtype=kind), 0

    def append(self, values: np.ndarray) -> int:
        """Where the first of the values is put."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(max(self.n, 2 * len(self.data)) - at, dtype=self.data.dtype)])
        self.data[at : self.n] = values
        return at


class _Outcomes:
    """What short segments merge to, for every choice of skipped candidates met so far.

    A node is a segment and the candidates skipped in it. It has the ids that result, and the candidates
    that the agenda gives after the last skipped one; each leads to the node where it is skipped as well.
    Which one an occurrence skips first is up to its own hash, so each gets what its own agenda gives,
    but the agenda of a node runs once.
    """

    def __init__(self, pairs: _Pairs):
        self.pairs = pairs
        self.root: dict[str, int] = {}
        self.texts: list[str] = []
        self.text, self.parent, self.skip, self.begin, self.count, self.ids_begin, self.n_ids = (_Rows() for _ in range(7))
        self.candidates, self.child, self.ids = _Rows(np.uint32), _Rows(), _Rows()

    @property
    def n(self) -> int:
        return max(self.text.n, len(self.root))

    def find(self, segments: list[str], keys: np.ndarray, limit: int) -> np.ndarray:
        """The node of each occurrence; -1 for segments that are long or have characters without a piece."""
        self._learn(list(set(segments).difference(self.root)))
        node = np.fromiter((self.root.get(s, -1) for s in segments), dtype=np.int64, count=len(segments))
        rows = np.flatnonzero(node >= 0) if limit else ()
        while len(rows):
            now = node[rows]
            count = self.count.data[now]
            owner = np.repeat(np.arange(len(rows)), count)
            at = np.arange(len(owner)) + np.repeat(self.begin.data[now] - (np.cumsum(count) - count), count)
            taken = self.candidates.data[at]
            hit = np.flatnonzero(_skips(keys[rows][owner], taken >> _MERGE_BITS, taken & _MERGE_MASK, limit))
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]
            rows = rows[owner[hit]]
            node[rows] = self._skipping(node[rows], at[hit])
        return node

    def _learn(self, new: list[str]) -> None:
        # Long segments are not kept: they may be many and differ all.
        short = [s for s in new if len(s) <= _SIZES[-1] and BLANK not in s]
        first = len(self.texts)
        self.texts += short
        none = np.full(len(short), -1)
        self.root.update(zip(short, self._add(np.arange(first, first + len(short)), none, none).tolist()))

    def _skipping(self, nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes where the candidates ``at`` are skipped as well."""
        new = np.flatnonzero(self.child.data[at] == 0)
        places, first = np.unique(at[new], return_index=True)
        parents = nodes[new[first]]
        skip = places - self.begin.data[parents] + self.skip.data[parents] + 1
        self.child.data[places] = self._add(self.text.data[parents], parents, skip)
        return self.child.data[at]

    def _add(self, texts: np.ndarray, parents: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """New nodes; -1 where a character has no piece."""
        nodes = np.full(len(texts), -1)
        lengths = np.array([len(self.texts[t]) for t in texts.tolist()], dtype=np.int64)
        sizes = np.array(_SIZES)[np.searchsorted(_SIZES, lengths)]
        for size in _SIZES:
            group = np.flatnonzero(sizes == size)
            for start in range(0, len(group), 1 << 13):
                some = group[start : start + (1 << 13)]
                chars = np.array([self.texts[t].replace(" ", BLANK) for t in texts[some].tolist()], dtype=f"<U{size}")
                symbols = self.pairs.symbols(chars.view("<u4").reshape(-1, size), lengths[some])
                plain = (symbols != self.pairs.unknown).all(axis=1)
                symbols, some = symbols[plain], some[plain]
                above, last = parents[some], skips[some]
                final, taken, n = self.pairs.merge(symbols, self._all_skips(above, last))
                number = np.arange(taken.shape[1])
                later = (number > last[:, None]) & (number < n[:, None])
                count, n_ids = later.sum(axis=1), (final >= 0).sum(axis=1)
                begin = self.candidates.append(taken[later]) + np.cumsum(count) - count
                self.child.append(np.zeros(count.sum(), dtype=np.int32))
                ids_begin = self.ids.append(final[final >= 0]) + np.cumsum(n_ids) - n_ids
                for rows, values in ((self.parent, above), (self.skip, last), (self.begin, begin), (self.count, count),
                                     (self.ids_begin, ids_begin), (self.n_ids, n_ids)):
                    rows.append(values)
                nodes[some] = self.text.append(texts[some]) + np.arange(len(some))
        return nodes

    def _all_skips(self, parents: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The numbers of all candidates to skip, in ascending order, and one that never comes."""
        columns, up = [np.full(len(last), -1), last], parents
        while (up >= 0).any():
            columns.append(np.where(up >= 0, self.skip.data[up], -1))
            up = np.where(up >= 0, self.parent.data[up], -1)
        numbers = np.stack(columns, axis=1)
        return np.sort(np.where(numbers < 0, _NO_SKIP, numbers), axis=1)


class _Pairs:
    """Which two pieces merge to which, in a hash table of arrays, and merging many short segments at once."""

    BITS = 20

    def __init__(self, pieces: dict[str, tuple[int, float]], order: dict[str, int]):
        self.unknown = len(pieces) + (1 << 20)
        single = {ord(p): i for p, (i, _) in pieces.items() if len(p) == 1}
        self.alphabet = np.full(max(single) + 2, self.unknown, dtype=np.int64)
        self.alphabet[list(single)] = list(single.values())
        found = [
            (pieces[p[:k]][0], pieces[p[k:]][0], order[p], i)
            for p, (i, _) in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces
        ]
        size = 1 << self.BITS
        self.keys = np.full(size, -1, dtype=np.int64)
        self.order, self.result = np.full(size, _NONE, dtype=np.int32), np.zeros(size, dtype=np.int32)
        left, right, rank, merged = np.array(found, dtype=np.int64).reshape(-1, 4).T
        keys = left << 32 | right
        at = (keys.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):  # each pair takes the first free place; of several at one place, one does
            free = open_[self.keys[at[open_]] < 0]
            self.keys[at[free]] = keys[free]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = (at[open_] + 1) % size
        self.order[at], self.result[at] = rank, merged

    def symbols(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of single characters; -1 after the end."""
        ids = self.alphabet[np.minimum(chars, len(self.alphabet) - 1)]
        used = np.arange(chars.shape[1]) < sizes[:, None]
        return np.where(used, ids, -1)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; a free place where there is no such pair."""
        keys = left.astype(np.int64) << 32 | right
        at = (keys.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (self.keys[at[open_]] >= 0)]
        return at

    def merge(self, symbols: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All merges of each row of ``symbols`` but the candidates whose numbers are in its row of ``skips``.

        What merged into its left neighbour becomes -1. The others say which candidates (place and merge)
        came from the agenda of each row, and how many.
        """
        n, size = symbols.shape
        # One column more, always empty, stands for what is beyond either end.
        flat = np.full((n, size + 1), -1, dtype=np.int32)
        flat[:, :size] = symbols
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.append(np.arange(-1, size - 1), 0).astype(np.int32), (n, 1))
        before[:, 0] = size
        place = np.full((n, size + 1), -1, dtype=np.int32)
        agenda = np.full((n, size + 1), _NONE, dtype=np.int32)
        both = np.nonzero((flat[:, :-1] >= 0) & (flat[:, 1:] >= 0))
        found = self._find(flat[both], flat[both[0], both[1] + 1])
        agenda[both], place[both] = self.order[found], found
        # Each of at most size - 1 merges makes two candidates at most.
        taken, number, passed = np.zeros((n, 3 * size), dtype=np.uint32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        final = np.full((n, size), -1, dtype=np.int32)
        # Arrays have the rows that still have candidates; rows[k] is the number of the k-th of them.
        rows = np.arange(n)
        while len(rows):
            i = agenda.argmin(axis=1)
            here = np.arange(len(rows))
            best = agenda[here, i]
            going = best != _NONE
            if not going.all():
                done = ~going
                final[rows[done]] = flat[done, :size]
                if going.sum() < 0.8 * len(rows) or not going.any():
                    rows, i, best = rows[going], i[going], best[going]
                    flat, after, before, place, agenda = (x[going] for x in (flat, after, before, place, agenda))
                    here = np.arange(len(rows))
                else:
                    here, i, best = here[going], i[going], best[going]
            real = rows[here]
            count = number[real]
            taken[real, count] = i << _MERGE_BITS | best
            skipped = count == skips[real, passed[real]]
            number[real] += 1
            passed[real[skipped]] += 1
            agenda[here[skipped], i[skipped]] = _NONE
            now, i = here[~skipped], i[~skipped]
            j = after[now, i]
            k = after[now, j]
            flat[now, i] = self.result[place[now, i]]
            flat[now, j], agenda[now, j], agenda[now, i] = -1, _NONE, _NONE
            after[now, i] = k
            inside = k < size
            before[now[inside], k[inside]] = i[inside]
            left, right = np.concatenate([i, before[now, i]]), np.concatenate([k, i])
            twice = np.concatenate([now, now])
            ok = np.flatnonzero((left < size) & (right < size))
            r, a, b = twice[ok], left[ok], right[ok]
            one, other = flat[r, a], flat[r, b]
            ok = np.flatnonzero(other >= 0)
            r, a = r[ok], a[ok]
            found = self._find(one[ok], other[ok])
            agenda[r, a], place[r, a] = self.order[found], found
        return final, taken, number


def _keyed(docs: DataFrame, model: Pieces, id_col: str, text_col: str, pass_col: str | None) -> DataFrame:
    own = [F.col(id_col).cast("bigint"), F.col(text_col), *([F.col(pass_col).cast("bigint")] if pass_col else [])]
    key = F.xxhash64(*own, F.lit(model.seed)).alias("key")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), key)


def _encoded(frames: Iterator[pd.DataFrame], model: Pieces) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, keys, rows = frame["text"].tolist(), frame["key"].tolist(), frame["doc_id"]
        for group in batches(texts):
            ids = model.encode([texts[i] for i in group], [keys[i] for i in group])
            yield pd.DataFrame({"doc_id": rows.iloc[group].reset_index(drop=True), "ids": ids})


def encode_documents(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text",
                     pass_col: str | None = None) -> DataFrame:
    """``doc_id, ids`` (little-endian integers of the model's width) of every whole text.

    Null and empty texts have no ids. Equal seeds give equal ids wherever and how often it runs; rows
    with the same id and text are encoded alike unless ``pass_col`` tells them apart. Only the named
    columns are read.
    """
    ship_package(docs.sparkSession)

    def encoded(frames):
        yield from _encoded(frames, model)

    return _keyed(docs, model, id_col, text_col, pass_col).mapInPandas(encoded, "doc_id long, ids binary")


_DECODED = "doc_id long, n_pieces long, ids_crc32 long, text string, ids binary"


def _decoded(frame: pd.DataFrame, model: Pieces) -> pd.DataFrame:
    ids = [np.frombuffer(b, dtype=model.kind) for b in frame["ids"]]
    return pd.DataFrame({
        "doc_id": frame["doc_id"], "n_pieces": [len(i) for i in ids],
        "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids], "text": [model.decode(i) for i in ids],
        "ids": frame["ids"],
    })


def decode_documents(encoded: DataFrame, model: Pieces) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, text, ids`` from ``doc_id, ids``."""
    ship_package(encoded.sparkSession)

    def decoded(frames):
        for frame in frames:
            yield _decoded(frame, model)

    return encoded.select("doc_id", "ids").mapInPandas(decoded, _DECODED)


def round_trip(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text",
               pass_col: str | None = None) -> DataFrame:
    """What ``decode_documents`` gives of ``encode_documents``, by one Python worker a task instead of two."""
    ship_package(docs.sparkSession)

    def both(frames):
        for frame in _encoded(frames, model):
            yield _decoded(frame, model)

    return _keyed(docs, model, id_col, text_col, pass_col).mapInPandas(both, _DECODED)
