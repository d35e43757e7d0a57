"""Spelling variants: words one letter apart, found with a bit-sliced index of letters by position.

The index of a set of words holds, for each position and letter, a bitset of the words that have that
letter there. For a query word three sets follow from it position by position, for all words of the index at
once: those without an error so far, those with one replaced letter, and those with one letter more, whose
later letters stand one place further on.

Two words one letter apart share their first or their last letters: if the shorter one (or both) has ``m``
letters, at least ``m // 2`` on one side. So words meet in blocks of equal length and equal beginning, and
of equal reversed beginning, and each task indexes the blocks it has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

_RUN = re.compile("[a-zÀ-ÿ]+")
_SLICE = 1 << 17  # 64-bit words of one state array worked on at a time


def count_runs(text: str | None, doc_id: int | str | None, erase_every: int = 97) -> Counter:
    """How often each run of letters occurs in a text, after its lowering and seeded deletions.

    A run is erased at one place where the crc32 of ``<doc_id>:<run>`` is a multiple of ``erase_every`` (0:
    never), which depends on the document and the run only, so all its occurrences change alike.
    """
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = Counter(_RUN.findall(lowered))
    if erase_every:
        begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        crc = zlib.crc32
        changed = [(run, h) for run in runs if not (h := crc(run.encode(), begin)) % erase_every]
        # Counts are taken out first: one run may change into another that changes too.
        moved = [(run[: h % len(run)] + run[h % len(run) + 1 :], runs.pop(run)) for run, h in changed]
        for run, n in moved:
            runs[run] += n
    return runs


def vocabulary(docs: DataFrame, min_letters: int = 5, min_count: int = 3, erase_every: int = 97,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words with at least so many letters and occurrences in the whole table."""

    def counted(frames):
        total: Counter = Counter()
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                for run, n in count_runs(text, doc_id, erase_every).items():
                    if len(run) >= min_letters:
                        total[run] += n
                if len(total) > 200_000:
                    yield pd.DataFrame(total.items(), columns=["word", "n"])
                    total = Counter()
        yield pd.DataFrame(total.items(), columns=["word", "n"]).astype({"word": object, "n": "int64"})

    texts = docs.select(F.col(id_col).cast("bigint").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    parts = texts.mapInPandas(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over words by position and letter; ``codes`` has a row per word, 0 where it has ended."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.width = -(-len(codes) // 64)
        self.built: dict[int, np.ndarray] = {}

    def packed(self, members: np.ndarray) -> np.ndarray:
        """Rows of booleans over the words as rows of 64-bit words."""
        padded = np.zeros((len(members), self.width * 64), dtype=bool)
        padded[:, : members.shape[1]] = members
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def at(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters that occur at a position and a bitset for each, the last one empty."""
        if position not in self.built:
            column = self.codes[:, position] if position < self.codes.shape[1] else np.zeros(len(self.codes), np.uint8)
            letters = np.unique(column[column > 0])
            sets = np.vstack([self.packed(column == letters[:, None]), np.zeros((1, self.width), np.uint64)])
            place = np.full(256, len(letters))
            place[letters] = np.arange(len(letters))
            self.built = {p: s for p, s in self.built.items() if p == position - 1}  # only neighbours are needed
            self.built[position] = place, sets
        return self.built[position]

    def one_apart(self, queries: np.ndarray, size: int, shared: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query word (of ``size`` letters) and a word one replaced or one more letter away.

        Only words of the query's ``block`` count, which agree in their first ``shared`` letters.
        """
        length = (self.codes > 0).sum(axis=1)
        same, longer = self.packed((length == size)[None, :])[0], self.packed((length == size + 1)[None, :])[0]
        _, number = np.unique(block, return_inverse=True)
        blocks = self.packed(number == np.arange(number.max() + 1)[:, None]) if len(number) else None
        found = []
        step = max(1, _SLICE // max(self.width, 1))
        for start in range(0, len(queries), step):
            some = queries[start : start + step]
            exact = blocks[number[some]]  # no error so far
            replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
            for i in range(shared, size):
                letter = self.codes[some, i]
                (place, here), (place_next, after) = self.at(i), self.at(i + 1)
                match = here[place[letter]]
                inserted = (inserted | exact) & after[place_next[letter]]
                replaced = (replaced & match) | (exact & ~match)
                exact &= match
            near = (replaced & same) | ((inserted | exact) & longer)
            row, word = np.nonzero(near)
            bits = np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(bits)
            found.append((some[row[at]], word[at] * 64 + bit))
            self.built = {}
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words, one row each (all are below 256), 0 after the last letter."""
    data = [w.encode("latin-1") for w in words]
    out = np.zeros((len(data), max(map(len, data))), dtype=np.uint8)
    length = np.array([len(d) for d in data])
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    return out


def _first_letters(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each distinct beginning."""
    rows = np.ascontiguousarray(codes[:, :n]).view([("", f"V{n}")]).ravel()
    return np.unique(rows.view(f"V{n}"), return_inverse=True)[1].ravel() if n else np.zeros(len(codes), int)


def near_words(frame: pd.DataFrame, size: int, backward: bool) -> pd.DataFrame:
    """``word, n_near, form, form_n`` of the words of some whole blocks (or pairs of parts of one) with near ones.

    The frame has ``word, n, run`` (equal in one block or pair of parts), ``own, low, high`` (parts).
    Found backward, pairs that agree in their first letters too are left to the other direction.
    """
    words, n = frame["word"].tolist(), frame["n"].to_numpy()
    run, own, split = (frame[c].to_numpy() for c in ("run", "own", "split"))
    forward = _codes(words)
    shared = size // 2
    codes = _codes([w[::-1] for w in words]) if backward else forward
    # Blocks are named by a hash when they are dealt out: the letters themselves tell them apart here.
    _, block = np.unique(np.stack([run, _first_letters(codes, shared)]), axis=1, return_inverse=True)
    length = (codes > 0).sum(axis=1)
    a, b = PositionIndex(codes).one_apart(np.flatnonzero(length == size), size, shared, block.ravel())
    keep = ~split[a] | (own[a] != own[b])
    if backward:
        begin = _first_letters(forward, shared)
        keep &= begin[a] != begin[b]
    a, b = a[keep], b[keep]
    longer = length[b] > size  # words of equal length have each other as query and as word
    a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    member, best = a[first], b[first]
    return pd.DataFrame({
        "word": [words[i] for i in member], "n_near": np.diff(np.append(first, len(a))),
        "form": [words[i] for i in best], "form_n": n[best],
    })


def _compared(frames, together: int, letters: int):
    """Whole runs of the sorted rows, a bounded number of them at a time."""
    key = ["size", "backward", "block", "low", "high"]

    def flush(frame):
        for (size, backward), some in frame.groupby(["size", "backward"], sort=False):
            run = some.groupby(["block", "low", "high"], sort=False).ngroup().to_numpy()
            start, step = 0, max(2, min(together, letters // int(size)))
            ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)) + 1
            while start < len(run):
                fit = ends[(ends > start) & (ends <= start + step)]
                end = int(fit[-1] if len(fit) else ends[ends > start][0])
                part = some.iloc[start:end].assign(run=run[start:end])
                part["split"] = part["low"] != part["high"]
                near = near_words(part, int(size), bool(backward))
                if len(near):
                    yield near
                start = end

    kept, rows = [], 0
    for frame in frames:
        if not len(frame):
            continue
        kept.append(frame)
        rows += len(frame)
        if rows < together:
            continue
        frame = pd.concat(kept, ignore_index=True)
        values = frame[key]
        last = (values != values.iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield from flush(frame.iloc[:cut])
        kept, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield from flush(pd.concat(kept, ignore_index=True))


def _forms(words: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """``word, n_near, form, form_n`` of every word that has near words."""
    length = F.char_length("word")
    backward = F.reverse("word")
    # A word of L letters is looked up as the shorter one (size L) and as the longer one (size L - 1).
    sizes = F.array_compact(F.array(length, F.when(length > F.lit(1), length - 1)))
    place = F.transform(sizes, lambda s: F.array(
        F.struct(s.alias("size"), F.lit(False).alias("backward"), F.xxhash64(s, F.lit(0), F.substring("word", F.lit(1), (s / 2).cast("int"))).alias("block")),
        F.struct(s.alias("size"), F.lit(True).alias("backward"), F.xxhash64(s, F.lit(1), F.substring(backward, F.lit(1), (s / 2).cast("int"))).alias("block")),
    ))
    placed = words.select("word", "n", F.explode(F.flatten(place)).alias("p")).select("word", "n", "p.*")
    # A block counts if it has a word of its size, beside which there is another one.
    full = placed.groupBy("block").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.char_length("word") == F.col("size")).alias("queries")
    ).where("members > 1 AND queries > 0")
    full = scratch.write(full.select("block", F.expr(f"CAST((members + {block_rows - 1}) div {block_rows} AS INT)").alias("parts")))
    # The parts of a large block: a word takes part in each pair of parts that has its own.
    dealt = placed.join(full, "block").withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.select("word", "n", "size", "backward", "block", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("word", "n", "size", "backward", "block", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    tasks = dealt.repartition("block", "low", "high").sortWithinPartitions("size", "backward", "block", "low", "high")

    def compared(frames):
        yield from _compared(frames, 2048, 1 << 20)

    near = scratch.write(tasks.mapInPandas(compared, "word string, n_near long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form")))
    merged = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root``: the last of the forms reached from a word, by pointer doubling.

    Counts at least double from form to form, so chains are short and have no circles.
    """
    reached = scratch.write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not reached.where("open").limit(1).isEmpty():
        further = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = reached.join(further, F.col("root") == F.col("at"), "left")
        new = scratch.write(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        scratch.drop(reached)
        reached = new
    return reached.drop("open")


def variant_groups(docs: DataFrame, min_letters: int = 5, min_count: int = 3, ratio: int = 2, erase_every: int = 97,
                   block_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lowered, with the seeded
    deletions of :func:`count_runs`, that have ``min_letters`` and occur ``min_count`` times. Words are near if one
    inserted, deleted or replaced letter apart. A word's form is its near word of largest count (ties: the
    smallest in code-point order) if that is ``ratio`` (2 or more) times its own; ``root`` is where following
    forms ends.

    Null and empty texts have no words. A row without id counts as one whose id is the empty text. Rows that
    repeat count as often as they come. Words of any length are compared whole. A block with more than
    ``block_rows`` words is cut into parts, each pair of which is compared by itself; what leaves a task
    is a row per word, never a row per pair. Only the two named columns are read; an empty table
    gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms could go round in circles")
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(vocabulary(docs, min_letters, min_count, erase_every, id_col, text_col))
    near = _forms(words, scratch, block_rows).withColumnRenamed("word", "near_word")
    joined = words.join(near, F.col("word") == F.col("near_word"), "left")
    large = F.col("form_n") >= F.col("n") * ratio
    found = scratch.write(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("form")).alias("form"),
        F.when(large, F.col("form_n")).alias("form_n"),
    ))
    roots = _roots(found.where("form IS NOT NULL"), scratch).withColumnRenamed("word", "rooted")
    result = found.join(roots, F.col("word") == F.col("rooted"), "left")
    return result.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
