"""Token ids in binary shards: frequency-ranked, byte-aligned, with separate control bytes.

A shard is a sequence of blocks of whole documents. A block holds, in this order and little-endian:

* header: magic ``TKVB``, then as unsigned 64-bit the numbers of documents, ids, table entries and data bytes;
* the ids of the documents (int64) and a byte each that is 1 where there is no id;
* the end of each document in the block, counted in token ids (unsigned 64-bit);
* the table of token ids by falling frequency in the block (unsigned 32-bit): a token is coded as its rank;
* control bytes: two bits a token, four tokens a byte, the lowest bits first: bytes of the rank less one;
* data bytes: the ranks, each in as few bytes as it needs.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import batches
from .shared import Scratch

MAGIC = b"TKVB"
_HEADER = struct.Struct("<4sQQQQ")
_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: For each control byte, which of the 16 bytes of four ids are stored.
_STORED = (np.arange(4) <= _CODES[:, :, None]).reshape(256, 16)
_SIZES = _CODES.sum(axis=1) + 4


def encode_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents with their token ids, one after the other, as one block."""
    counts = np.bincount(ids)  # as long as the vocabulary at most
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), dtype="<u4")
    rank[table] = np.arange(len(table), dtype="<u4")
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype="<u4")
    padded[: len(ids)] = rank[ids]
    code = ((padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)).reshape(-1, 4)
    control = (code << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = padded.view(np.uint8).reshape(-1, 16)[_STORED[control]]
    missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = _HEADER.pack(MAGIC, len(doc_ids), len(ids), len(table), len(data))
    ends = np.cumsum(lengths).astype("<u8")
    parts = (names, missing, ends, table, control, data)
    return head + b"".join(p.tobytes() for p in parts)


def decode_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids of the documents, the end of each, and all token ids (unsigned 32-bit)."""
    magic, n_docs, n_ids, n_table, n_data = _HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(block, dtype=kind, count=n, offset=at)
        at += part.nbytes
        return part

    names, missing, ends, table = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs), take("<u4", n_table)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    spread = np.zeros((len(control), 16), dtype=np.uint8)
    spread[_STORED[control]] = data
    ids = table[spread.view("<u4").ravel()[:n_ids]] if n_ids else np.zeros(0, dtype="<u4")
    return [None if m else int(d) for d, m in zip(names, missing)], ends.astype(np.int64), ids


# A line of letters up to U+00FF, as none of which normalizing changes but for case, and marks behind them.
_TOGETHER = 1 << 21  # characters of texts encoded together
_WIDE = re.compile("[^\x00-\xff]")
_LATIN = re.compile("^([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)$", re.MULTILINE)


class WordEncoder:
    """Ids of whole texts by the given tokenizer, word by word.

    The tokenizer drops white space and never joins what it separates, so a text is cut at blanks and
    \\t, \\n, \\r and each distinct word is encoded once and remembered: the last ``remember`` to twice as
    many. New words that are letters only, also as the tokenizer normalizes them, are encoded many at once,
    as one text; each is one pre-token there, whose last token has the mark of a word's end. Marks like a
    comma after such letters are words of their own. Texts without characters above U+00FF are put in lower
    case first, where the tokenizer does that anyway, so that fewer words differ.
    """

    def __init__(self, tokenizer_json: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.normalizer = self.tokenizer.normalizer
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.marks_ends = bool(self.ends.any())
        self.lowers = self.normalizer is not None and self.normalizer.normalize_str("AÀÞzß") == "aàþzß"
        self.remember = remember
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for group in batches(texts, _TOGETHER):
            out += self._encode_group([texts[i] for i in group])
            if len(self.known) > self.remember:
                self.older, self.known = self.known, {"": b""}
        return out

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        """Distinct words of the texts are numbered first; what happens to every word is then arrays of numbers."""
        folded = [self._folded(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        split = pc.split_pattern(pa.array(folded, pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(words).difference(self.known))
        parts = list(map(self.known.__getitem__, words))
        data = np.frombuffer(b"".join(parts), dtype=self.kind)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // data.itemsize
        starts = (np.cumsum(sizes) - sizes).astype(np.int32)  # a group has far fewer ids than that
        word = numbered.indices.to_numpy()
        counts = sizes[word]
        ends = np.cumsum(counts)
        source = np.repeat(starts[word] - (ends - counts).astype(np.int32), counts)
        source += np.arange(len(source), dtype=np.int32)
        ids = data[source].tobytes()
        cuts = (np.append(0, ends)[np.cumsum(split.value_lengths().to_numpy())] * data.itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _folded(self, text: str) -> str:
        """A text in lower case, where that cannot be another one than the tokenizer's: up to U+00FF."""
        if self.lowers and not (text.isascii() or _WIDE.search(text)):
            return text.lower()
        return text.lower() if self.lowers and text.isascii() else text

    def _learn(self, words: set[str]) -> None:
        known, older = self.known, self.older
        if older:
            back = words.intersection(older)
            known.update(zip(back, map(older.__getitem__, back)))
            words = words.difference(back)
        if not words:
            return
        lines = "\n".join(words)
        # Letters up to U+00FF and marks behind them are sorted out in one go, the others one by one.
        split = _LATIN.findall(lines) if self.marks_ends else []
        rest = set(_LATIN.sub("", lines).split("\n")).difference(known) if split else words
        other = {w for w in rest if self._letters(w)} if self.marks_ends else set()
        cores, tails = {core for core, _ in split}, {tail for _, tail in split}
        regular = list((cores | other).difference(known))
        for start in range(0, len(regular), 1000):
            self._encode_joined(regular[start : start + 1000])
        self._encode_each(list((rest - other | tails).difference(known)))
        known.update([(core + tail, known[core] + known[tail]) for core, tail in split if tail])

    def _letters(self, word: str) -> bool:
        """Whether the word is letters only, also after normalizing, which turns some letters into letter and mark."""
        if not word.isalpha():
            return False
        return word.isascii() or not self.normalizer or self.normalizer.normalize_str(word).isalpha()

    def _encode_each(self, words: list[str]) -> None:
        """Words of any kind, told apart by where the tokens begin in the text."""
        for start in range(0, len(words), 1000):
            some = words[start : start + 1000]
            e = self.tokenizer.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            begins = np.cumsum([0] + [len(w) + 1 for w in some])
            cuts = np.searchsorted([a for a, _ in e.offsets], begins) * np.dtype(self.kind).itemsize
            data = np.array(e.ids, dtype=self.kind).tobytes()
            self.known.update(zip(some, (data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist()))))

    def _encode_joined(self, words: list[str]) -> None:
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(ids, dtype=self.kind)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
        if len(cuts) != len(words) or cuts[-1] != ids.nbytes:
            return self._encode_each(words)  # the tokenizer cuts some of them otherwise
        data, begin = ids.tobytes(), 0
        for word, end in zip(words, cuts.tolist()):
            self.known[word] = data[begin:end]
            begin = end


_encoders: dict[int, WordEncoder] = {}


def word_encoder(tokenizer_json: str) -> WordEncoder:
    """One encoder for each tokenizer in a worker, with the words it already knows."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def _file_system(folder: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if folder.startswith("/") or folder.startswith("file:"):
        return LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(folder)


def _blocks(frames: Iterator[pd.DataFrame], kind: str, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Consecutive documents whose ids take about ``size`` together."""
    docs, parts, total = [], [], 0
    for frame in frames:
        for doc, missing, ids in zip(frame["doc_id"], frame["no_id"], frame["ids"]):
            docs.append(None if missing else int(doc))
            parts.append(np.frombuffer(ids, dtype=kind))
            total += len(parts[-1])
            if total >= size:
                yield docs, np.array([len(p) for p in parts]), np.concatenate(parts)
                docs, parts, total = [], [], 0
    if docs:
        yield docs, np.array([len(p) for p in parts]), np.concatenate(parts)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2,
                 block_tokens: int = 1 << 20, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write shards in ascending order of id; the result lists their blocks.

    Ranges of ids come from their approximate quantiles, a scan of one column. Texts are then encoded
    before the shuffle that sends each to the task of its range, so only token ids move. Each task
    writes one shard, block after block, under a name of its own and renames it at the end: a task
    that is run again replaces the file by an equal one. The listing (``shard, block, path,
    at, n_bytes, n_docs, n_tokens, before``; ``before`` counts ids in the shard) is written too.

    A null text has the end id only. Rows without id come first; rows that share an id are in order of
    their ids. An empty table gives no shard. Only the two named columns are read. The folder must be
    one that all executors see; the default is below ``spark.checkpoint.dir``. There are as many shards
    as shuffle partitions unless ``shards`` says otherwise.
    """
    scratch = Scratch(docs.sparkSession)
    folder = folder or f"{scratch.folder}/shards"
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    probe = WordEncoder(tokenizer_json)
    kind = probe.kind
    tail = np.array([end_id], dtype=kind).tobytes()

    def encoded(frames):
        encoder = word_encoder(tokenizer_json)
        for frame in frames:
            for start in range(0, len(frame), 500):
                some = frame.iloc[start : start + 500]
                ids = [b + tail for b in encoder.encode(some["text"].tolist())]
                place = np.where(some["no_id"], 0, np.searchsorted(bounds, some["doc_id"], side="right"))
                yield pd.DataFrame({"range": place, "doc_id": some["doc_id"].to_numpy(), "no_id": some["no_id"].to_numpy(), "ids": ids})
            pa.default_memory_pool().release_unused()

    def written(frames):
        context = TaskContext.get()
        shard = context.partitionId()
        system, base = _file_system(folder)
        path, own = f"{base}/shard-{shard:06d}.bin", f"{base}/.shard-{shard:06d}-{context.taskAttemptId()}"
        rows, at, before, stream = [], 0, 0, None
        for block, (names, lengths, ids) in enumerate(_blocks(frames, kind, block_tokens)):
            if stream is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(own)
            data = encode_block(names, lengths, ids)
            stream.write(data)
            rows.append((shard, block, path, at, len(data), len(names), len(ids), before))
            at, before = at + len(data), before + len(ids)
        if stream is not None:
            stream.close()
            system.move(own, path)
        columns = ["shard", "block", "path", "at", "n_bytes", "n_docs", "n_tokens", "before"]
        yield pd.DataFrame(rows, columns=columns)

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = texts.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = sorted({int(c) for c in cuts})

    texts = texts.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    ids = texts.mapInPandas(encoded, "range int, doc_id long, no_id boolean, ids binary")
    ranged = ids.repartitionById(len(bounds) + 1, F.col("range"))
    ordered = ranged.sortWithinPartitions(F.desc("no_id"), "doc_id", "ids").drop("range")
    schema = "shard int, block int, path string, at long, n_bytes long, n_docs long, n_tokens long, before long"
    listing = scratch.write(ordered.mapInPandas(written, schema))
    listing.shards = folder
    return listing


def read_shards(listing: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document, decoded from the listed blocks.

    ``start`` counts the ids of all documents before it. Blocks are read in parallel; only the totals
    of the shards, a row each, are added up in one place.
    """
    folder = listing.shards
    totals = listing.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("in_shard").over(earlier), F.lit(0)).alias("shard_start"))
    placed = listing.join(offsets, "shard").withColumn("start", F.col("shard_start") + F.col("before"))

    def decoded(frames):
        system, _ = _file_system(folder)
        for frame in frames:
            for path, at, size, start in zip(frame["path"], frame["at"], frame["n_bytes"], frame["start"]):
                with system.open_input_file(path) as file:
                    names, ends, ids = decode_block(file.read_at(size, at))
                begins = np.append(0, ends[:-1])
                parts = [ids[a:b].tobytes() for a, b in zip(begins, ends)]
                yield pd.DataFrame({
                    "doc_id": pd.array(names, dtype="Int64"), "start": start + begins, "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(p) for p in parts], "ids": parts,
                })

    # A listing is small whatever its shards hold: the number of tasks is said, else they would become one.
    tasks = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = placed.repartition(tasks, "shard", "block").select("path", "at", "n_bytes", "start")
    return columns.mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
