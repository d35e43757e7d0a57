"""Delimited records of text files, also where quoted cells contain line breaks, without reading a file in one piece.

Whether a line begins inside a quoted cell depends on all lines before it. What a line does to that is one of
a few small functions: where it ends if it begins outside, and where if it begins inside. Each block of a file
composes those of its lines, the few results of a file are put in a row, and then every block knows how it
begins. Records that go over the end of a block are put together from their parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import checkpointed

_FEW_BLOCKS = 100_000


@dataclass(frozen=True)
class Dialect:
    """What separates and quotes the cells of a line; a quote mark counts at the beginning of a cell only."""

    delim: str = ","
    quote: str = '"'

    @property
    def _cell(self) -> tuple[str, str, str]:
        """Patterns of the delimiter, of the inside of a quoted cell, and of what is no delimiter."""
        d, q = (re.escape(x) for x in (self.delim, self.quote))
        return d, f"(?:[^{q}]|{q}{q})*+", f"(?:(?!{d}).)*+"

    def ends_inside(self, line: Column) -> Column:
        """Whether a line that begins outside a quoted cell ends inside one."""
        if not self.quote:
            return F.lit(False)
        d, inside, others = self._cell
        q = re.escape(self.quote)
        cells = f"(?s)^(?:(?:{q}{inside}{q}(?!{q}){others}|(?!{q}){others}){d})*+{q}{inside}$"
        return line.contains(self.quote) & line.rlike(cells)

    def stays_inside(self, line: Column) -> Column:
        """Whether a line that begins inside a quoted cell ends inside one (the same or a later one)."""
        if not self.quote:
            return F.lit(True)
        d, inside, others = self._cell
        q = re.escape(self.quote)
        closing = f"(?s)^{inside}{q}(?!{q}){others}(?:{d})?"
        return ~line.contains(self.quote) | ~line.rlike(closing) | self.ends_inside(F.regexp_replace(line, closing, ""))

    def cells(self, record: Column) -> Column:
        """How many cells a record has."""
        if self.quote:
            d, inside, _ = self._cell
            q = re.escape(self.quote)
            bare = F.regexp_replace(record, f"(?s)(^|{d}){q}{inside}{q}(?!{q})", "$1")
            record = F.when(record.contains(self.quote), bare).otherwise(record)
        gone = F.length(record) - F.length(F.replace(record, F.lit(self.delim), F.lit("")))
        return (gone / len(self.delim)).cast("int") + 1


def line_table(spark: SparkSession, path: str, encoding: str, line_terminator: str | None = None) -> DataFrame:
    """``value, file, block, id`` of every line; ``id`` rises within a block, and by one from line to line."""
    reader = spark.read.option("encoding", encoding)
    if line_terminator and line_terminator not in ("\n", "\r\n", "\r"):
        reader = reader.option("lineSep", line_terminator)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def _composed(frames):
    """``file, block, f0, f1, out``: how a block ends if it begins outside, and inside; whether it then gets outside."""
    now, f0, f1, out = None, False, True, False
    rows = []
    for frame in frames:
        for file, block, a, b in zip(frame["file"], frame["block"], frame["f0"], frame["f1"]):
            if now != (file, block):
                if now is not None:
                    rows.append((*now, f0, f1, out))
                now, f0, f1, out = (file, block), False, True, False
            f0, f1 = (b if f0 else a), (b if f1 else a)
            out = out or not f1
    if now is not None:
        rows.append((*now, f0, f1, out))
    if rows:
        yield pd.DataFrame(rows, columns=["file", "block", "f0", "f1", "out"])


def _beginnings(frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file that begin inside a quoted cell, and the block in which that record began."""
    inside, origin, rows = False, 0, []
    for block, f0, f1, out in sorted(zip(frame["block"], frame["f0"], frame["f1"], frame["out"])):
        if inside:
            rows.append((frame["file"].iloc[0], block, origin))
        if not inside or out:
            origin = block
        inside = f1 if inside else f0
    return pd.DataFrame(rows, columns=["file", "block", "origin"]).astype({"file": object, "block": "int64", "origin": "int64"})


def quoted_records(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """``value, file, block, id`` of every record, which may be several lines; line breaks inside are ``\\n``."""
    states = lines.select("value", "file", "block", "id", dialect.ends_inside(F.col("value")).alias("f0"),
                          dialect.stays_inside(F.col("value")).alias("f1"))
    # Lines that change nothing need not be looked at one by one.
    composed = states.where("f0 OR NOT f1").select("file", "block", "f0", "f1").mapInPandas(
        _composed, "file string, block long, f0 boolean, f1 boolean, out boolean"
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    whole = blocks.join(composed, ["file", "block"], "left").select(
        "file", "block", F.coalesce("f0", F.lit(False)).alias("f0"), F.coalesce("f1", F.lit(True)).alias("f1"),
        F.coalesce("out", F.lit(False)).alias("out"),
    )
    inside = checkpointed(whole.groupBy("file").applyInPandas(_beginnings, "file string, block long, origin long"))
    # A narrow row for each block of a file that begins inside a cell. Lines stay in order beside a broadcast table.
    if inside.limit(_FEW_BLOCKS + 1).count() <= _FEW_BLOCKS:
        begun = states.join(F.broadcast(inside), ["file", "block"], "left")
    else:
        begun = states.join(inside, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "id")

    def assembled(frames):
        now, parts, first, state, origin = None, [], 0, False, None
        for frame in frames:
            rows = []
            columns = [frame[c].tolist() for c in ("file", "block", "value", "id", "f0", "f1", "origin")]
            for file, block, value, i, f0, f1, begins in zip(*columns):
                if now != (file, block):
                    if parts:  # the end of a block, in the middle of a record
                        rows.append((*now, first, "\n".join(parts), now[1] if origin is None else origin, True))
                    now, parts = (file, block), []
                    state = begins == begins and begins is not None
                    origin = int(begins) if state else None
                if not parts:
                    first = i
                parts.append(value)
                state = f1 if state else f0
                if not state:
                    rows.append((file, block, first, "\n".join(parts), block if origin is None else origin, origin is not None))
                    parts, origin = [], None
            if rows:
                yield pd.DataFrame(rows, columns=["file", "block", "id", "value", "origin", "broken"])
        if parts:
            yield pd.DataFrame([(*now, first, "\n".join(parts), now[1] if origin is None else origin, True)],
                               columns=["file", "block", "id", "value", "origin", "broken"])

    records = checkpointed(begun.mapInPandas(assembled, "file string, block long, id long, value string, origin long, broken boolean"))
    # A record over the end of a block is the parts with one origin: one per block it reaches into.
    broken = records.where("broken").groupBy("file", F.col("origin").alias("block")).agg(
        F.min_by("id", "block").alias("id"), F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    mended = broken.select(F.array_join(F.col("parts.value"), "\n").alias("value"), "file", "block", "id")
    return records.where("NOT broken").select("value", "file", "block", "id").unionByName(mended)
