"""Outline of XML files of any size: which elements there are, how often, and what they hold.

Files are read as text that is split at ``>``, in as many tasks as they have blocks. A block begins at an
unknown place of its document, so a task notes what it sees relative to that place: how many elements it
closes that it has not seen opening, which it leaves open, and a tree of the elements in between. As it might
begin inside a comment, a CDATA section or a quoted attribute, it follows those readings too, which cost
little: nearly all are ruled out, or see no mark that ends one. Then the blocks of each file are put in a row, a few numbers
each, which tells the one right reading and the open elements at the beginning of each block. Last, all trees
are added up by path. The driver gets a row per distinct path and attribute.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import checkpointed

_TOKEN = re.compile(
    r"""<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[.*?\]\s*)*>"""
    r"""|<(?P<end>/)?(?P<name>[^\s<>/!?="']+)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_OPEN_TAG = re.compile(r"""<([^\s<>/!?="']+)(?:[^<>"']|"[^"]*"|'[^']*')*(?:("[^"]*)|('[^']*))\Z""", re.DOTALL)
# What a block may begin in, and the mark that ends it.
_BEGINNINGS = {"content": None, "comment": "-->", "cdata": "]]>", "double": '"', "single": "'"}
_PENDING = "\0"  # the element whose tag began in the block before
_LONGEST_TAG = 1 << 20


class _Node:
    """An element as often as it was seen at one path."""

    __slots__ = ("children", "n", "text", "attributes", "first")

    def __init__(self, first: int):
        self.children: dict[str, _Node] = {}
        self.attributes: dict[str, tuple[int, str]] = {}
        self.n, self.text, self.first = 0, False, first


class _Reading:
    """One block, read as if it began in ``begin``."""

    def __init__(self, begin: str):
        self.begin, self.inside = begin, begin if begin != "content" else None
        self.seen, self.buffer = 0, ""
        self.bases = [_Node(0)]  # one tree for each number of elements closed before
        self.stack: list[tuple[str, _Node]] = []
        self.pending = ""

    def node(self) -> _Node:
        return self.stack[-1][1] if self.stack else self.bases[-1]

    def open(self, name: str, rest: str) -> None:
        self.seen += 1
        parent = self.node()
        node = parent.children.get(name)
        if node is None:
            node = parent.children[name] = _Node(self.seen)
        node.n += 1
        closed = rest.endswith("/")
        if "=" in rest:
            for title, one, other in _ATTRIBUTE.findall(rest):
                if title not in node.attributes:
                    self.seen += 1
                    node.attributes[title] = (self.seen, one or other)
        if not closed:
            self.stack.append((name, node))

    def close(self) -> None:
        if self.stack:
            self.stack.pop()
        else:
            self.bases.append(_Node(self.seen))

    def feed(self, text: str) -> None:
        """The next part of the block, which ends behind a ``>``."""
        if self.inside == "nothing":
            return
        if self.inside is not None:
            mark = _BEGINNINGS[self.inside]
            at = text.find(mark)
            if self.inside == "cdata" and (text if at < 0 else text[:at]).strip():
                self.node().text = True
            if at < 0:
                return
            if self.inside in ("double", "single"):  # what is left of a tag that began in the block before
                if "<" in text[:at]:  # no attribute holds that, so the block does not begin in one
                    self.inside = "nothing"
                    return
                tail = re.match(r"""((?:[^<>"']|"[^"]*"|'[^']*')*)>""", text[at + 1 :], re.DOTALL)
                if tail is None:
                    return
                self.open(_PENDING, tail[1])
                at += tail.end() - len(mark) + 1
            text, self.inside = text[at + len(mark) :], None
        text = self.buffer + text
        self.buffer, at = "", 0
        while True:
            found = _TOKEN.search(text, at)
            between = text[at : found.start() if found else len(text)]
            mark = between.find("<")
            if (between if mark < 0 else between[:mark]).strip():
                self.node().text = True
            if mark >= 0:  # a mark that does not end here, or one that should not be there
                rest = text[at + mark :]
                if rest.startswith("<!--"):
                    self.inside = "comment"
                    return
                if rest.startswith("<![CDATA["):
                    self.inside = "cdata"
                    if rest[9:].strip():
                        self.node().text = True
                    return
                begun = rest.startswith(("<?", "<!DOCTYPE")) or _OPEN_TAG.match(rest)
                if begun and len(rest) < _LONGEST_TAG:
                    self.buffer = rest
                    return
                self.node().text = True
                at += mark + 1
                continue
            if found is None:
                return
            if found["name"]:
                if found["end"]:
                    self.close()
                else:
                    self.open(found["name"], found["rest"])
            elif (found["cdata"] or "").strip():
                self.node().text = True
            at = found.end()

    def rows(self):
        """``closes, opens, after, pending`` of the block, then every node of its trees."""
        after, pending = self.inside or "content", ""
        if self.buffer and (tag := _OPEN_TAG.match(self.buffer)):
            after, pending = ("double" if tag[2] else "single"), tag[1]
            node = self.node().children.setdefault(pending, _Node(self.seen + 1))
            for title in re.findall(r"""([^\s=/"'<>]+)\s*=\s*["']""", self.buffer):
                node.attributes.setdefault(title, (self.seen + 1, ""))
        yield {"up": len(self.bases) - 1, "path": [n for n, _ in self.stack], "after": after, "pending": pending}
        for up, base in enumerate(self.bases):
            todo = [([], base)]
            while todo:
                path, node = todo.pop()
                if node.n or node.text:
                    yield {"up": up, "path": path, "n": node.n, "text": node.text, "seen": node.first, "attribute": ""}
                for title, (seen, value) in node.attributes.items():
                    value = value if title.startswith("xmlns") else ""
                    yield {"up": up, "path": path, "n": 0, "seen": seen, "attribute": title, "value": value}
                todo += [([*path, name], child) for name, child in node.children.items()]


_BLOCK_ROWS = ("file string, block long, begin string, up int, path array<string>, after string, pending string, "
               "n long, text boolean, seen long, attribute string, value string")


def _block_rows(frames):
    columns = [c.split()[0] for c in _BLOCK_ROWS.split(", ")]

    def ended(key, readings):
        possible = [r for r in readings if r.inside != "nothing"]
        rows = [{"file": key[0], "block": key[1], "begin": r.begin, **row} for r in possible for row in r.rows()]
        frame = pd.DataFrame(rows, columns=columns)
        for name, value in (("n", 0), ("seen", 0), ("text", False)):
            frame[name] = frame[name].astype(object).where(frame[name].notna(), value)
        return frame.astype({"n": "int64", "seen": "int64", "text": bool}).astype({c: object for c in ("after", "pending", "attribute", "value")})

    now, readings = None, []
    for frame in frames:
        files, blocks, values = frame["file"].to_numpy(), frame["block"].to_numpy(), frame["value"].tolist()
        start = 0
        while start < len(values):
            key = (files[start], int(blocks[start]))
            same = (files[start:] == key[0]) & (blocks[start:] == key[1])
            end = len(values) if same.all() else start + int(same.argmin())
            if key != now:
                if now is not None:
                    yield ended(now, readings)
                now, readings = key, [_Reading(b) for b in (["content"] if not key[1] else _BEGINNINGS)]
            text = ">".join(values[start:end]) + ">"
            for reading in readings:
                reading.feed(text)
            start = end
    if now is not None:
        yield ended(now, readings)


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    """The right reading of each block of one file, and the elements open at its beginning."""
    by_block = {(b, begin): row for b, begin, row in zip(frame["block"], frame["begin"], frame.itertuples())}
    state, pending, base, rows = "content", "", [], []
    for block in sorted(set(frame["block"])):
        if (block, state) not in by_block:  # a broken document
            state = "content"
        row = by_block[block, state]
        rows.append((frame["file"].iloc[0], block, state, list(base), pending))
        opens = [pending if name == _PENDING else name for name in row.path]
        base = [*base[: max(len(base) - row.up, 0)], *opens]
        state, pending = row.after, row.pending
    return pd.DataFrame(rows, columns=["file", "block", "begin", "base", "pending"])


@dataclass
class Outline:
    """All distinct element paths of some documents, in order of first appearance; the first name is the root's."""

    counts: dict[tuple[str, ...], int] = field(default_factory=dict)
    attributes: dict[tuple[str, ...], dict[str, str]] = field(default_factory=dict)
    with_text: set[tuple[str, ...]] = field(default_factory=set)
    most: dict[str, int] = field(default_factory=dict)  # the most elements of a tag in one document

    @property
    def roots(self) -> list[str]:
        return [p[0] for p in self.counts if len(p) == 1]

    @property
    def namespaces(self) -> dict[str, str]:
        return {title.partition(":")[2]: value for found in self.attributes.values() for title, value in found.items()
                if title == "xmlns" or title.startswith("xmlns:")}

    def has_content(self, path: tuple[str, ...]) -> bool:
        """Whether elements at a path have attributes (other than namespaces) or own text anywhere."""
        return path in self.with_text or any(not t.startswith("xmlns") for t in self.attributes.get(path, ()))

    def record_tag(self) -> str | None:
        """Of the tags below the root that come more than once in some document, the one least deep; ties by name."""
        depth: dict[str, int] = {}
        for p in self.counts:
            if len(p) > 1:
                depth[p[-1]] = min(depth.get(p[-1], len(p)), len(p))
        repeated = [t for t in depth if self.most.get(t, 0) > 1]
        return min(repeated, key=lambda t: (depth[t], t)) if repeated else None

    def columns(self):
        """Paths with each attribute, and with '' for the element itself, as documents show them."""
        for p in self.counts:
            for title in self.attributes.get(p, ()):
                if not title.startswith("xmlns"):
                    yield p, title
            yield p, ""

    def stripped(self) -> Outline:
        """With local names only."""
        def local(name):
            return name.rpartition(":")[2]

        out = Outline()
        for p, n in self.counts.items():
            short = tuple(map(local, p))
            out.counts[short] = out.counts.get(short, 0) + n
            titles = out.attributes.setdefault(short, {})
            for title, value in self.attributes.get(p, {}).items():
                titles.setdefault(title if title.startswith("xmlns") else local(title), value)
            if p in self.with_text:
                out.with_text.add(short)
        for tag, n in self.most.items():
            out.most[local(tag)] = out.most.get(local(tag), 0) + n
        return out


def outline_rows(spark: SparkSession, path: str, glob: str = "*.[xX][mM][lL]") -> DataFrame:
    """``file, block, seen, path, attribute, value, n, text`` of every block of the files, with whole paths."""
    pieces = spark.read.option("lineSep", ">").option("pathGlobFilter", glob).text(path)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = checkpointed(pieces.mapInPandas(_block_rows, _BLOCK_ROWS))
    effects = rows.where("after IS NOT NULL").select("file", "block", "begin", "up", "path", "after", "pending")
    # Only files of several blocks need a chain; there, it is a few rows a block.
    several = effects.where("block > 0").select("file").distinct()
    chained = effects.join(several, "file", "left_semi").groupBy("file").applyInPandas(
        _chained, "file string, block long, begin string, base array<string>, pending string"
    )
    trees = rows.where("after IS NULL").drop("after", "pending")
    single = trees.where("block = 0 AND begin = 'content'").join(several, "file", "left_anti")
    placed = trees.join(chained, ["file", "block", "begin"])
    depth = F.greatest(F.size("base") - F.col("up"), F.lit(0))
    names = F.transform("path", lambda name: F.when(name == _PENDING, F.col("pending")).otherwise(name))
    columns = ("file", "block", "seen", "path", "attribute", "value", "n", "text")
    whole = placed.withColumn("path", F.concat(F.slice("base", F.lit(1), depth), names)).select(*columns)
    return single.select(*columns).unionByName(whole).where(F.size("path") > 0)


def outline_of(spark: SparkSession, path: str, glob: str = "*.[xX][mM][lL]") -> Outline:
    """The outline of all files of a path together."""
    rows = outline_rows(spark, path, glob)
    found = rows.groupBy("path", "attribute").agg(
        F.sum("n").alias("n"), F.bool_or("text").alias("text"), F.min("value").alias("value"),
        F.min(F.struct("file", "block", "seen")).alias("first"),
    )
    out = Outline()
    for r in sorted(found.collect(), key=lambda r: tuple(r["first"])):
        p = tuple(r["path"])
        if r["attribute"]:
            out.attributes.setdefault(p, {})[r["attribute"]] = r["value"]
            continue
        if r["n"]:
            out.counts[p] = r["n"]
        if r["text"]:
            out.with_text.add(p)
    if not out.counts:
        raise ValueError(f"no XML element found in {path}")
    tags = rows.where("n > 0 AND size(path) > 1").groupBy("file", F.element_at("path", -1).alias("tag")).agg(F.sum("n").alias("n"))
    out.most = {r["tag"]: r["n"] for r in tags.groupBy("tag").agg(F.max("n").alias("n")).collect()}
    return out
