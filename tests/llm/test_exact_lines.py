import hashlib
import re

import pytest
from pyspark.sql import functions as F

from twinledger.llm.exact import exact_groups
from twinledger.llm.lines import dedup_lines

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(WS.sub(" ", r[1] or ""), []).append(r[0])
    out = []
    for r in rows:
        norm = WS.sub(" ", r[1] or "")
        ids = [i for i in groups[norm] if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(groups[norm]), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_exact_awkward(table, awkward, rows):
    got = rows(exact_groups(table(awkward)))
    assert got == sorted(brute_exact(awkward), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("hash128", ["cast('all equal' as binary)", "substring(unhex(md5(norm)), 1, 1)"])
def test_exact_collisions_are_told_apart_by_bytes(table, awkward, rows, hash128):
    hash128 = F.expr(hash128)
    got = rows(exact_groups(table(awkward), hash128=hash128))
    assert got == sorted(brute_exact(awkward), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_exact_empty(table):
    assert exact_groups(table([])).collect() == []


def brute_lines(rows, min_docs=2):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders.setdefault(key(line), set()).add(r[0])
    out = []
    for r in rows:
        kept, lines = [], (r[1] or "").split("\n")
        for line in lines:
            ids = holders[key(line)]
            real = [i for i in ids if i is not None]
            repeated = len(key(line)) >= 10 and len(ids) >= min_docs and real
            if not (repeated and (r[0] is None or r[0] > min(real))):
                kept.append(line)
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINES = [
    "A line that Repeats\nown line number one\nshort\n", "  a line THAT repeats\t\nshort\nshort", None, "", "a line that repeats",
    "über die STRASSE hin\nx", "Über die Straße hin\nüber die strasse hin", "ÜBER DIE STRASSE HIN", "İstanbul ist groß", "İSTANBUL IST GROß",
    "twice in one\ntwice in one\ntwice in one document", "a line that repeats\na line that repeats", "\n\n\n", "ten chars!\nmore", "Ten Chars!\nmore",
    "Ⅷ eight long line\nkelvin K long line", "ⅷ eight long line\nkelvin K long line",
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_brute_force(table, rows, min_docs):
    data = [(i, t, None, None, 0, i, "k", "h") for i, t in enumerate(LINES)]
    data += [(None, "a line that repeats\nonly here, without id", None, None, 0, 0, "k", "h"), data[0], (3, "own line number one", None, None, 0, 0, "k", "h")]
    got = rows(dedup_lines(table(data), min_docs=min_docs))
    assert got == sorted(brute_lines(data, min_docs), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_lines_long_and_empty(table, awkward, rows):
    got = rows(dedup_lines(table(awkward)))
    assert got == sorted(brute_lines(awkward), key=lambda r: tuple((v is None, str(v)) for v in r))
    many = "\n".join(f"line number {i}" for i in range(30_000))
    texts = dedup_lines(table([many, many + "\nlast line of all"])).orderBy("doc_id").collect()
    assert (texts[0]["n_dropped"], texts[1]["text"], texts[1]["n_dropped"]) == (0, "last line of all", 30_000)
    assert dedup_lines(table([])).collect() == []


def test_plans_are_native(table):
    for df in (exact_groups(table(["a b c"])), dedup_lines(table(["a line of text\nb"]))):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
