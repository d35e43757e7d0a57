import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinledger.llm import spelling
from twinledger.llm.spelling import PositionIndex, variant_groups


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, erase_every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if erase_every and h % erase_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def texts_with_variants():
    pick = random.Random(3)
    stems = ["".join(pick.choice("abcdefgéü") for _ in range(pick.randrange(4, 12))) for _ in range(60)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "bcbcbcbc", "cbcbcbcb", "x" * 500, "x" * 499 + "y", "ÀÉîôû", "ÀÉîôûs"]

    def varied(w):
        i, kind = pick.randrange(len(w)), pick.randrange(6)
        if kind == 0:
            return w[:i] + w[i + 1 :]
        if kind == 1:
            return w[:i] + pick.choice("abcdé") + w[i:]
        return w[:i] + pick.choice("abcdé") + w[i + 1 :] if kind == 2 else w

    texts = []
    for _ in range(300):
        words = [varied(pick.choice(stems[: pick.randrange(1, len(stems) + 1)])) for _ in range(40)]
        texts.append(pick.choice([" ", "1", "-", "ſ"]).join(w.upper() if pick.random() < 0.1 else w for w in words))
    return texts


@pytest.mark.parametrize("block_rows,erase_every", [(4096, 97), (3, 5)])
def test_variant_groups_brute_force(table, awkward, block_rows, erase_every):
    rows = [(i, t, None, None, 0, 0, "k", "h") for i, t in enumerate(texts_with_variants())]
    rows += [(10_000 + i, *r[1:]) for i, r in enumerate(awkward)] + [(None, rows[0][1], *rows[0][2:]), rows[5], rows[5]]
    got = variant_groups(table(rows), block_rows=block_rows, erase_every=erase_every).collect()
    want = expected([(r[0], r[1]) for r in rows], erase_every)
    assert len(want) > 300 and sum(w[1] is not None for w in want) > 100 and any(w[1] != w[2] for w in want if w[1])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert got[0].asDict().keys() == {"word", "form", "root", "n", "n_near", "form_n"}


def test_ties_empty_tables_and_ratio(spark, table):
    rows = ["stone " * 3 + "stane " * 6 + "stine " * 6 + "straw " * 4]
    got = {r["word"]: r for r in variant_groups(table(rows), erase_every=0).collect()}
    assert (got["stone"]["form"], got["stone"]["n_near"], got["stone"]["form_n"]) == ("stane", 2, 6)
    assert got["stane"]["form"] is None and got["stane"]["n_near"] == 2 and got["stane"]["root"] == "stane"
    assert got["straw"]["n_near"] == 0
    assert variant_groups(table([])).collect() == []
    assert variant_groups(table([None, "", "12 34", "ab cd"])).collect() == []
    with pytest.raises(ValueError):
        variant_groups(table(rows), ratio=1)


def test_position_index_of_many_words():
    """Recurrences against the definition, over more than one 64-bit word and slice."""
    pick = random.Random(8)
    words = sorted({"".join(pick.choice("ab") for _ in range(n)) for n in (6, 7) for _ in range(150)})
    codes = spelling._codes(words)
    queries = np.flatnonzero([len(w) == 6 for w in words])
    a, b = PositionIndex(codes).one_apart(queries, 6, 3, spelling._first_letters(codes, 3))
    got = {(words[i], words[j]) for i, j in zip(a, b)}
    want = {(v, w) for v in words if len(v) == 6 for w in words if len(w) >= 6 and one_apart(v, w) and v[:3] == w[:3]}
    assert got == want and len(a) == len(want) > 100
