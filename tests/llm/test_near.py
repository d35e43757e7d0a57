import random
import re
import string

import numpy as np
import pytest

from twinledger.llm.caps import Code, near_vectors
from twinledger.llm.graph import components
from twinledger.llm.minhash import chunk_keys, near_groups
from twinledger.llm.shared import Scratch

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets_of(rows, words):
    out = []
    for r in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        n = min(words, len(found))
        out.append({tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set())
    return out


def smallest_reachable(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    label = smallest_reachable(500, edges)
    assert got == {n: label[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


def near_corpus(prose):
    """Texts with copies that differ in ever more words, a chain, and a large group of near copies."""
    pick, texts = random.Random(9), []
    for family in range(25):
        words = [f"w{pick.randrange(400)}" for _ in range(pick.choice([3, 12, 60, 150]))]
        for copy in range(5):
            texts.append(" ".join(words))
            for _ in range(max(1, len(words) // 25)):
                words = list(words)
                words[pick.randrange(len(words))] = f"v{pick.randrange(9999)}"
    base = [f"w{pick.randrange(400)}" for _ in range(120)]
    for _ in range(60):
        words = list(base)
        for _ in range(pick.randrange(12)):
            words[pick.randrange(120)] = f"u{pick.randrange(9999)}"
        texts.append(" ".join(words))
    return [(i * 3 + 1, t, None, None, 0, 0, "k", "h") for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups_brute_force(table, prose, awkward, words):
    rows = near_corpus(prose)
    rows += [(10_000 + k, *r[1:]) for k, r in enumerate(awkward)]
    sets = sets_of(rows, words)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    label = smallest_reachable(len(rows), links)
    got = {r["doc_id"]: r for r in near_groups(table(rows), words=words).collect()}
    for i, r in enumerate(rows):
        found = got[r[0]]
        assert (found["n_shingles"], found["component_id"]) == (len(sets[i]), rows[label[i]][0])
        assert found["kept"] == (found["doc_id"] == found["component_id"])


def test_near_groups_rows_without_id_and_repeated_rows(table, awkward, rows):
    text = "a b c d e f g h"
    data = [(None, text, None, None, 0, 0, "k", "h"), (5, text, None, None, 0, 0, "k", "h"), (3, text, None, None, 0, 0, "k", "h"), (3, text, None, None, 0, 0, "k", "h"),
            (None, "x y z", None, None, 0, 0, "k", "h"), (4, None, None, None, 0, 0, "k", "h")]
    assert rows(near_groups(table(data))) == rows(near_groups(table(data[::-1])))
    got = rows(near_groups(table(data)))
    assert got == sorted([(3, 4, 3, True), (3, 4, 3, True), (4, 0, 4, True), (5, 4, 3, False), (None, 1, None, True), (None, 4, 3, False)],
                         key=lambda r: tuple((v is None, str(v)) for v in r))
    assert near_groups(table([])).collect() == []
    assert near_groups(table(awkward)).count() == len(awkward)


def test_chunk_keys_guarantee_the_signature_distance():
    """Any two signatures that differ in fewer than chunks * (errors + 1) values share a key."""
    rng = np.random.default_rng(2)
    for errors in (0, 1, 2):
        a = rng.integers(0, 2**63, (200, 40), dtype=np.uint64)
        b = a.copy()
        for row in b:
            row[rng.choice(40, 8 * (errors + 1) - 1, replace=False)] = rng.integers(0, 2**63, dtype=np.uint64)
        shared = [len(np.intersect1d(x, y)) for x, y in zip(chunk_keys(a, 8, errors), chunk_keys(b, 8, errors))]
        assert min(shared) > 0
        assert max(len(np.intersect1d(x, y)) for x, y in zip(chunk_keys(a, 8, errors), chunk_keys(b[::-1], 8, errors))) == 0


def brute_vectors(rows, cosine=0.95):
    usable = [
        r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows
    ]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("kind,block_rows", [("float", 1024), ("double", 20)])
def test_near_vectors_brute_force(spark, kind, block_rows):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    data = [b + rng.normal(scale=s, size=16) for b in base[:20] for s in (0, 0.05, 0.1, 0.2, 0.3, 0.35)]
    data += [base[0] + rng.normal(scale=0.04, size=16) for _ in range(90)] + list(base[20:])
    data = [np.float32(d).astype(float).tolist() for d in data]
    data += [data[0], data[0], (np.array(data[0]) * 4).tolist(), (-np.array(data[0])).tolist()]
    data += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0], [-3.0]]
    if kind == "double":
        data += [[1e200] * 16, [2e200] * 16, [1e-200] * 16]
    rows = [(i, d, i % 3, "h") for i, d in enumerate(data)]
    links = brute_vectors(rows)
    label = smallest_reachable(len(rows), links)
    n = [sum(i in link for link in links) for i in range(len(rows))]
    table = spark.createDataFrame(rows + [(None, data[0], 0, "h")], f"vec_id long, embedding array<{kind}>, label int, `filter` string")
    got = {r["vec_id"]: r for r in near_vectors(table, block_rows=block_rows).collect()}
    assert len(got) == len(rows) + 1
    wrong = [(i, got[i]) for i in range(len(rows)) if (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) != (n[i], label[i], label[i] == i)]
    assert not wrong
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, True)
    assert near_vectors(table.where("false")).collect() == []


def test_filters_list_all_directions_over_the_bound():
    code = Code(1.2, 2, 12, 3)
    units = np.random.default_rng(1).normal(size=(50, 9))
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    row, name = code.filters(units)
    expected = set()
    for number in range(3):
        rotation, words = code.codewords(9, number)
        turned = units @ rotation
        for i in range(12):
            for j in range(12):
                score = turned[:, :5] @ words[0][:, i] + turned[:, 5:] @ words[1][:, j]
                expected |= {(int(r), number * 144 + i * 12 + j) for r in np.flatnonzero(score >= 1.2)}
    assert set(zip(row.tolist(), name.tolist())) == expected


def test_filters_miss_hardly_any_pair_at_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.sqrt((a * a).sum(axis=1))[:, None]
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1)[:, None] * a
    z /= np.sqrt((z * z).sum(axis=1))[:, None]
    code = Code.fitting(20_000, 0.95, 24)
    found = [set(zip(*(x.tolist() for x in code.filters(v)))) for v in (a, 0.95 * a + np.sqrt(1 - 0.95**2) * z)]
    assert len({row for row, _ in found[0] & found[1]}) >= 1498
