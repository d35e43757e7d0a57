import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from twinledger.llm import packing, queries, tokens
from twinledger.llm.packing import knapsack, pack, whole_patterns


def test_knapsack_brute_force():
    pick = random.Random(2)
    for capacity in (1, 5, 9):
        values = np.array([pick.choice([0, pick.random(), 2 * pick.random()]) for _ in range(min(capacity, 6))])
        best, pattern = knapsack(values, capacity)
        lengths = range(1, len(values) + 1)
        all_patterns = itertools.product(*[range(capacity // k + 1) for k in lengths])
        want = max(sum(n * v for n, v in zip(p, values)) for p in all_patterns if sum(n * k for n, k in zip(p, lengths)) <= capacity)
        assert abs(best - want) < 1e-12 and abs(pattern @ values - want) < 1e-12
        assert pattern @ np.arange(1, len(values) + 1) <= capacity


def fewest(demand, capacity):
    """The least number of sequences, by trying them all."""
    seen = {}

    def search(left):
        if not any(left):
            return 0
        if left not in seen:
            top = max(k for k, n in enumerate(left) if n)
            options = itertools.product(*[range(n + 1) for n in left])
            fits = [p for p in options if p[top] and sum(n * (k + 1) for k, n in enumerate(p)) <= capacity]
            seen[left] = 1 + min(search(tuple(a - b for a, b in zip(left, p))) for p in fits)
        return seen[left]

    return search(tuple(demand))


@pytest.mark.parametrize("capacity,most,seed", [(6, 3, 1), (7, 2, 2), (9, 2, 3)])
def test_patterns_against_the_optimum(capacity, most, seed):
    pick = random.Random(seed)
    for _ in range(6):
        demand = np.array([pick.randrange(most + 1) if k < 6 else 0 for k in range(capacity - 1)])
        found = whole_patterns(demand, capacity)
        assert (sum((p * t for p, t in found), np.zeros_like(demand)) == demand).all()
        assert all(p @ np.arange(1, capacity) <= capacity for p, _ in found)
        assert sum(t for _, t in found) <= fewest(demand[:6], capacity) + 1


def test_linear_program_reaches_the_bound_of_many_pieces():
    demand = np.random.default_rng(4).integers(0, 5000, 63) * (np.arange(63) < 30)  # with short pieces no waste is forced
    patterns, used = packing.fractional_patterns(demand, 64)
    assert np.allclose(used @ patterns, demand, atol=1e-4)
    bound = demand @ np.arange(1, 64) / 64
    assert bound - 1e-6 <= used.sum() <= bound * 1.001
    assert sum(t for _, t in whole_patterns(demand, 64)) <= np.ceil(used.sum()) + 2


def check_packing(rows, got, capacity, end_id=1):
    """Pieces against the library's ids: each id once, no gaps, nothing above the capacity."""
    tokenizer = Tokenizer.from_file(tokens.tokenizer_file())
    by_text = defaultdict(int)
    for doc_id, text in rows:
        by_text[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (end_id,)] += 1
    docs = defaultdict(lambda: defaultdict(list))
    sequences = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        docs[r["doc_id"], r["doc_tokens"]][r["start"]].append(tuple(ids.tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc_id, ids), times in by_text.items():
        found = docs[doc_id, len(ids)]
        assert sum(len(p) for pieces in found.values() for p in pieces) >= times * len(ids)
        for start, pieces in found.items():
            assert sum(p == ids[start : start + len(p)] for p in pieces) >= 1
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in by_text.items())
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding, sum(r["length"] for r in got)


@pytest.mark.parametrize("capacity,grain", [(2048, 8), (64, 4), (30, 4), (1, 1)])
def test_pack_round_trip(table, prose, awkward, capacity, grain):
    pick = random.Random(11)
    rows = [(i, prose("aa", pick.choice([3, 20, 40, 300]), i), None, None, 0, 0, "k", "h") for i in range(60)]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(awkward)][: None if capacity > 60 else 7]
    rows += [(None, "one", None, None, 0, 0, "k", "h"), rows[2], rows[2]]
    got = pack(table(rows).repartition(3), tokens.tokenizer_file(), capacity=capacity, grain=grain).collect()
    padding, total = check_packing([(r[0], r[1]) for r in rows], got, capacity)
    assert padding <= 0.1 * total + grain


def test_pack_empty_table_and_query(spark, table, sf_dir="/root/testdata/sf0.001"):
    assert pack(table([]), tokens.tokenizer_file()).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.tokenizer_file()).collect()
    padding, total = check_packing([tuple(d) for d in docs], got, 2048)
    assert padding < 0.02 * total
    crcs = {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in queries.op11_packing(spark, sf_dir).collect()}
    assert crcs == {(r["doc_id"], r["start"], r["length"]): zlib.crc32(r["ids"]) for r in got}
