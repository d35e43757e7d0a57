import math
import random

import numpy as np
import pytest

from twinledger.llm import queries, whitening
from twinledger.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, size int, i string"


def vectors(n, size, seed=1):
    random_ = np.random.default_rng(seed)
    mixed = random_.normal(size=(n, size)) @ random_.normal(size=(size, size)) / size
    return [(i, [float(np.float32(c)) for c in v], i % 3, 0, "x") for i, v in enumerate(mixed)]


def expected(rows):
    """Everything by the definition, in Python integers as far as it is exact."""
    kept = [(r[0], [math.floor(1024 * c) + 100_000 for c in r[1]]) for r in rows
            if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    n, size = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(size)]
    v = np.array([[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in kept) / n**3 for j in range(size)] for i in range(size)])
    e, u = np.linalg.eigh(v)
    out = []
    for vec_id, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        out.append((vec_id, deviation, [centred @ u[:, -k] / math.sqrt(e[-k]) for k in range(1, min(8, size) + 1)]))
    return n, out, e[::-1] / e.sum()


@pytest.mark.parametrize("n,size", [(150, 5), (200, 20)])
def test_whiten_brute_force(spark, n, size):
    rows = vectors(n, size)
    rows += [(7, None, 0, 0, "x"), (8, [None] * size, 0, 0, "x"), (9, [math.nan] * size, 0, 0, "x"),
             (None, rows[3][1], 0, 0, "x"), rows[5], (11, [math.inf] + [0.0] * (size - 1), 0, 0, "x"), (500, [0.0] * size, 0, 0, "x")]
    count, want, explained = expected(rows)
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    components = min(8, size)
    assert len(got) == count * components
    by_row = {}
    for r in got:
        assert r["n"] == count and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        by_row.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r["whitened"])
    assert set(by_row) == {(i, d) for i, d, _ in want}
    sign = [np.sign(by_row[want[0][:2]][k + 1][0]) * np.sign(want[0][2][k]) for k in range(components)]
    for vec_id, deviation, values in want:
        for k in range(components):
            assert np.allclose(by_row[vec_id, deviation][k + 1], sign[k] * values[k], atol=1e-7)


def test_cross_products_are_exact():
    random_ = np.random.default_rng(5)
    for high, rows in ((2, 1), (1000, 130), (1 << 40, 65), (1 << 63, 3), (1, 10)):
        values = random_.integers(0, high, size=(rows, 4), dtype=np.uint64)
        ints = values.astype(object)
        assert (whitening.cross_products(values) == ints.T @ ints).all()


def test_wide_values_and_sizes(spark):
    rows = [(i, [random.Random(i).uniform(-1e12, 1e12) if i else 1e300, float(i), 0.5], 0, 0, "x") for i in range(40)]
    rows += [(100 + i, [float(i % 7), float(i % 3)], 0, 0, "x") for i in range(42)] + [(200, [], 0, 0, "x"), (201, [4.0], 0, 0, "x")]
    got = whiten(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    assert {r["n"] for r in got} == {40, 42} and {r["vec_id"] for r in got} == {*range(40), *range(100, 142)}
    assert all(r["identity_error"] < 1e-6 for r in got)
    x = [[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows[40:82]]
    s = [sum(v[j] for v in x) for j in range(2)]
    want = {100 + i: sum((42 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got if r["n"] == 42} == want


def test_empty_and_constant_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "x")] * 3, SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0, 0, "x")], SCHEMA)).collect() == []


def test_query_columns(spark, sf_dir="/root/testdata/sf0.001"):
    got = queries.op13_whitening(spark, sf_dir)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    assert (kinds["component"], kinds["n"], kinds["deviation"], kinds["whitened"]) == ("int", "bigint", "bigint", "double")
    table = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    count, want, _ = expected([(r["vec_id"], r["embedding"]) for r in table])
    rows = got.collect()
    assert len(rows) == 8 * count and all(r["identity_error"] < 1e-4 for r in rows)
    assert {(r["vec_id"], r["deviation"]) for r in rows} == {(i, d) for i, d, _ in want}
