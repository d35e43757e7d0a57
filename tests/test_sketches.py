import random

from twinledger.operators.sketches import distinct_sketches, estimated_counts, merge_sketches


def test_sketches_of_parts_merge_to_that_of_all(spark):
    pick = random.Random(6)
    rows = [(pick.choice("xyz") if i % 50 else None, f" v{pick.randrange(20_000)}" if i % 9 else None, i % 7) for i in range(60_000)]
    exact = {k: (len({r[1] for r in rows if r[0] == k}), len({r[2] for r in rows if r[0] == k})) for k in ("x", "y", "z", None)}
    parts = [distinct_sketches(spark.createDataFrame(rows[i::3], "k string, v string, n int"), ["k"], ["v", 2]) for i in range(3)]
    found = {r["k"]: r for r in estimated_counts(merge_sketches(parts, ["k"]), ["k"]).collect()}
    assert found.keys() == exact.keys()
    for key, (values, numbers) in exact.items():
        assert abs(found[key]["v"] - values) <= 0.05 * values and found[key]["n"] == numbers
    whole = distinct_sketches(spark.createDataFrame(rows, "k string, v string, n int"), ["k"], ["v"])
    assert {r["k"]: r["v"] for r in estimated_counts(whole, ["k"]).collect()}.keys() == exact.keys()


def test_missing_and_stripped_values(spark):
    df = spark.createDataFrame([("k", "a"), ("k", " a "), ("k", None), ("k", "")], "k string, v string")
    count = lambda **o: estimated_counts(distinct_sketches(df, ["k"], ["v"], **o), ["k"]).first()["v"]
    assert count() == 4 and count(strip=True) == 3
    assert estimated_counts(distinct_sketches(df.limit(0), ["k"], ["v"]), ["k"]).count() == 0
