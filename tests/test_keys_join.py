import itertools

import pytest
from pyspark.sql import functions as F

from twinledger import join_tables, key_analysis, key_set, summarize_keys

ALL_CATEGORIES = {"A": (1, 1), "B": (1, 0), "C": (0, 1), "D": (2, 1), "E": (1, 3), "F": (2, 2), "G": (3, 0), "H": (0, 2)}


@pytest.fixture(scope="module")
def every(spark):
    """Two tables whose keys (and NULL) reach all eight categories."""
    left = [(k, f"l{k}{i}") for k, (n, _) in ALL_CATEGORIES.items() for i in range(n)] + [(None, "ln")]
    right = [(k, f"r{k}{i}") for k, (_, n) in ALL_CATEGORIES.items() for i in range(n)] + [(None, "rn")]
    return spark.createDataFrame(left, "ID string, Name string"), spark.createDataFrame(right, "ID string, Val string")


def test_categories(spark, rows):
    left = spark.createDataFrame([(k,) for k in "aabc"], "k string")
    right = spark.createDataFrame([(k,) for k in "bdde"], "k string")
    got = {k: c for k, c, *_ in rows(key_analysis(left, right, 0, 0))}
    assert got == {"a": "G", "b": "A", "c": "B", "d": "H", "e": "C"}


def test_every_category_and_null(every, rows):
    got = {k: c for k, c, *_ in rows(key_analysis(*every, "ID", "ID"))}
    assert got == {**{k: k for k in ALL_CATEGORIES}, None: "A"}


def test_empty_sides(spark, every, rows):
    left, right = every
    got = rows(key_analysis(left.limit(0), right, 0, 0))
    assert {c for _, c, *_ in got} == {"C", "H"}
    assert rows(key_analysis(left.limit(0), right.limit(0), 0, 0)) == []


def test_negative_list(spark, every, rows):
    neg = spark.createDataFrame([("B",), ("A",), ("Z",)], "n string")
    got = {k: e for k, _, _, _, e in rows(key_analysis(*every, 0, 0, negative=neg))}
    assert got["B"] == "Yes" and got["G"] == "No" and got["A"] == "n/a" and "Z" not in got
    joined = join_tables(*every, "base", 0, 0, negative=neg)["joined"]
    assert joined.columns[:3] == ["Key", "Key Code", "Explained by negative list"]
    assert {(r[0], r[2]) for r in joined.collect()} == {
        ("A", "n/a"), ("B", "Yes"), ("D", "n/a"), ("E", "n/a"), ("F", "n/a"), ("G", "No"), (None, "n/a")
    }


def test_key_sets(every, rows):
    assert [k for k, _ in rows(key_set(*every, 0, 0, "BG"))] == ["B", "G"]
    with pytest.raises(ValueError):
        key_set(*every, 0, 0, "X")


def test_key_types(spark, rows):
    ints = spark.createDataFrame([(1,), (2,)], "k int")
    doubles = spark.createDataFrame([(1.0,), (2.5,)], "k double")
    texts = spark.createDataFrame([("1",), ("2",)], "k string")
    assert {(k, c) for k, c, *_ in rows(key_analysis(ints, doubles, 0, 0))} == {(1.0, "A"), (2.0, "B"), (2.5, "C")}
    with pytest.raises(TypeError):
        key_analysis(ints, texts, 0, 0)
    assert {c for _, c, *_ in rows(key_analysis(ints, texts, 0, 0, numeric=True))} == {"A"}
    with pytest.raises(KeyError):
        key_analysis(ints, texts, "nope", 0)


def test_summary_lists_all_categories(every, rows):
    got = {c: n for c, _, n in rows(summarize_keys(key_analysis(*every, 0, 0)))}
    assert set(got) == set("ABCDEFGH") and got["A"] == 2 and got["H"] == 1


def test_whole_keys_stay_apart_against_doubles(spark):
    big = 9007199254740992
    whole = spark.createDataFrame([(big,), (big + 1,), (5,), (-7,)], "k bigint")
    floats = spark.createDataFrame([(float(big),), (5.0,), (-7.0,), (0.5,), (1e300,)], "k double")
    got = {r["key"]: r["category"] for r in key_analysis(whole, floats, 0, 0).collect()}
    assert got == {str(big): "A", str(big + 1): "B", "5": "A", "-7": "A", "0.5": "C", "1.0E300": "C"}


def literal_join(spark, kind, **options):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ID bigint, Name string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "ID bigint, Val string")
    return join_tables(left, right, kind, 0, 0, **options)


@pytest.mark.parametrize("kind, keys", [("restrictive", {1, 2}), ("base", {1, 2, 3}), ("promiscuous", {1, 2, 3, 4})])
def test_join_keys(spark, rows, kind, keys):
    joined = literal_join(spark, kind)["joined"]
    assert {r[0] for r in rows(joined)} == keys
    if kind != "restrictive":
        assert next(r for r in rows(joined) if r[0] == 3)[-1] == "-no match-"


def test_unmatched(spark, rows):
    result = literal_join(spark, "base")
    assert rows(result["unmatched"]) == [(4, "z")]
    assert "unmatched" not in literal_join(spark, "promiscuous")


def test_header_tags(spark):
    joined = literal_join(spark, "base", base_tag="ORIG_", ext_tag="NEW_")["joined"]
    assert joined.columns == ["Key", "Key Code", "ORIG_ID", "ORIG_Name", "NEW_ID", "NEW_Val"]


def test_all_keys(spark, rows):
    assert rows(literal_join(spark, "base")["all_keys"]) == [("A", 1), ("A", 2), ("B", 3), ("C", 4)]
    assert "all_keys" not in literal_join(spark, "base", all_keys=False)


def brute_force_join(left, right, kind):
    out = []
    for k, name in left:
        nl, nr = sum(x == k for x, _ in left), sum(x == k for x, _ in right)
        if nr == 1:
            out.append((k, k, name, k, next(v for x, v in right if x == k)))
        elif nr == 0 and kind != "restrictive":
            out.append((k, k, name, "-no match-", "-no match-"))
        elif nr > 1 and (kind == "base" or (kind == "promiscuous" and nl > 1)):
            out.append((k, k, name, "-ambiguous-", "-ambiguous-"))
    if kind == "promiscuous":
        for k, val in right:
            nl, nr = sum(x == k for x, _ in left), sum(x == k for x, _ in right)
            if nl == 0:
                out.append((k, "-no match-", "-no match-", k, val))
            elif nl == 1 and nr > 1:
                out.append((k, k, next(n for x, n in left if x == k), k, val))
            elif nl > 1 and nr > 1:
                out.append((k, "-ambiguous-", "-ambiguous-", k, val))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind, reuse", list(itertools.product(["restrictive", "base", "promiscuous"], [False, True])))
def test_join_against_brute_force(every, rows, kind, reuse):
    left, right = every
    result = join_tables(left, right, kind, 0, 0, reuse_keys=reuse)
    got = sorted([(k, *rest) for k, _, *rest in rows(result["joined"])], key=str)
    assert got == brute_force_join([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()], kind)
    if kind == "base":
        assert {r[0] for r in rows(result["unmatched"])} == set("CEFH")
        assert result["joined"].count() == left.count()


def test_promiscuous_shows_every_row(every, rows):
    left, right = every
    joined = rows(join_tables(left, right, "promiscuous", 0, 0)["joined"])
    assert {r["Name"] for r in left.collect()} <= {r[3] for r in joined}
    assert {r["Val"] for r in right.collect()} <= {r[5] for r in joined}


def test_typed_join(every):
    joined = join_tables(*every, "base", 0, 0, as_text=False)["joined"]
    assert joined.where("`Key Code` in ('B','E','F','G')").where(F.col("_JOINED_Val").isNotNull()).count() == 0


def test_unknown_join_type(every):
    with pytest.raises(ValueError):
        join_tables(*every, "outer", 0, 0)


def test_negative_list_of_another_type(spark, rows):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(5.0,)], "k double")
    listed = spark.createDataFrame([("001",), ("x",)], "k string")
    got = {k: e for k, _, _, _, e in rows(key_analysis(left, right, 0, 0, negative=listed, numeric=True))}
    assert got == {1.0: "Yes", 2.0: "No", 5.0: "n/a"}
    joined = join_tables(left, right, "base", 0, 0, negative=listed, numeric_key=True)["joined"]
    assert {(r[0], r[2]) for r in joined.collect()} == {(1.0, "Yes"), (2.0, "No")}
