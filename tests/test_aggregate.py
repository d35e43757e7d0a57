import warnings

import pytest
from pyspark.sql import functions as F

from twinledger import AGG_TYPES, AggSpec, aggregate, concatenate_parts, de_aggregate, distinct_values, spec_all
from twinledger.plans.agg_specs import CATEGORY_TYPES, PLAIN_TYPES


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(11, "Petrel", 70), (12, "Gannet", 45), (13, "Petrel", 5), (14, "Gannet", 45), (15, "Skua", 9), (16, "Petrel", 20)],
        "`Trip No` bigint, `Boat Name` string, Catch bigint",
    )


def kv(spark, pairs, dtype="string"):
    return spark.createDataFrame(pairs, f"k string, v {dtype}")


def agg(df, kind, **options):
    out = aggregate(df, "k", [AggSpec(kind, "v", "r", options)], as_text=True, order_by=["v"])
    return {r["k"]: r["r"] for r in out.collect()}


def test_there_are_36_types():
    assert len(AGG_TYPES) == 36 and len(CATEGORY_TYPES) == len(PLAIN_TYPES) == 18


def test_several_aggregates(orders, rows):
    out = aggregate(orders, "Boat Name", [
        dict(agg_type="sum", agg_col="Catch", agg_name="Landed"),
        dict(agg_type="concatenate_unique", agg_col=0, agg_name="Trips", agg_options={"link_text": "+"}),
        dict(agg_type="count_all", agg_col=0, agg_name="Times out"),
    ], as_text=True, key_name="Boat", ordered=True)
    assert out.columns == ["Boat", "Landed", "Trips", "Times out"]
    assert rows(out, ordered=True) == [("Gannet", "90", "12+14", "2"), ("Petrel", "95", "11+13+16", "3"), ("Skua", "9", "15", "1")]


@pytest.mark.parametrize("kind, pairs, options, expected", [
    ("sum", [("a", "10"), ("a", "20"), ("b", "5")], {}, {"a": "30.0", "b": "5.0"}),
    ("sum", [("a", "10"), ("a", "x"), ("b", ""), ("c", None)], {},
     {"a": "-Non-numeric-", "b": "-All empty-", "c": "-All empty-"}),
    ("sum", [("a", "10"), ("a", "x")], {"ignore_non_numbers": True}, {"a": "10.0"}),
    ("sum", [("a", "10"), ("a", "")], {"ignore_empty": False}, {"a": "-Non-numeric-"}),
    ("min", [("a", "10"), ("a", "9")], {}, {"a": "9.0"}),
    ("max", [("a", "10"), ("a", "9")], {}, {"a": "10.0"}),
    ("average", [("a", "10"), ("a", "5")], {}, {"a": "7.5"}),
    ("and", [("a", "T"), ("a", "y"), ("b", "T"), ("b", "0")], {}, {"a": "True", "b": "False"}),
    ("or", [("a", "T"), ("a", "n"), ("b", "F")], {}, {"a": "True", "b": "False"}),
    ("and", [("a", "maybe"), ("b", "")], {}, {"a": "-Non-boolean value found-", "b": "-Non-boolean value found-"}),
    ("and", [("a", ""), ("b", " "), ("b", "T")], {"ignore_blanks": True}, {"a": "", "b": "True"}),
    ("count_nonempty", [("a", " "), ("a", "x"), ("a", None)], {}, {"a": "1"}),
    ("count_nonempty", [("a", " "), ("a", "x")], {"strip": False}, {"a": "2"}),
    ("count_unique", [("a", "x"), ("a", "x "), ("a", "y"), ("b", "z"), ("b", None)], {}, {"a": "2", "b": "2"}),
    ("are_same", [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("d", None), ("d", "x")], {},
     {"a": "True", "b": "False", "c": "True", "d": "False"}),
    ("max_text_length", [("a", "ab"), ("a", "abcd"), ("b", "x")], {}, {"a": "4", "b": "1"}),
    ("min_text_length", [("a", " ab "), ("a", "abcd")], {}, {"a": "2"}),
    ("avg_text_length", [("a", "ab"), ("a", "abc")], {}, {"a": "2.5"}),
    ("some_filled", [("a", "x"), ("a", ""), ("b", "")], {}, {"a": "True", "b": "False"}),
    ("all_filled", [("a", "x"), ("a", ""), ("b", "y")], {}, {"a": "False", "b": "True"}),
    ("none_filled", [("a", "x"), ("a", ""), ("b", " ")], {}, {"a": "False", "b": "True"}),
    ("concatenate", [("a", "2"), ("a", "1"), ("a", "1")], {}, {"a": "1, 1, 2"}),
    ("concatenate_unique", [("a", "q"), ("a", "p"), ("a", "p")], {"link_text": "-"}, {"a": "p-q"}),
])
def test_plain(spark, kind, pairs, options, expected):
    assert agg(kv(spark, pairs), kind, **options) == expected


def test_typed_columns(spark, rows):
    df = kv(spark, [("a", 1), ("a", 2), ("b", None)], "bigint")
    out = aggregate(df, "k", [AggSpec("sum", "v", "s"), AggSpec("count_all", "v", "n")], ordered=True)
    assert out.dtypes == [("k", "string"), ("s", "bigint"), ("s__status", "string"), ("n", "bigint")]
    assert rows(out, ordered=True) == [("a", 3, "ok", 2), ("b", None, "empty", 1)]
    assert agg(df, "min_text_length", strip=False) == {
        "a": "-Field(s) without text data-", "b": "-Field(s) without text data-"
    }
    zero = kv(spark, [("a", 0), ("b", 1)], "bigint")
    assert agg(zero, "all_filled") == {"a": "True", "b": "True"}
    assert agg(zero, "all_filled", strip=False) == {"a": "False", "b": "True"}
    assert agg(zero, "and", allow_01=False) == {"a": "False", "b": "True"}


def pivot(spark, rows, kind, as_text=True, **options):
    df = spark.createDataFrame(rows, "k string, c string, v string")
    out = aggregate(df, "k", [AggSpec(kind, "v", "Val", {"cat_key_col": "c", **options})], as_text=as_text)
    return out.columns[1:], {r["k"]: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("kind, table, options, expected", [
    ("category", [("a", "X", "1"), ("a", "Y", "2"), ("b", "X", "3")], {}, {"a": ("1", "2"), "b": ("3", None)}),
    ("category", [("a", "X", "1"), ("a", "X", "1"), ("b", "Y", "3")], {}, {"a": ("-Duplicate entries-", None), "b": (None, "3")}),
    ("category", [("a", "X", "1"), ("a", "X", "1"), ("b", "X", "2"), ("b", "X", "3")], {"allow_duplicates_if_equal": True},
     {"a": ("1",), "b": ("-Duplicate entries-",)}),
    ("category-sum", [("a", "X", "10"), ("a", "X", "5"), ("a", "Y", "1"), ("b", "X", "2")], {},
     {"a": ("15.0", "1.0"), "b": ("2.0", "0.0")}),
    ("category-sum", [("a", "X", "10"), ("a", "X", "2024-01-15"), ("b", "X", "")], {}, {"a": ("-Non-numeric-",), "b": ("0.0",)}),
    ("category-sum", [("a", "X", "10"), ("a", "X", "text")], {"ignore_non_numbers": True}, {"a": ("10.0",)}),
    ("category-and", [("a", "X", "T"), ("a", "X", " T "), ("a", "Y", "F"), ("b", "Y", "?")], {},
     {"a": ("True", "False"), "b": ("", "-Non-boolean value found-")}),
    ("category-concat-unique", [("a", "X", "p"), ("a", "X", "p"), ("a", "X", "q"), ("b", "Y", "r")], {"link_text": ","},
     {"a": ("p,q", ""), "b": ("", "r")}),
    ("category-min", [("a", "X", "3"), ("a", "X", "2"), ("b", "Y", "")], {}, {"a": ("2.0", "-All empty-"), "b": ("-All empty-", "-All empty-")}),
    ("category-count-unique", [("a", "X", "p"), ("a", "X", "p"), ("b", "Y", "q")], {}, {"a": ("1", "0"), "b": ("0", "1")}),
    ("category-are-same", [("a", "X", "p"), ("a", "X", "q"), ("b", "Y", "q")], {},
     {"a": ("False", "<No record found>"), "b": ("<No record found>", "True")}),
    ("category-none-filled", [("a", "X", "p"), ("b", "Y", "")], {}, {"a": ("False", "True"), "b": ("True", "True")}),
    ("category-avg-text-length", [("a", "X", "p"), ("a", "X", "pqr"), ("b", "Y", "q")], {},
     {"a": ("2.0", "-All empty-"), "b": ("-All empty-", "1.0")}),
])
def test_by_category(spark, kind, table, options, expected):
    columns, got = pivot(spark, table, kind, **options)
    assert got == expected
    assert columns == [f"Val - {c}" for c in sorted({r[1] for r in table})]


def test_null_key_and_null_category(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "X", 2), ("a", None, 3)], "k string, c string, v bigint")
    out = aggregate(df, "k", [AggSpec("category-sum", "v", "s", {"cat_key_col": "c"}), AggSpec("count_all", "v", "n")])
    got = {r["k"]: (r["s - X"], r["s - None"], r["n"]) for r in out.collect()}
    assert got == {None: (2.0, 1.0, 2), "a": (0.0, 3.0, 1)}


def test_given_categories_and_limits(spark, orders):
    spec = AggSpec("category-count-all", 0, "n", {"cat_key_col": "Catch", "categories": [45, 7]})
    out = aggregate(orders, "Boat Name", [spec])
    assert out.columns == ["Boat Name", "n - 45", "n - 7"]
    with pytest.raises(ValueError):
        aggregate(orders, 1, [AggSpec("category-count-all", 0, "n", {"cat_key_col": "Catch"})], max_pivot_columns=3)
    assert distinct_values(orders, "Boat Name") == ["Gannet", "Petrel", "Skua"]


def test_bad_specs(orders):
    bad = [AggSpec("median", "Catch"), AggSpec("category", "Catch", "x", {"cat_key_col": 9}), AggSpec("category", "Catch"),
           AggSpec("sum", "Catch", "s", {"oops": 1}), AggSpec("count_all", "Catch", "n")]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = aggregate(orders, 1, bad)
    assert out.columns == ["Boat Name", "n"] and len([w for w in seen if "skipped" in str(w.message)]) == 4
    with pytest.raises(ValueError):
        aggregate(orders, 1, bad[:1], on_error="raise")
    with pytest.raises(ValueError):
        aggregate(orders, 1, [AggSpec("concatenate", 0)])


def test_spec_all(orders):
    out = aggregate(orders, "Boat Name", spec_all(orders, "count_unique"))
    assert out.columns == ["Boat Name", "0 - count_unique - Trip No", "1 - count_unique - Boat Name", "2 - count_unique - Catch"]


def test_spec_all_reads_its_table_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x", 2.0), ("a", 1, None, 3.0), ("b", None, "x", 2.0)], "k string, n int, t string, d double")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = aggregate(df, "k", spec_all(df, "count_unique"))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 1, 2, 2), ("b", 1, 1, 1, 1)]


def test_each_spec_keeps_its_own_categories(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "c", 4), ("m", "c", 5)], "k string, cat string, v int")
    specs = [AggSpec("category-sum", "v", n, {"cat_key_col": "cat", **({"categories": c} if c else {})})
             for n, c in (("x", ["a"]), ("y", ["b", "c"]), ("z", None))]
    out = aggregate(df, "k", specs, as_text=True)
    assert [c for c in out.columns if "__" not in c] == ["k", "x - a", "y - b", "y - c", "z - a", "z - b", "z - c"]
    assert {r["k"]: (r["x - a"], r["y - b"], r["y - c"], r["z - c"]) for r in out.collect()}["k"] == ("1.0", "2.0", "4.0", "4.0")


def test_long_cells_go_to_parts(spark):
    df = kv(spark, [("a", f"{i:03d}") for i in range(200)] + [("b", "x")])
    out = aggregate(df, "k", [AggSpec("concatenate", "v", "c")], order_by=["v"])
    assert {r["k"]: r["c"] for r in out.collect()} == {"a": ", ".join(f"{i:03d}" for i in range(200)), "b": "x"}
    for unique in (False, True):
        parts = concatenate_parts(df, "k", "v", ["v"], part_rows=7, unique=unique).where("key = 'a'").orderBy("part").collect()
        assert len(parts) > 20
        assert ", ".join(r["text"] for r in parts) == ", ".join(f"{i:03d}" for i in range(200))


def test_de_aggregate(spark, rows):
    df = spark.createDataFrame([("Petrel", 95, "11+13+ 16"), ("Gannet", 90, "12+14+"), ("Tern", 0, None)], "n string, t int, `Trips` string")
    out = de_aggregate(df, "Trips", "+")
    assert out.columns == df.columns
    assert rows(out) == [("Gannet", 90, ""), ("Gannet", 90, "12"), ("Gannet", 90, "14"), ("Petrel", 95, "11"), ("Petrel", 95, "13"),
                         ("Petrel", 95, "16"), ("Tern", 0, "None")]
    dots = spark.createDataFrame([("a.|b.|c",)], "x string")
    assert rows(de_aggregate(dots, 0, ".|")) == [("a",), ("b",), ("c",)]


def test_round_trip(orders, rows):
    joined = aggregate(orders, "Boat Name", [AggSpec("concatenate", "Trip No", "ids")], order_by=["Trip No"])
    back = de_aggregate(joined, "ids").select(F.col("ids").cast("bigint"))
    assert rows(back) == rows(orders.select("Trip No"))
