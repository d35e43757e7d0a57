import pytest
from pyspark.sql import functions as F

from twinledger import ColumnPair, Texts, map_columns, reconcile, reconcile_guided


def table(spark, rows, schema="ID bigint, Name string, Amount bigint"):
    return spark.createDataFrame(rows, schema)


def detail(result):
    return {r[0]: tuple(r[1:]) for r in result["detail"].collect()}


def test_change(spark):
    old, new = table(spark, [(1, "Petrel", 100), (2, "Skua", 50)]), table(spark, [(1, "Petrel", 100), (2, "Skua", 75)])
    result = reconcile(old, new, 0, 0)
    assert detail(result) == {1: ("A", "-", "-", "-"), 2: ("A", "-", "-", "50 --> 75")}
    assert list(result) == ["detail", "duplicates in original", "duplicates in new", "summary", "headers", "keys",
                            "columns", "original", "new"]


def test_added_and_removed(spark):
    old, new = table(spark, [(1, "a"), (2, "b")], "ID bigint, Name string"), table(spark, [(1, "a"), (3, "c")], "ID bigint, Name string")
    assert detail(reconcile(old, new, 0, 0)) == {
        1: ("A", "-", "-"),
        2: ("B", "2 --> <missing record>", "b --> <missing record>"),
        3: ("C", "<missing record> --> 3", "<missing record> --> c"),
    }


def test_duplicates(spark, rows):
    old = table(spark, [(1, "a"), (1, "b"), (2, "c")], "ID bigint, Name string")
    new = table(spark, [(1, "a"), (2, "c")], "ID bigint, Name string")
    result = reconcile(old, new, 0, 0)
    assert rows(result["duplicates in original"]) == [(1, "a"), (1, "b")]
    assert rows(result["duplicates in new"]) == []
    assert detail(result)[1] == ("D", "<ambiguous> --> 1", "<ambiguous> --> a")


def test_row_number_key(spark):
    old, new = table(spark, [("a",), ("b",)], "Name string"), table(spark, [("a",), ("b",)], "Name string")
    result = reconcile(old, new, order_by=(["Name"], ["Name"]))
    assert detail(result) == {1: ("A", "-"), 2: ("A", "-")}
    assert result["original"].columns == ["Name", "Index [Autogen]"]
    with pytest.raises(ValueError):
        reconcile(old, new)


def test_tolerance(spark):
    old, new = table(spark, [(1, 100.0)], "ID bigint, V double"), table(spark, [(1, 104.0)], "ID bigint, V double")
    assert detail(reconcile(old, new, 0, 0, tolerance=0.1))[1] == ("A", "-", "--")
    assert detail(reconcile(old, new, 0, 0, tolerance=0.01))[1] == ("A", "-", "100.0 --> 104.0")
    with pytest.raises(ValueError):
        reconcile(old, new, 0, 0, tolerance=1)


def test_duplicate_header_is_reported(spark):
    old = spark.createDataFrame([(1, 1, "x")], "a bigint, b bigint, c string").toDF("ID", "ID", "Val")
    new = table(spark, [(1, "x")], "ID bigint, Val string")
    result = reconcile(old, new, 0, 0)
    headers = {r[0]: r[1] for r in result["headers"].collect()}
    assert headers["Original header names, non-unique:"] == "ID"
    assert headers["New header names, unique:"] == "ID, Val"
    info = result["columns"].orderBy("position").collect()
    assert "original column name occurs more than once" in info[0]["warnings"]
    assert info[1]["title"] == "ID --> Val" and info[2]["new_index"] == -1
    assert result["detail"].columns == ["Key", "Key Category", "ID", "ID --> Val", "Val --> <missing col>"]


def test_blank_zero_and_numeric_compare(spark):
    old = table(spark, [("1", None, "10", 0), ("2", "", "x", 1)], "k string, a string, n string, z bigint")
    new = table(spark, [("001", " ", "10.0", None), ("2.0", "v", "3", 0)], "k string, a string, n string, z bigint")
    result = reconcile(old, new, "k", "k", columns=[(1, 1, 0), (2, 2, 1), (3, 3, 0), (2, 2, 0)])
    assert detail(result) == {
        "1": ("A", "-", "-", "-", "10 --> 10.0"),
        "2": ("A", "<blank> --> v", "x --> 3.0", "1 --> <blank>", "x --> 3"),
    }
    strict = reconcile(old, new, "k", "k", columns=[(3, 3, 0)], zero_is_blank=False)
    assert detail(strict)["1"] == ("A", "0 --> <blank>")
    exact = reconcile(old, new, "k", "k", columns=[(1, 1, 0)], numeric_key=False)
    assert set(detail(exact)) == {"1", "2", "001", "2.0"}


def test_texts_and_order(spark):
    old, new = table(spark, [(2, "b", 1), (1, "a", 1)]), table(spark, [(0, "z", 1), (1, "q", 1)])
    texts = Texts(match="=", missing_record="(none)", transition=" => ")
    result = reconcile(old, new, 0, 0, columns=[ColumnPair(1, 1)], texts=texts, ordered=True)
    assert [tuple(r) for r in result["detail"].collect()] == [
        (1, "A", "a => q"), (2, "B", "b => (none)"), (0, "C", "(none) => z")
    ]


def test_itself_matches(spark):
    old = table(spark, [(1, "a", 5), (2, None, 0), (3, "", None)])
    assert set(detail(reconcile(old, old, 0, 0)).values()) == {("A", "-", "-", "-")}
    nan = spark.createDataFrame([(1, float("nan"))], "k bigint, v double")
    assert detail(reconcile(nan, nan, 0, 0))[1] == ("A", "-", "nan --> nan")


def test_all_categories(spark):
    old = table(spark, [(k, "o", 1) for k in [1, 2, 4, 4, 5, 6, 6, 7, 7]])
    new = table(spark, [(k, "n", 1) for k in [1, 3, 4, 5, 5, 6, 6, 8, 8]])
    result = reconcile(old, new, 0, 0, columns=[(1, 1)])
    assert detail(result) == {
        1: ("A", "o --> n"), 2: ("B", "o --> <missing record>"), 3: ("C", "<missing record> --> n"),
        4: ("D", "<ambiguous> --> n"), 5: ("E", "o --> <ambiguous>"), 6: ("F", "<ambiguous> --> <ambiguous>"),
        7: ("G", "<ambiguous> --> <missing record>"), 8: ("H", "<missing record> --> <ambiguous>"),
    }
    assert result["duplicates in original"].count() == 6 and result["duplicates in new"].count() == 6
    reused = reconcile(old, new, 0, 0, columns=[(1, 1)], reuse_keys=True)
    assert detail(reused) == detail(result)


def test_mapping(spark):
    old = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    new = spark.createDataFrame([(1, 2, 3)], "c int, x int, ` a ` int")
    pairs, errors = map_columns(old, new)
    assert pairs == [ColumnPair(0, 2), ColumnPair(1, -1), ColumnPair(2, 0), ColumnPair(-1, 1)] and not errors
    assert map_columns(old, new, select="AUTO-AND")[0] == [ColumnPair(0, 2), ColumnPair(2, 0)]
    assert map_columns(old, new, sort=True)[0][-1] == ColumnPair(-1, 1)
    assert map_columns(old, new.drop("x"), "POSITION")[0] == [ColumnPair(0, 0), ColumnPair(1, 1), ColumnPair(2, -1)]
    pairs, errors = map_columns(old, new, "NAME", "LIST", [("a", "c", 1), ("zz", "c", 0), (1, 7, 0)])
    assert pairs == [ColumnPair(0, 0, 1)] and len(errors) == 2
    doubled = old.toDF("a", "a", "c")
    pairs, errors = map_columns(doubled, new)
    assert errors == ['column name "a" occurs more than once in the original table and is ignored']
    with pytest.raises(ValueError):
        map_columns(old, new, select="SOME")


def test_guided(spark):
    old, new = table(spark, [(1, "a", 1)]), spark.createDataFrame([(1, 2, "a")], "ID bigint, Amount bigint, Name string")
    result = reconcile_guided(old, new, "ID", "ID")
    assert result["detail"].columns[2:] == ["ID", "Name", "Amount"]
    assert detail(result)[1] == ("A", "-", "-", "1 --> 2")
    assert "Column Errors" not in result
    assert "Column Errors" in reconcile_guided(old, new, 0, 0, columns=[(0, 0)])
