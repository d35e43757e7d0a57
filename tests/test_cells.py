import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions import cells, dates, names


def one(spark, dtype, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")
    out = df.select("i", expression(F.col("c")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_excel_column():
    assert [names.excel_column(i) for i in (0, 1, 5, 25, 26, 701, 702, 16383)] == [
        "A", "B", "F", "Z", "AA", "ZZ", "AAA", "XFD"
    ]
    for bad in (-1, 16384):
        with pytest.raises(IndexError):
            names.excel_column(bad)
    with pytest.raises(TypeError):
        names.excel_column(1.5)


def test_strip_takes_what_python_takes(spark):
    values = ["  a  ", "\t\n a b\r\n", "　x ", "\x1fq\x85", "", "   ", "in ner"]
    assert one(spark, "string", values, cells.strip) == [v.strip() for v in values]


def test_blank(spark):
    got = one(spark, "string", [None, "", " \t ", "x", "0"], lambda c: cells.is_blank(c, T.StringType()))
    assert got == [True, True, True, False, False]
    assert one(spark, "bigint", [None, 0], lambda c: cells.is_blank(c, T.LongType())) == [True, False]


def test_number_from_text_is_float(spark):
    values = ["1", " 2.5 ", "1e3", "-0", "abc", "", "1d", "2f", "0x1p3", "nan", "inf", "-Infinity", "1_000", "+7", ".5", "5.",
              "1,5", None, "١٢"]

    def expected(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    got = one(spark, "string", values, cells.number_from_text)
    for v, g in zip(values[:-1], got[:-1]):
        e = expected(v)
        assert (g is None and e is None) or (e is not None and g is not None and (g == e or (math.isnan(g) and math.isnan(e)))), v


def test_cell_type(spark):
    values = ["", "42.5", "hello", "2024-01-15", "5 mär 2020", "1/2/3", "12/31/1999", "1.2.3", "10.20.30", "may 2020", None, " "]
    assert one(spark, "string", values, lambda c: cells.cell_type(c, T.StringType())) == [
        "BLANK", "NUMBER", "TEXT", "DATE", "DATE", "TEXT", "DATE", "TEXT", "DATE", "TEXT", "BLANK", "TEXT"
    ]


def test_boolean_words(spark):
    values = ["y", "Yes", "NO", "T", "False", "1", "0", "yEs", "maybe", "", None]
    assert one(spark, "string", values, lambda c: cells.as_boolean(c, T.StringType())) == [
        True, True, False, True, False, True, False, None, None, None, None
    ]
    got = one(spark, "string", ["1", "y", "t"], lambda c: cells.as_boolean(c, T.StringType(), allow_01=False))
    assert got == [None, True, True]
    assert one(spark, "bigint", [1, 0, 2], lambda c: cells.as_boolean(c, T.LongType(), allow_01=False)) == [True, False, None]


def python_in_tolerance(a, b, t):
    if a == 0 or b == 0:
        return a == b
    if (a < 0) != (b < 0):
        return False
    lo, hi = sorted((abs(a), abs(b)))
    return hi * (1 - t) <= lo or lo * (1 + t) >= hi


def test_in_tolerance(spark):
    cases = [(100.0, 105.0), (100.0, 200.0), (0.0, 0.0), (0.0, 5.0), (-100.0, -105.0), (100.0, -100.0), (None, 1.0),
             (float("nan"), float("nan"))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, b double")
    got = [r[0] for r in df.orderBy("i").select(cells.in_tolerance(F.col("a"), F.col("b"), 0.1)).collect()]
    assert got == [True, False, True, False, True, False, False, False]
    for bad in (1, -0.1, 1.5):
        with pytest.raises(ValueError):
            cells.in_tolerance(F.lit(1), F.lit(1), bad)


def test_in_tolerance_matches_plain_python(spark):
    numbers = [0.0, 1.0, -1.0, 1.05, 1.1, 1.11, 0.9, 0.95, -0.95, 1e-9, 1e9, 104.0, 100.0]
    pairs = [(a, b) for a in numbers for b in numbers]
    df = spark.createDataFrame(pairs, "a double, b double")
    for t in (0, 0.05, 0.1, 0.5):
        for r in df.select("a", "b", cells.in_tolerance(F.col("a"), F.col("b"), t).alias("r")).collect():
            assert r["r"] == python_in_tolerance(r["a"], r["b"], t), (r, t)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True, width=64), min_size=1, max_size=60))
def test_floats_render_like_python(spark, values):
    values = [v for v in values if not (0 < abs(v) < 1e-300)]  # below, the JVM prints extra digits
    got = one(spark, "double", values, lambda c: cells.render(c, T.DoubleType())) if values else []
    for v, g in zip(values, got):
        assert g == str(v) or float(g) == v, (v, g)


def test_render(spark):
    got = one(spark, "double", [1e7, 1e16, 1.5e-5, 0.0001, 123456789.125, -2.0], lambda c: cells.render(c, T.DoubleType()))
    assert got == ["10000000.0", "1e+16", "1.5e-05", "0.0001", "123456789.125", "-2.0"]
    assert one(spark, "boolean", [True, False, None], lambda c: cells.render(c, T.BooleanType(), "None")) == ["True", "False", "None"]


def test_numeric_key(spark):
    values = ["001", "1", "1.0", " 1 ", "1e0", "1.50", "abc", "12345678901234567890", "-0", "1d", "nan", "0.1", ".1"]
    got = one(spark, "string", values, lambda c: cells.numeric_key(c, T.StringType()))
    assert got == ["1", "1", "1", "1", "1", "1.5", "abc", "12345678901234567890", "0", "1d", "nan", "0.1", "0.1"]
    assert one(spark, "double", [1.0, 1.5], lambda c: cells.numeric_key(c, T.DoubleType())) == ["1", "1.5"]
    assert one(spark, "bigint", [7], lambda c: cells.numeric_key(c, T.LongType())) == ["7"]


def test_dates(spark):
    assert dates.parse_pattern("%Y-%m-%d %H:%M:%S.%f") == "yyyy-M-d H:m:s.SSSSSS"
    assert dates.parse_pattern("%Y%m%d") == "yyyyMMdd"
    assert dates.write_pattern("%d/%m/%Y") == "dd/MM/yyyy"
    with pytest.raises(ValueError):
        dates.parse_pattern("%Q")
    text = T.StringType()
    got = one(spark, "string", ["2024-1-5", "44927", "44927.0", "nope", None, " 2024-01-05 ", "99999999"],
              lambda c: dates.to_date_cell(c, text, "%Y-%m-%d").cast("string"))
    assert got == ["2024-01-05", "2023-01-01", None, None, None, "2024-01-05", None]
    assert one(spark, "bigint", [44927, 1], lambda c: dates.serial_date(c, T.LongType()).cast("string")) == [
        "2023-01-01", "1899-12-31"
    ]
    assert one(spark, "double", [44927.0, 44927.5], lambda c: dates.serial_date(c, T.DoubleType()).cast("string")) == [
        "2023-01-01", None
    ]
    got = one(spark, "string", ["05.01.70", "05.01.21"], lambda c: dates.to_date_cell(c, text, "%d.%m.%y").cast("string"))
    assert got == ["1970-01-05", "2021-01-05"]


def test_unique_names():
    assert names.unique_names(["a", "A", "b", "a"]) == ["a", "A_2", "b", "a_3"]
