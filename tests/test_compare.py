import datetime

import pytest

from twinledger import Check, compare_columns, compare_many, parse_constants, specs_from_table, with_constants


def outcome(spark, schema, row, kind="text", **options):
    df = spark.createDataFrame([row], schema)
    return compare_columns(df, "Old", "New", kind, **options).first()[-1]


TEXT, NUM, MIX = "Old string, New string", "Old double, New double", "Old string, New bigint"


@pytest.mark.parametrize("row, options, expected", [
    (("abc", "abc"), {}, "PASS"),
    (("abc", "xyz"), {}, "FAIL"),
    (("abc", "xyz"), {"fail_detail": True}, "FAIL: abc -> xyz"),
    ((" ABC ", "abc"), {"strip_text_fields": True, "case_sensitive": False}, "PASS"),
    ((" ABC ", "abc"), {}, "FAIL"),
    (("", ""), {"require_nonblank": True}, "FAIL_ALL_BLANK"),
    (("", ""), {}, "PASS"),
    ((None, ""), {"fail_detail": True}, "FAIL: None -> "),
    ((None, None), {}, "PASS"),
    ((None, None), {"require_nonblank": True, "fail_text_blank": "EMPTY"}, "EMPTY"),
])
def test_text(spark, row, options, expected):
    assert outcome(spark, TEXT, row, **options) == expected


def test_text_needs_text(spark):
    assert outcome(spark, "Old bigint, New string", (1, "a")) == "ERROR"
    assert outcome(spark, "Old bigint, New string", (None, "a")) == "FAIL"
    assert outcome(spark, "Old bigint, New string", (1, None), fail_detail=True) == (
        "ERROR: Non-string data: 1 (<class 'int'>) -> None (<class 'NoneType'>)"
    )


@pytest.mark.parametrize("schema, row, options, expected", [
    (NUM, (100.0, 100.0), {}, "PASS"),
    (NUM, (100.0, 200.0), {}, "FAIL"),
    (NUM, (100.0, 200.0), {"fail_detail": True}, "FAIL: 100.0 -> 200.0"),
    (MIX, ("abc", 100), {}, "ERROR"),
    (MIX, ("100", 100), {}, "ERROR"),
    (MIX, ("100", 100), {"conv_text_to_num": True}, "PASS"),
    (MIX, ("abc", 100), {"conv_text_to_num": True, "fail_detail": True},
     "ERROR: (numerical compare conversion fail) abc (<class 'str'>) -> 100 (<class 'int'>)"),
    (NUM, (100.0, 104.0), {"tolerance": 0.1}, "PASS (WITHIN TOLERANCE)"),
    (NUM, (100.0, 104.0), {"tolerance": 0.1, "fail_detail": True}, "PASS (WITHIN TOLERANCE): 100.0 -> 104.0"),
    (NUM, (0.0, 0.0), {"require_nonzero": True}, "FAIL_ALL_ZERO"),
    (NUM, (0.0, 0.0), {}, "PASS"),
    (NUM, (float("nan"), float("nan")), {}, "FAIL"),
    (NUM, (None, 1.0), {}, "ERROR"),
    ("Old boolean, New bigint", (True, 1), {}, "PASS"),
    ("Old bigint, New bigint", (9007199254740993, 9007199254740992), {}, "FAIL"),
    ("Old bigint, New bigint", (10, -10), {"first_col_conv": "{x}*-1"}, "PASS"),
    ("Old bigint, New bigint", (10, 5), {"first_col_conv": "try_divide({x}, 0)"}, "ERROR"),
    ("Old string, New bigint", ("4", 2), {"first_col_conv": "{x}/2", "conv_text_to_num": True}, "PASS"),
])
def test_numerical(spark, schema, row, options, expected):
    assert outcome(spark, schema, row, "numerical", **options) == expected


D = datetime.date
TS = datetime.datetime


@pytest.mark.parametrize("schema, row, options, expected", [
    ("Old date, New date", (D(2024, 1, 5), D(2024, 1, 5)), {}, "PASS"),
    ("Old timestamp, New date", (TS(2024, 1, 5, 13), D(2024, 1, 5)), {}, "PASS"),
    ("Old date, New date", (D(2024, 1, 5), D(2024, 12, 6)), {"fail_detail": True}, "FAIL: 2024-1-5 -> 2024-12-6"),
    ("Old string, New date", ("2024-01-05", D(2024, 1, 5)), {}, "ERROR"),
    ("Old string, New date", ("2024-01-05", D(2024, 1, 5)), {"convert_dates": True, "first_date_format": "%Y-%m-%d"}, "PASS"),
    ("Old string, New date", ("nope", D(2024, 1, 5)), {"convert_dates": True}, "ERROR"),
    ("Old bigint, New string", (44927, "01.01.2023"), {"convert_dates": True, "second_date_format": "%d.%m.%Y"}, "PASS"),
    ("Old string, New date", ("nope", D(2024, 1, 5)), {"convert_dates": True, "fail_detail": True},
     "ERROR: (date compare conversion fail) None (<class 'NoneType'>) -> 2024-01-05 (<class 'datetime.date'>)"),
])
def test_date(spark, schema, row, options, expected):
    assert outcome(spark, schema, row, "date", **options) == expected


def test_names_and_spec_errors(spark):
    df = spark.createDataFrame([("a", "a")], TEXT)
    assert compare_columns(df, "Old", "New").columns[-1] == "COMPARE: Old | New"
    assert compare_columns(df, "Old", 1, new_col_name="check").first()["check"] == "PASS"
    message = compare_columns(df, "Old", "Missing").first()[-1]
    assert message == 'SPECIFICATION ERROR: column name specified ("Missing") not found in table provided.'
    assert "beyond bounds" in compare_columns(df, 0, 9).first()[-1]
    assert "compare_type" in compare_columns(df, 0, 1, "vague").first()[-1]
    doubled = df.toDF("Old", "Old")
    assert "not unique" in compare_columns(doubled, "Old", 1).first()[-1]


def test_batch(spark, rows):
    df = spark.createDataFrame([("a", "a", 1.0, 2.0), ("a", "b", 1.0, 1.0)], "p string, q string, x double, y double")
    checked = compare_many(df, [
        Check("p", "q", new_col_name="text", fail_detail=True),
        dict(first_col="x", second_col="y", compare_type="numerical", new_col_name="num"),
        dict(first_col="x", second_col="y", compare_type="numerical", tolerance=3),
        dict(first_col="x", second_col="y", nonsense=1),
        dict(first_col="x", second_col="y", compare_type="numerical", first_col_conv="no_such({x})"),
    ])
    assert checked.checks == ["text", "num"] and len(checked.skipped) == 3
    assert rows(checked.table.select("text", "num")) == [("FAIL: a -> b", "PASS"), ("PASS", "FAIL")]
    assert rows(checked.summary()) == [("num", "FAIL", 1), ("num", "PASS", 1), ("text", "FAIL", 1), ("text", "PASS", 1)]
    with pytest.raises(ValueError):
        compare_many(df, [dict(first_col="x", second_col="y", tolerance=3)], on_error="raise")


def test_constants(spark):
    specs = [{"first_col": "**CONST str Hello world", "second_col": "q"}, {"first_col": "**CONST int 5", "second_col": "q"},
             {"first_col": "**CONST bool Yes", "second_col": "q"}, {"first_col": "**CONST float 1.5", "second_col": "q"},
             {"first_col": "q", "second_col": "q"}]
    assert list(parse_constants(specs).values()) == ["Hello world", 5, True, 1.5]
    df = with_constants(spark.createDataFrame([("Hello world",)], "q string"), specs)
    assert compare_columns(df, "**CONST str Hello world", "q").first()[-1] == "PASS"
    for bad in ("**CONST bool maybe", "**CONST int x", "**CONST list 1", "**CONST int"):
        with pytest.raises(ValueError):
            parse_constants([{"first_col": bad}])


def test_specs_from_a_table(spark, rows):
    table = spark.createDataFrame(
        [("p", "q", "text", None, "a"), ("x", "y", "numerical", 0.6, "b"), ("**CONST int 1", "x", "numerical", None, "c")],
        "first_col string, second_col string, compare_type string, tolerance double, new_col_name string",
    )
    specs = specs_from_table(table, header_row=True, header_row_index=0, column_select_mode="name", pass_text="OK")
    df = spark.createDataFrame([("a", "a", 1.0, 2.0)], "p string, q string, x double, y double")
    checked = compare_many(with_constants(df, specs), specs, on_error="raise")
    assert rows(checked.table.select("a", "b", "c")) == [("OK", "OK (WITHIN TOLERANCE)", "OK")]
    by_index = compare_many(df, [dict(first_col="0", second_col="1", column_select_mode="index", new_col_name="r")])
    assert by_index.table.first()["r"] == "PASS"
