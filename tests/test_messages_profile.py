import pytest
from pyspark.sql import functions as F

from twinledger import (
    column_uniqueness,
    extract_column,
    first_columns,
    foreign_texts,
    parse_envelopes,
    profile,
    reassemble,
    snapshot,
    split_messages,
    spread_cells,
    square_rows,
    strip_cells,
    union_tables,
)
from twinledger.operators.messages import decode_payload, encode_binary


def test_parse(spark, rows):
    df = spark.createDataFrame([("TTKQR1|abcd1234|2/5|base64|photo.jpg|AB|CD",), ("https://example.com/x",), ("TTKQR1|a|b",),
                                ("TTKQR1|s|x/2|utf8||p",), ("TTKQR1|s|1/2/3|utf8||p",)], "t string")
    got = parse_envelopes(df, "t").select("is_foreign", "session", "seq", "total", "encoding", "filename", "payload")
    assert rows(got)[0] == (False, "abcd1234", 2, 5, "base64", "photo.jpg", "AB|CD")
    assert sum(r[0] for r in rows(got)) == 4
    assert foreign_texts(df, 0).count() == 4


def python_chunks(text, session, filename, cap):
    total = 1
    while True:
        room = cap - len(f"TTKQR1|{session}|{total}/{total}|uuencode|{filename}|")
        needed = max(1, -(-len(text) // room))
        if needed == total:
            return [text[i:i + room] for i in range(0, len(text), room)] or [""]
        total = needed


@pytest.mark.parametrize("size, cap", [(0, 60), (1, 60), (24, 60), (500, 60), (3000, 60), (3000, None), (901, 50)])
def test_split_and_reassemble(spark, rows, size, cap):
    text = "".join(chr(97 + i % 26) if i % 7 else "ä|" for i in range(size))[:size]
    df = spark.createDataFrame([("s1", text, "f.txt"), ("s2", "short", None)], "s string, t string, f string")
    chunks = split_messages(df, "s", "t", "f", cap=cap)
    expected = python_chunks(text, "s1", "f.txt", cap or 2953)
    got = [r["envelope"] for r in chunks.where("session = 's1'").orderBy("seq").collect()]
    assert got == [f"TTKQR1|s1|{i + 1}/{len(expected)}|utf8|f.txt|{c}" for i, c in enumerate(expected)]
    assert all(len(g) <= (cap or 2953) for g in got)
    back = reassemble(chunks.withColumn("at", F.col("seq")), "envelope", "at").where("session = 's1'").first()
    assert back["content"] == text and back["complete"] and back["filename"] == "f.txt" and not back["missing"]


def test_capacity_error(spark):
    df = spark.createDataFrame([("s", "text", "f" * 100)], "s string, t string, f string")
    with pytest.raises(Exception, match="no room"):
        split_messages(df, "s", "t", "f", cap=60).collect()
    with pytest.raises(ValueError):
        split_messages(df, "s", "t", error_correction="X")


def test_duplicates_and_gaps(spark):
    rows = [(1, "TTKQR1|a|1/3|utf8|f|old"), (2, "TTKQR1|a|1/3|utf8|f|new"), (3, "TTKQR1|a|3/3|utf8|f|end"),
            (4, "TTKQR1|b|2/2|utf8||y"), (5, "TTKQR1|b|1/2|utf8|g|x"), (6, "hello"), (7, "TTKQR1|c|5/9|utf8||z")]
    df = spark.createDataFrame(rows, "at int, t string")
    got = {r["session"]: r for r in reassemble(df, "t", "at").collect()}
    assert got["b"]["content"] == "xy" and got["b"]["filename"] == "g"
    assert got["a"]["content"] is None and [tuple(m) for m in got["a"]["missing"]] == [(2, 2)] and not got["a"]["complete"]
    assert [tuple(m) for m in got["c"]["missing"]] == [(1, 4), (6, 9)] and got["c"]["chunks"] == 1
    again = spark.createDataFrame([(1, "TTKQR1|s|1/3|utf8|f|x"), (2, "TTKQR1|s|1/1|utf8|f|y")], "at int, t string")
    got = reassemble(again, "t", "at").first()
    assert (got["total"], got["complete"], got["content"]) == (1, True, "y")


def test_base64(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xff12"),)], "b binary")
    text = df.select(encode_binary(F.col("b")).alias("t"))
    assert text.first()["t"] == "AP8xMg=="
    assert bytes(text.select(decode_payload(F.col("t"), F.lit("base64"))).first()[0]) == b"\x00\xff12"


def test_uniqueness(spark, rows):
    unique, repeated = column_uniqueness(spark.createDataFrame([(v,) for v in [1, 1, 2, 3, None, None]], "v int"), 0)
    assert rows(unique) == [(2, 1), (3, 1)] and rows(repeated) == [(1, 2), (None, 2)]


def test_profile(spark, rows):
    df = spark.createDataFrame([(2, "b", None), (1, "a" * 60, 1.5)], "i int, t string, d double")
    got = rows(profile(df, order_by=["i"]))
    assert got == [
        (0, "A", "i", "int", 2, 2, "1", "1", "2", 2),
        (1, "B", "t", "string", 2, 2, "a" * 50, "a" * 60, "b", 2),
        (2, "C", "d", "double", 2, 1, "1.5", "1.5", "1.5", 1),
    ]


def test_snapshot(spark, rows):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("b"), F.lit(None).cast("string").alias("n"))
    shot = snapshot(df, 3, 2, order_by=["id"])
    assert (shot.row_count, shot.col_count, shot.truncated_rows, shot.truncated_cols) == (10, 3, True, True)
    assert shot.column_labels == ["A", "B"] and rows(shot.rows) == [("0", "0"), ("1", "2"), ("2", "4")]
    whole = snapshot(df)
    assert not whole.truncated_rows and whole.rows.first()["n"] == "None"


def test_columns(spark, rows):
    ragged = spark.createDataFrame([(["1", "2", "3"],), (["4"],), (["5", "6", "7", "8"],)], "r array<string>")
    assert rows(square_rows(ragged, 0, 3)) == [(["1", "2", "3"],), (["4", "", ""],), (["5", "6", "7"],)]
    assert spread_cells(ragged, "r", ["A", "B", "C"]).columns == ["A", "B", "C"]
    a, b = spark.createDataFrame([(1, " x ")], "i int, t string"), spark.createDataFrame([("y", 2.0)], "t string, d double")
    assert rows(union_tables([strip_cells(a), b])) == [(1, "x", None), (None, "y", 2.0)]
    assert extract_column(a, 1).columns == ["t"] and first_columns(a, 1).columns == ["i"]


def test_row_wise_operators_run_on_streams(spark, tmp_path):
    from twinledger import compare_columns, de_aggregate, flatten

    spark.sql("select 'a,b' x, 'a,b' y, array(1, 2) z").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string, y string, z array<int>").parquet(str(tmp_path / "in"))
    out = flatten(de_aggregate(compare_columns(stream, "x", "y", new_col_name="r"), "x", ",")).table
    query = out.writeStream.format("memory").queryName("rowwise").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("rowwise").collect()) == [
        ("a", "a,b", "1", "PASS"), ("a", "a,b", "2", "PASS"), ("b", "a,b", "1", "PASS"), ("b", "a,b", "2", "PASS")
    ]
