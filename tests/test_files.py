import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinledger import (
    convert_types,
    read_csv,
    read_table,
    read_tables,
    read_text,
    read_xml,
    sniff_delimiter,
    write_csv,
    write_table,
    write_tables,
    write_text,
)
from twinledger.catalog import files
from twinledger.sources import delimited
from twinledger.sources.delimited import has_embedded_newlines, sniff_lines
from twinledger.sources.dispatch import detect_format


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode("utf-8") if isinstance(text, str) else text)
    return str(path)


def lines(path):
    from pathlib import Path

    return [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text(encoding="utf-8").split("\n") if line]


def test_read(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", 'id,name\n1,"a ""quoted"" one"\n2,"x,y"\n3,\n')
    df = read_csv(spark, path)
    assert df.columns == ["id", "name"]
    assert rows(df) == [("1", 'a "quoted" one'), ("2", "x,y"), ("3", "")]
    assert rows(read_csv(spark, put(tmp_path, "b.csv", "id;amount\n1;100.5\n"), delim=";", convert_numbers=True)) == [(1, 100.5)]
    assert read_csv(spark, path, header=False).count() == 4
    assert rows(read_csv(spark, put(tmp_path, "n.csv", 'a,b\n"x,1\n'), quoting="QUOTE_NONE")) == [('"x', "1")]
    assert read_csv(spark, put(tmp_path, "d.csv", "ID,ID,Val\n1,2,3\n")).columns == ["ID", "ID_2", "Val"]
    with pytest.raises(ValueError):
        read_csv(spark, path, quoting="QUOTE_SOME")


def test_line_breaks_in_quotes(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", 'id,text\n1,"two\nlines"\n2,one\n')
    assert has_embedded_newlines(spark, path)
    assert rows(read_csv(spark, path)) == [("1", "two\nlines"), ("2", "one")]
    assert not has_embedded_newlines(spark, put(tmp_path, "b.csv", 'a,b\n"x","y ""z"""\n'))


def test_header_offset(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", "Report\nmade today,,\nid,name\n1,\"a,b\"\n2,c\n")
    df = read_csv(spark, path, header_row_index=2)
    assert df.columns == ["id", "name"] and rows(df) == [("1", "a,b"), ("2", "c")]
    with pytest.raises(ValueError):
        read_csv(spark, path, header_row_index=20)


def test_encoding(spark, tmp_path, rows):
    path = put(tmp_path, "l.csv", "name\nmär\n".encode("latin-1"))
    assert rows(read_csv(spark, path, encoding="latin-1")) == [("mär",)]
    path = put(tmp_path, "w.csv", "name,price\n„Æ“,5 €\n".encode("windows-1252"))
    assert rows(read_csv(spark, path, encoding="windows-1252")) == [("„Æ“", "5 €")]


def test_convert(spark):
    df = spark.createDataFrame([("1", "2.5", "abc", "1.0", "2024-01-05 10:00:00.5", ""), (" 2 ", "", "1", "2", "", None)],
                               "i string, d string, t string, w string, s string, n string")
    out = convert_types(df, True, True)
    assert [t for _, t in out.dtypes] == ["bigint", "double", "string", "bigint", "timestamp", "string"]
    first = out.orderBy("i").first()
    assert tuple(first)[:5] == (1, 2.5, "abc", 1, datetime.datetime(2024, 1, 5, 10, 0, 0, 500000))
    assert [t for _, t in convert_types(df, False, False).dtypes] == ["string"] * 6
    big = spark.createDataFrame([("9007199254740993", "1e30", "nan")], "a string, b string, c string")
    assert [t for _, t in convert_types(big).dtypes] == ["bigint", "double", "double"]
    assert convert_types(big).first()["a"] == 9007199254740993


@pytest.mark.parametrize("delim", list(",;\t|"))
def test_sniff_accepts(delim):
    assert sniff_lines([delim.join(str(i + j) for j in range(3)) for i in range(10)]) == (delim, 3)


def test_sniff(spark, tmp_path):
    assert sniff_lines(['1,"a,b",x', '2,"c",y', '3,"d, e, f",z']) == (",", 3)
    for bad in (["This is prose, with a comma.", "And more of it.", "No commas here"], ["a", "b"], ["1,2", "1,2,3", "1"], [],
                ["only,one"], ["a,b\x00", "c,d"]):
        assert sniff_lines(bad) is None
    assert sniff_delimiter(spark, put(tmp_path, "x.txt", "a|b\n1|2\n\n3|4\n")) == ("|", 2)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\r\x00", exclude_categories=("Cs",)), max_size=12),
                          st.text(alphabet='ab",;\n ', max_size=12)), min_size=1, max_size=8))
def test_csv_round_trip(spark, tmp_path_factory, data):
    path = str(tmp_path_factory.mktemp("rt") / "t.csv")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, a string, b string")
    write_csv(df, path, quoting="QUOTE_ALL")
    back = {r["i"]: (r["a"] or "", r["b"] or "") for r in read_csv(spark, path).collect()}
    assert back == {str(i): r for i, r in enumerate(data)}


def test_write_quoting(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 2.5, None), (2, "a,b", 1e7, "x")], "i int, t string, d double, n string").coalesce(1)
    expected = {
        "QUOTE_MINIMAL": ["i,t,d,n", '1,"say ""hi""",2.5,', '2,"a,b",10000000.0,x'],
        "QUOTE_ALL": ['"i","t","d","n"', '"1","say ""hi""","2.5",""', '"2","a,b","10000000.0","x"'],
        "QUOTE_NONNUMERIC": ['"i","t","d","n"', '1,"say ""hi""",2.5,""', '2,"a,b",10000000.0,"x"'],
    }
    for quoting, want in expected.items():
        path = str(tmp_path / quoting)
        write_csv(df, path, quoting=quoting)
        assert lines(path) == want, quoting
    write_csv(df.drop("t"), str(tmp_path / "none"), quoting="QUOTE_NONE", header=False)
    assert lines(tmp_path / "none") == ["1,2.5,", "2,10000000.0,x"]
    with pytest.raises(Exception, match="needs quoting"):
        write_csv(df, str(tmp_path / "bad"), quoting="QUOTE_NONE")


def test_dates_and_text(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-05 10:00:00' ts, true b, cast(null as int) n").coalesce(1)
    write_csv(df, str(tmp_path / "c"), convert_dates=True, date_format="%d.%m.%Y")
    assert lines(tmp_path / "c") == ["ts,b,n", "05.01.2024,True,"]
    write_text(df, str(tmp_path / "t"))
    assert lines(tmp_path / "t") == ["ts\tb\tn", "2024-01-05 10:00:00\tTrue\tNone"]
    assert read_text(spark, str(tmp_path / "t")).count() == 2


def test_dispatch(spark, tmp_path, rows):
    assert [detect_format(p) for p in ("a.CSV", "x/b.tar.gz", "c.tgz", "d.xml", "noext", "a.b/c")] == [
        "csv", "xml_archive", "xml_archive", "xml", "", ""]
    df = spark.createDataFrame([(1, "a")], "i bigint, t string")
    assert write_table(df, str(tmp_path / "one"), "csv").endswith("one.csv")
    assert rows(read_table(spark, str(tmp_path / "one.csv"))) == [("1", "a")]
    write_table(df, str(tmp_path / "two.parquet"))
    assert rows(read_table(spark, str(tmp_path / "two.parquet"))) == [(1, "a")]
    write_table(df, str(tmp_path / "three.txt"))
    assert rows(read_table(spark, put(tmp_path, "s.dat", "a;b\n1;2\n"))) == [("1", "2")]
    assert read_table(spark, put(tmp_path, "p.txt", "just some text\nand more\n")).columns == ["value"]
    assert rows(read_table(spark, put(tmp_path, "q.txt", "a,b\n1,2\n"))) == [("1", "2")]
    assert rows(read_table(spark, put(tmp_path, "r.xml", "<R><Rec><X>1</X></Rec><Rec><X>2</X></Rec></R>"))) == [("1",), ("2",)]
    with pytest.raises(ValueError):
        read_table(spark, put(tmp_path, "u.bin", "nothing like a table"))
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xlsx")


def test_table_sets(spark, tmp_path, rows):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("t",)], "y string")
    folder = str(tmp_path / "set")
    write_tables({"first": a, "second": b}, folder)
    assert list(read_tables(spark, folder)) == ["first", "second"]
    assert rows(read_tables(spark, folder, "second")["second"]) == [("t",)]
    with pytest.raises(KeyError):
        read_tables(spark, folder, ["third"])
    for bad in ({}, {"": a}, {"a/b": a}, {"A": a, "a": b}):
        with pytest.raises(ValueError):
            write_tables(bad, folder)
    with pytest.raises(ValueError):
        write_tables({"n" * 31 + "1": a, "n" * 31 + "2": b}, folder, short_names=True)


@pytest.mark.parametrize("name", ["xml_late_context", "xml_read_records", "xml_folder", "xml_metadata"])
def test_files_of_queries_grow_in_number_not_in_size(spark, monkeypatch, name):
    seen, rows, size = [], 20, 2_000
    monkeypatch.setattr(files, "_ROWS_A_FILE", rows)
    monkeypatch.setattr(files, "read_xml", lambda s, path, *a, **k: seen.append(path) or read_xml(s, path, *a, **k))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(size))
    try:
        files.QUERIES[name](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    tag = {"xml_late_context": "</Order>", "xml_read_records": "</Bay>"}.get(name, "</Row>")
    text = spark.read.option("wholetext", True).text(seen[0]).select(F.regexp_count("value", F.lit(tag)).alias("n"))
    counts = [r["n"] for r in text.collect()]
    assert len(counts) > 4 and max(counts) <= rows


def test_short_whole_numbers_skip_the_long_test(spark):
    rows = [("7", "-0", "999999999999999", "1"), ("-12", " 5 ", "9007199254740993", "x"), (None, "", "1_0", "2")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    out = convert_types(df)
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "bigint", "string"]
    assert [tuple(r)[:3] for r in out.collect()] == [(7, 0, 999999999999999), (-12, 5, 9007199254740993), (None, None, 10)]
    assert delimited._SHORT_WHOLE in out._jdf.queryExecution().optimizedPlan().toString()
