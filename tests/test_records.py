"""Delimited files of awkward shapes, against Python's csv module and cut at any place."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from twinledger import read_cells, read_csv, square_rows
from twinledger.sources.records import Dialect


def put(folder, name, text):
    (folder / name).write_bytes(text.encode("utf-8"))
    return str(folder / name)


@pytest.fixture
def block_size(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def drawn_rows(pick, n):
    cells = ["", "x", "two words", "a,b", 'say "so"', "line\nbreak", "\n\n", '"', ",", "ends\n", '5" nail', "ü", "a" * 70]
    return [[pick.choice(cells) for _ in range(pick.choice([1, 2, 3, 3, 3, 7]))] for _ in range(n)]


@pytest.mark.parametrize("seed,block,delim", [(1, 40, ","), (2, 97, ";"), (3, 300, ","), (4, 1 << 20, "\t")])
def test_records_of_files_cut_anywhere(spark, tmp_path, block_size, seed, block, delim):
    pick = random.Random(seed)
    path = tmp_path / "files"
    path.mkdir()
    want = []
    for i in range(3):
        rows = drawn_rows(pick, 60)
        with open(path / f"f{i}.csv", "w", encoding="utf-8", newline="") as file:
            csv.writer(file, delimiter=delim, lineterminator="\n", quoting=pick.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        with open(path / f"f{i}.csv", encoding="utf-8", newline="") as file:
            want += [r for r in csv.reader(file, delimiter=delim) if r]
    block_size(block)
    got = read_cells(spark, str(path), delim=delim)
    assert sorted(r["cells"] for r in got.collect()) == sorted(want)
    if block < 1000:
        assert got.rdd.getNumPartitions() > 3  # no file is read in one piece
    wide = read_csv(spark, str(path), delim=delim, header=False)
    assert wide.columns == [f"_c{i}" for i in range(max(map(len, want)))]
    assert sorted(tuple(r) for r in wide.collect()) == sorted(tuple(r + [""] * (len(wide.columns) - len(r))) for r in want)


LINES = ["", "a", '"', '""', '"a"', '"a', 'a"', 'a"b', '"a""', '"a"",b', ',"', '",', '","', '"a","b', 'x,"y', 'x,y"', '"a"b,"c', '"\\"', ',,"a,b",,"']


@pytest.mark.parametrize("delim", [",", "|"])
def test_what_a_line_does_to_quoting(spark, delim):
    """Where a line ends, from outside and from inside a quoted cell, as the csv module finds it."""

    def ends_inside(text):
        # One more line belongs to the record exactly if the text so far ends inside a cell.
        return len(list(csv.reader([text + "\n", "next\n"], delimiter=delim))) == 1

    lines = [line.replace(",", delim) for line in LINES]
    dialect = Dialect(delim)
    rows = spark.createDataFrame([(line,) for line in lines], "v string").select(
        "v", dialect.ends_inside(F.col("v")).alias("f0"), dialect.stays_inside(F.col("v")).alias("f1"), dialect.cells(F.col("v")).alias("n"))
    for r in rows.collect():
        assert r["f0"] == ends_inside(r["v"]), r
        assert r["f1"] == ends_inside('"' + r["v"]), r
        if not r["f0"]:
            assert r["n"] == max(len(next(csv.reader([r["v"]], delimiter=delim), [])), 1), r


def test_no_cell_of_a_long_row_is_lost(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n1\n3,4,5\n6,7\n")
    df = read_csv(spark, path)
    assert df.columns == ["a", "b", "_c2"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "", ""), ("3", "4", "5"), ("6", "7", "")]
    cells = square_rows(read_cells(spark, path), "cells", 2)
    assert sorted(r["cells"] for r in cells.collect()) == [["1", ""], ["3", "4"], ["6", "7"], ["a", "b"]]


def test_each_file_has_its_header(spark, tmp_path):
    put(tmp_path, "1.csv", "a,b\n1,2\n")
    put(tmp_path, "2.csv", "b,a,c\n20,10,30\n")
    put(tmp_path, "3.csv", "a,b\n3,4,5\n")
    put(tmp_path, "4.csv", "")
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b", "_c2", "c"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", "", ""), ("10", "20", "", "30"), ("3", "4", "5", "")]
    put(tmp_path, "5.csv", 'b,"a"\n"x\ny",z\n')
    df = read_csv(spark, str(tmp_path))
    assert ("z", "x\ny", "", "") in [tuple(r) for r in df.select("a", "b", "_c2", "c").collect()] and df.count() == 4


def test_leading_lines_are_skipped_without_python(spark, tmp_path, block_size):
    for i in range(3):
        put(tmp_path, f"{i}.csv", "title\n\nk,v\n" + "".join(f"{i},{j}\n" for j in range(50)))
    block_size(64)
    df = read_csv(spark, str(tmp_path), header_row_index=2)
    assert df.columns == ["k", "v"]
    assert sorted(tuple(r) for r in df.collect()) == sorted((str(i), str(j)) for i in range(3) for j in range(50))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_skipped_lines_before_quoted_breaks(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'about "this\nk,v\n1,"x\ny"\n')
    assert [tuple(r) for r in read_csv(spark, path, header_row_index=1).collect()] == [("1", "x\ny")]


def test_empty_and_header_only(spark, tmp_path):
    assert read_csv(spark, put(tmp_path, "e.csv", "")).count() == 0
    only = read_csv(spark, put(tmp_path, "h.csv", "a,b\n"))
    assert only.columns == ["a", "b"] and only.count() == 0
