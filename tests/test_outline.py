"""Outlines and records of XML files, against a parser that holds the document whole."""

import json
import random
from collections import Counter
from xml.etree import ElementTree

import pytest

from twinledger import read_xml, select_records
from twinledger.sources.outline import Outline, outline_of
from twinledger.sources.xml import record_paths, split_units


def put(folder, *texts):
    for i, text in enumerate(texts):
        (folder / f"f{i}.xml").write_text(text, encoding="utf-8")
    return str(folder)


def expected(text):
    counts, attributes, texts = Counter(), {}, set()

    def visit(element, path):
        path = (*path, element.tag)
        counts[path] += 1
        attributes.setdefault(path, set()).update(element.attrib)
        if any((t or "").strip() for t in (element.text, *(c.tail for c in element))):
            texts.add(path)
        for child in element:
            visit(child, path)

    visit(ElementTree.fromstring(text), ())
    return counts, {p: a for p, a in attributes.items() if a}, texts


def drawn(pick, depth=0):
    """A random element with everything that may hide a mark: comments, CDATA, quotes."""
    name = pick.choice(["ledger", "entry", "sum", "memo"]) if depth else "book"
    quote = pick.choice("\"'")
    other = "'" if quote == '"' else '"'
    attributes = "".join(
        f' {a}={quote}{pick.choice(["7", "a > b", "x/>", other, ""])}{quote}' for a in ("key", "at") if pick.random() < 0.4
    )
    if depth > 4 or (depth and pick.random() < 0.2):
        return f"<{name}{attributes}/>"
    inside = [
        pick.choice(["", " ", "\n", "words", "<!-- <ledger> -- > -->", "<!---->", "<![CDATA[ <sum> ]] > ]]>", "<![CDATA[]]>", "&lt;", "<?do it?>"])
        if pick.random() < 0.5 else drawn(pick, depth + 1)
        for _ in range(pick.randrange(6) if depth else 40)
    ]
    return f"<{name}{attributes}\n>{''.join(inside)}</{name} >"


@pytest.mark.parametrize("seed,block", [(1, 64), (2, 333), (3, 50), (4, 1 << 20)])
def test_outline_of_files_cut_anywhere(spark, tmp_path, seed, block):
    pick = random.Random(seed)
    texts = ["<?xml version='1.0'?>\n<!DOCTYPE book [<!ELEMENT book ANY> <!ENTITY e 'x'>]>" + drawn(pick), drawn(pick)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = outline_of(spark, put(tmp_path, *[t.replace(" -- > ", " - > ") for t in texts]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    both = [expected(t.replace(" -- > ", " - > ")) for t in texts]
    assert Counter(found.counts) == both[0][0] + both[1][0]
    names = {p: set(a) for p, a in found.attributes.items()}
    assert names == {p: both[0][1].get(p, set()) | both[1][1].get(p, set()) for p in both[0][1].keys() | both[1][1].keys()}
    assert found.with_text == both[0][2] | both[1][2]
    tags = [Counter(p[-1] for p, n in b[0].items() for _ in range(n) if len(p) > 1) for b in both]
    assert found.most == {t: max(c[t] for c in tags) for t in tags[0] | tags[1]}
    assert next(iter(found.counts)) == ("book",)


def paths(*texts):
    out = Outline()
    for text in texts:
        p = tuple(text.split("."))
        for i in range(1, len(p) + 1):
            out.counts.setdefault(p[:i], 1)
    return out


def test_units_at_which_files_are_split():
    farm = paths("farm.barn.stall.cow", "farm.field.cow", "farm.barn.cat")
    cows = record_paths(farm, "cow")
    assert split_units(farm, cows) == {"cow": [()]}
    farm.with_text.add(("farm", "barn"))
    assert split_units(farm, cows) == {"barn": [("stall", "cow")], "field": [("cow",)]}  # one cow is in no barn
    assert split_units(farm, cows, ancestors=False) == {"cow": [()]}
    assert split_units(farm, record_paths(farm, "stall.cow")) == {"barn": [("stall", "cow")]}
    nested = paths("list.item.item.item")
    assert split_units(nested, record_paths(nested, "list.item")) == {"item": [(), ("item",), ("item", "item")]}
    assert record_paths(farm, "farm") == [("farm",)]
    with pytest.raises(ValueError):
        record_paths(farm, "barn.cow")


def rows(result):
    return sorted(tuple(r) for r in result.table.collect())


def test_records_at_every_path(spark, tmp_path):
    path = put(tmp_path, "<zoo><bird/><cage><net><bird/><bird/></net></cage></zoo>")
    assert rows(read_xml(spark, path, "bird")) == [(), (), ()]


def test_context_of_each_record(spark, tmp_path):
    late = "".join(f"<band><song no='{i}'/></band>" for i in range(3000)) + "<band from='north'><song no='last'/></band>"
    path = put(tmp_path, f"<fair>{late}</fair>", "<fair><stage light='dim'>open<band><song no='x'/></band></stage></fair>")
    result = read_xml(spark, path, "song")
    assert set(result.table.columns) == {"stage.@light", "stage", "band.@from", "@no"}
    found = {r["@no"]: (r["band.@from"], r["stage.@light"], r["stage"]) for r in result.table.collect()}
    assert len(found) == 3002 and found["0"] == ("", "", "") and found["last"] == ("north", "", "") and found["x"] == ("", "dim", "open")
    assert read_xml(spark, path, "song", ancestors=False).table.columns == ["@no"]


def test_cousins_are_found(spark, tmp_path):
    path = put(tmp_path, "<trip><day><stop><town>A</town></stop></day><night><stop><town>B</town></stop></night></trip>")
    assert rows(read_xml(spark, path)) == [("A",), ("B",)]
    documents = spark.sql("select named_struct('stop', named_struct('town', 'A')) day, named_struct('stop', named_struct('town', 'B')) night")
    assert sorted(r["town"] for r in select_records(documents).collect()) == ["A", "B"]
    lists = spark.sql("select array(named_struct('x', 1)) a, named_struct('b', array(named_struct('x', 2), named_struct('x', 3))) c")
    assert sorted(r["x"] for r in select_records(lists.selectExpr("c", "named_struct('b', a) as d")).collect()) == [1, 2, 3]
    alone = spark.sql("select named_struct('x', 1) a, array(1) b")
    assert select_records(alone).columns == ["a", "b"]


def test_shapes_that_differ_between_paths(spark, tmp_path):
    path = put(tmp_path, "<r><a><w>1</w><w>2</w></a></r>", "<r><k c='z'><b/><a><w u='m'>3</w></a></k></r>")
    result = read_xml(spark, path, "a", list_strategy="aggregate")
    found = {r["k.@c"]: json.loads(r["w"]) for r in result.table.collect()}
    assert found == {"": [{"#text": "1"}, {"#text": "2"}], "z": [{"@u": "m", "#text": "3"}]}


def test_other_files_and_empty_folders(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("<not><an/></not>")
    path = put(tmp_path, "<only><one/></only>")
    assert outline_of(spark, path).roots == ["only"] and outline_of(spark, path).record_tag() is None
    assert read_xml(spark, path).table.count() == 1
    (tmp_path / "f0.xml").write_text("no marks here")
    with pytest.raises(ValueError):
        read_xml(spark, path)
