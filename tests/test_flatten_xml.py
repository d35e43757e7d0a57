import io
import itertools
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from twinledger import (
    FlattenOptions,
    archive_members,
    detect_record_path,
    expected_rows,
    flatten,
    parse_documents,
    read_xml,
    read_xml_archive,
    read_xml_tables,
    select_records,
)
from twinledger.sources.outline import outline_of
from twinledger.sources.xml import read_xml_records

# Beds with three lists that do not depend on each other, one of them a list in a list; one bed has text alone.
GARDEN = """<Garden>
  <Bed><Tool>rake</Tool><Tool>fork</Tool><Tool>hoe</Tool>
    <Row><Seed>1</Seed><Seed>2</Seed></Row><Row><Seed>3</Seed></Row>
    <Note by="x">dry</Note><Note by="y">wet &amp; cold</Note></Bed>
  <Bed>fallow</Bed>
  <Bed><Row><Seed>4</Seed></Row><Tool>spade</Tool></Bed>
</Garden>"""
# Context two levels above the record, which a later sibling adds to.
COURT = """<Court><Wing>upper<Hall><Desk><Seat>a</Seat></Desk><Desk><Seat>b</Seat></Desk></Hall></Wing>
  <Wing><Hall name="blue"><Desk><Seat>c</Seat></Desk></Hall></Wing></Court>"""
# A default namespace and two prefixes, one of them declared where it is used.
CHART = """<chart xmlns="urn:chart" xmlns:p="urn:place"><p:spot p:id="1" rank="low"><p:depth>9</p:depth></p:spot>
  <p:spot p:id="2"><q:tide xmlns:q="urn:tide">3</q:tide></p:spot><p:spot p:id="3"/></chart>"""
UNCLOSED = "<deck><card>1</card><card>2</deck>"


def save(folder, **files):
    for name, text in files.items():
        (folder / name.replace("_dot_", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def collected(result):
    return result.table.columns, [tuple(r) for r in result.table.collect()]


def test_explode_and_auto_detection(spark, tmp_path):
    path = save(tmp_path, a_dot_xml=GARDEN)
    by_path = read_xml(spark, path, "Bed")
    columns, rows = collected(by_path)
    assert columns == ["#text", "Tool", "Row.Seed", "Note.@by", "Note.#text"]
    expected = [("", t, s, b, n) for t, s, (b, n) in itertools.product(("rake", "fork", "hoe"), "123", (("x", "dry"), ("y", "wet & cold")))]
    expected += [("fallow", "", "", "", ""), ("", "spade", "4", "", "")]
    assert sorted(rows) == sorted(expected)
    assert sorted(collected(read_xml(spark, path))[1]) == sorted(rows)
    assert by_path.record_count() == 20 and by_path.warnings == [] and "Row.Seed" in by_path.discovered_paths


@pytest.fixture(scope="module")
def beds(spark, tmp_path_factory):
    path = save(tmp_path_factory.mktemp("garden"), a_dot_xml=GARDEN)
    return read_xml_records(spark, path, "Garden.Bed")[0]


def full_bed(result):
    return next(r.asDict() for r in result.table.collect() if any("rake" in str(v) for v in r))


def test_aggregate_strategy(beds):
    row = full_bed(flatten(beds, list_strategy="aggregate"))
    assert json.loads(row["Tool"]) == ["rake", "fork", "hoe"] and json.loads(row["Row"])[1] == {"Seed": ["3"]}
    assert json.loads(row["Note"]) == [{"#text": "dry", "@by": "x"}, {"#text": "wet & cold", "@by": "y"}]
    row = full_bed(flatten(beds, list_strategy="aggregate", aggregate_format="delimited", aggregate_delimiter="/"))
    assert row["Tool"] == "rake/fork/hoe" and row["Note"].startswith("[{")
    row = full_bed(flatten(beds, list_strategy="aggregate", aggregate_format="xml"))
    assert row["Tool"] == "<Tool>rake</Tool><Tool>fork</Tool><Tool>hoe</Tool>"
    assert row["Note"].count("<Note by=") == 2 and "&amp;" in row["Note"] and "\n" not in row["Note"]


def test_indexed_strategy(beds):
    result = flatten(beds, list_strategy="indexed", max_indexed_items=1)
    row = full_bed(result)
    assert row["Tool.0"] == "rake" and "Tool.1" not in row and row["Row.0.Seed.0"] == "1" and row["Note.0.@by"] == "x"
    assert any("2 item(s)" in w and w.startswith("Tool") for w in result.warnings)
    wide = flatten(beds, list_strategy="indexed")
    assert [p for p in wide.discovered_paths if p.startswith("Tool")] == ["Tool.0", "Tool.1", "Tool.2"]
    assert "Row.0.Seed.1" in wide.discovered_paths and "Row.2.Seed.0" not in wide.discovered_paths
    fixed = flatten(beds, list_strategy="indexed", indexed_width=4)
    assert [p for p in fixed.discovered_paths if p.startswith("Tool")] == [f"Tool.{i}" for i in range(4)]


def test_metadata_comes_with_the_first_run(beds):
    result = flatten(beds, list_strategy_overrides={"Row": "indexed", "Note": "residual"}, max_indexed_items=1)
    rows = result.table.collect()
    found = result.metadata()
    assert (found["records"], found["rows"], found["items_left_out"]) == (3, len(rows), sum(r["Tool"] in ("rake", "fork", "hoe") for r in rows))
    assert found["truncated_paths"] == ["Note"] and found["columns"] == result.table.columns and len(found["warnings"]) == 1


def test_residual_and_depth(beds):
    result = flatten(beds, list_strategy="residual", residual_format="json")
    assert json.loads(full_bed(result)["Tool.residual"]) == ["rake", "fork", "hoe"]
    assert result.truncated_paths == ["Note", "Row", "Tool"]
    cut = flatten(beds, max_depth=1, list_strategy_overrides={"Tool": "aggregate"})
    assert "Row.Seed.residual" in cut.table.columns and cut.truncated_paths == ["Row.Seed"]
    assert {r["Row.Seed.residual"] for r in cut.table.collect()} == {"", *(f"<Seed>{i}</Seed>" for i in range(1, 5))}
    shallow = full_bed(flatten(beds, max_depth=0, residual_format="json"))
    assert shallow["Tool.residual"] == '"rake"' and json.loads(shallow["Row.residual"]) in ({"Seed": ["1", "2"]}, {"Seed": ["3"]})


def test_residual_as_structure(beds):
    result = flatten(beds, list_strategy="residual", residual_format="dict")
    assert dict(result.table.dtypes)["Tool.residual"] == "variant" and dict(result.table.dtypes)["#text"] == "string"
    seed = F.expr("try_variant_get(`Row.residual`, '$[0].Seed[1]', 'string')")
    found = result.table.select(seed.alias("s"), F.expr("try_variant_get(`Tool.residual`, '$[0]', 'string')").alias("t")).collect()
    assert sorted((r["s"] or "", r["t"] or "") for r in found) == [("", ""), ("", "spade"), ("2", "rake")]
    cut = flatten(beds, max_depth=0, residual_format="dict", list_strategy="aggregate")
    assert cut.table.count() == 3


def test_options(beds):
    assert flatten(beds, list_strategy_overrides={"Tool": "aggregate"}).table.count() == 8
    assert "Row/Seed" in flatten(beds, path_separator="/").table.columns
    assert not [c for c in flatten(beds, include_attributes=False).table.columns if "@" in c]
    assert flatten(beds, include_text=False).table.columns == ["Note.@by"]
    assert flatten(beds, column_order="alpha").table.columns == sorted(flatten(beds).table.columns)
    few = flatten(beds, max_columns=2)
    assert len(few.table.columns) == 2 and "3 column(s)" in few.warnings[0]
    assert flatten(beds, empty_value="<missing>").table.where("`Note.@by` = '<missing>'").count() == 2
    forced = flatten(beds, list_strategy="aggregate", force_list=("#text", "Tool"))
    assert full_bed(forced)["Tool"] == '["rake","fork","hoe"]'
    for bad in (dict(list_strategy="zip"), dict(residual_format="yaml"), dict(aggregate_format="yaml"), dict(column_order="x")):
        with pytest.raises(ValueError):
            FlattenOptions(**bad)


def test_expected_rows(beds):
    assert tuple(expected_rows(beds.select("Tool", "Note")).first()) == (3, 8)


def test_plain_nested_data(spark):
    df = spark.sql("select 1 id, array(named_struct('a', 1, 'b', array(1.5D, 2.5D)), named_struct('a', 2, 'b', null)) xs")
    assert sorted(tuple(r) for r in flatten(df).table.collect()) == [("1", "1", "1.5"), ("1", "1", "2.5"), ("1", "2", "")]
    assert detect_record_path(df.schema) == ["xs"]


def test_ancestor_context(spark, tmp_path):
    path = save(tmp_path, c_dot_xml=COURT)
    columns, rows = collected(read_xml(spark, path, "Hall.Desk"))
    assert columns == ["Hall.@name", "Wing", "Seat"]
    assert sorted(rows) == [("", "upper", "a"), ("", "upper", "b"), ("blue", "", "c")]
    assert sorted(collected(read_xml(spark, path, "Desk"))[1]) == sorted(rows)
    assert collected(read_xml(spark, path, "Desk", ancestors=False))[0] == ["Seat"]


def test_select_records(spark):
    docs = spark.createDataFrame([("d1", COURT), ("d2", COURT.replace("blue", "red"))], "doc string, xml string")
    parsed = parse_documents(docs, "xml")
    got = flatten(select_records(parsed, "Court.Wing.Hall.Desk", root="Court", carry=("doc",)), carry=("doc",)).table
    assert got.columns == ["doc", "Hall.@name", "Wing", "Seat"] and got.count() == 6
    assert {tuple(r) for r in got.collect()} >= {("d1", "", "upper", "a"), ("d1", "blue", "", "c"), ("d2", "red", "", "c")}
    assert set(select_records(parsed, carry=("doc",)).columns) == {"doc", "#text", "Hall"}
    with pytest.raises(ValueError):
        select_records(parsed, "No.Such", carry=("doc",))


def test_namespaces(spark, tmp_path):
    path = save(tmp_path, n_dot_xml=CHART)
    assert collected(read_xml(spark, path, "spot"))[0] == ["@id", "@rank", "depth", "tide"]
    columns, rows = collected(read_xml(spark, path, "spot", namespace_mode="prefix"))
    assert columns == ["@p:id", "@rank", "p:depth", "q:tide"]
    assert sorted(rows) == [("1", "low", "9", ""), ("2", "", "", "3"), ("3", "", "", "")]
    kept = read_xml(spark, path, "spot", namespace_mode="keep").table.columns
    assert kept == ["@{urn:place}id", "@rank", "{urn:place}depth", "{urn:tide}tide"]
    with pytest.raises(ValueError):
        read_xml(spark, path, "spot", namespace_mode="drop")


def test_malformed(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    good = "".join(f"<leg><km>{i}</km></leg>" for i in range(200))
    path = save(folder, m_dot_xml=f"<tour>{good}<leg><km>torn</mk></leg>{good}</tour>")
    with pytest.raises(Exception):
        read_xml(spark, path, "leg").table.collect()
    skipped = [r[0] for r in collected(read_xml(spark, path, "leg", on_malformed="skip"))[1]]
    assert "torn" not in skipped and skipped[:200] == [str(i) for i in range(200)]
    assert "0" in {r["km"] for r in read_xml(spark, path, "leg", on_malformed="recover").table.collect()}
    docs = spark.createDataFrame([("good", "<deck><card>1</card></deck>"), ("bad", UNCLOSED)], "n string, x string")
    got = parse_documents(docs, "x", on_malformed="skip")
    assert [r["n"] for r in got.collect()] == ["good"]
    with pytest.raises(Exception):
        parse_documents(docs, "x").collect()


def test_folder(spark, tmp_path):
    save(tmp_path, east_dot_xml="<Depot><Crate><Lot>1</Lot></Crate><Crate><Lot>5</Lot></Crate><Crate><Lot>6</Lot></Crate></Depot>",
         west_dot_xml="<Depot><Crate><Lot>2</Lot><Mark>9</Mark></Crate></Depot>", list_dot_txt="plain text")
    tables = read_xml_tables(spark, str(tmp_path), "Depot.Crate")
    assert list(tables) == ["east.xml", "west.xml"]
    assert tables["east.xml"].columns == ["Lot", "Mark"] and [tuple(r) for r in tables["west.xml"].collect()] == [("2", "9")]
    assert ("6", "") in [tuple(r) for r in tables["east.xml"].collect()]
    assert read_xml(spark, str(tmp_path), "Depot.Crate", max_rows=2).table.count() == 3


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for place, lots in (("north", (1, 2)), ("south", (3, 4, 5))):
        (tmp_path / place).mkdir()
        save(tmp_path / place, stock_dot_xml="<Depot>" + "".join(f"<Crate><Lot>{n}</Lot></Crate>" for n in lots) + "</Depot>")
    assert read_xml(spark, f"{tmp_path}/*", "Depot.Crate", max_rows=1).table.count() == 2
    tables = read_xml_tables(spark, f"{tmp_path}/*", "Depot.Crate")
    assert {name: table.count() for name, table in tables.items()} == {"north/stock.xml": 2, "south/stock.xml": 3}


def test_outline(spark, tmp_path):
    def of(text):
        return outline_of(spark, save(tmp_path, o_dot_xml=text))

    assert of(GARDEN).record_tag() == "Bed"
    assert of("<p><q/><s/></p>").record_tag() is None
    assert of("<t><u><v/><v/><v/></u><w/><w/></t>").record_tag() == "w"
    assert of(CHART).namespaces == {"": "urn:chart", "p": "urn:place", "q": "urn:tide"}


@pytest.fixture
def archive(tmp_path):
    def build(**members):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for name, content in members.items():
                data = content.encode()
                info = tarfile.TarInfo(name.replace("__", "/").replace("_", "."))
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        path = tmp_path / "all.tar.gz"
        path.write_bytes(buffer.getvalue())
        return str(path)

    return build


def test_archive(spark, archive, rows):
    path = archive(east_xml="<Depot><Crate><Lot>1</Lot></Crate><Crate><Lot>12</Lot></Crate></Depot>",
                   west_xml="<Depot><Crate><Lot>2</Lot><Mark>9</Mark></Crate></Depot>", list_txt="plain text",
                   deep__north_xml="<Depot><Crate><Lot>3</Lot></Crate></Depot>")
    assert [r[1] for r in rows(archive_members(spark, path))] == ["deep/north.xml", "east.xml", "west.xml"]
    for record_path in ("Depot.Crate", "Crate", None):
        table = read_xml_archive(spark, path, record_path).table
        assert table.columns == ["archive", "member", "Lot", "Mark"]
        assert [r[1:] for r in rows(table)] == [("deep/north.xml", "3", ""), ("east.xml", "1", ""), ("east.xml", "12", ""), ("west.xml", "2", "9")]
    assert read_xml_archive(spark, path, "Crate", max_rows=1).table.count() == 3


def test_archive_with_a_bad_member(spark, archive, rows):
    path = archive(fine_xml="<Depot><Crate><Lot>1</Lot></Crate></Depot>", torn_xml=UNCLOSED)
    assert {r[1] for r in rows(read_xml_archive(spark, path, "Crate", on_malformed="skip").table)} == {"fine.xml"}
    empty = archive(list_txt="plain text")
    assert archive_members(spark, empty).count() == 0
