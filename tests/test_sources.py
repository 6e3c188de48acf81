import json
import sqlite3
import zipfile

import pytest
from conftest import rows
from graphs import demo
from pyspark.sql import functions as F

from latticework.errors import FrameworkNotFound, GraphFileNotFound, MissingFrameworkWarning
from latticework.functions import nodes, text
from latticework.functions.fragments import expand_fragments
from latticework.graph import TripleGraph
from latticework.namespaces import expand
from latticework.operators import bindings
from latticework.sources import datasources, jsonld, ntriples, tables
from latticework.streaming import triples as stream


def test_ntriples(spark, tmp_path):
    path = tmp_path / "a.nt"
    path.write_text(
        '# comment\n<http://x/a> <http://x/p> <http://x/b> .\n_:b1 <http://x/p> "caf\\u00e9 \\"q\\" \\\\n\\n"@en .\n<http://x/a> <http://x/p> "1"^^<http://x/int> . # end\nnot a triple\n<http://x/a> <http://x/p> <http://x/b> .\n\n',
        encoding="utf-8",
    )
    g = ntriples.read(spark, str(path))
    found = {r["o_kind"]: r for r in g.triples.where("o_datatype IS NULL").collect()}
    assert g.triples.count() == 3 and found["literal"]["o"] == 'café "q" \\n\n' and found["literal"]["o_lang"] == "en" and found["literal"]["s"].startswith("_:")
    assert rows(ntriples.bad_lines(spark, str(path)).select("value")) == [("not a triple",)]
    ntriples.write(g, str(tmp_path / "out"))
    back = ntriples.parse(spark.read.text(str(tmp_path / "out")))[0]
    assert rows(back.drop("source")) == rows(g.triples.drop("source"))
    report = ntriples.combine(spark, {"a": str(path), "b": str(tmp_path / "none.nt")}, str(tmp_path / "all"))
    assert rows(report) == [("a", 7), ("b", None)]
    with pytest.raises(GraphFileNotFound):
        ntriples.read(spark, str(tmp_path / "none.nt"))


def test_jsonld_values(spark, tmp_path):
    """Several values, tagged and typed literals, numbers, free predicates, contexts of their own, unknown terms."""
    folder = tmp_path / "docs"
    folder.mkdir()
    node = {"@id": "core:a", "@type": "core:X", "schema:name": ["one", "two", "[x]"], "schema:description": {"@value": "deux", "@language": "fr"}, "own:n": 5, "own:b": True, "term": "t", "nowhere": 1}
    node |= {"own:link": {"@id": "own:z"}, "core:partOf": "core:f", "core:hasElement": [{"@id": "core:c"}, {"@id": "_:b0"}], "own:day": {"@value": "2020-01-01", "@type": "own:Date"}, "own:none": None}
    (folder / "1.jsonld").write_text(json.dumps({"@context": {"own": "http://own/", "term": {"@id": "http://own/term"}}, "@graph": [node]}))
    (folder / "2.jsonld").write_text(json.dumps({"@context": {"own": "http://other/"}, "@graph": [{"@id": "own:a", "own:p": "[not an array]"}]}))
    g = jsonld.read(spark, str(folder))
    a, xsd = expand("core:a"), "http://www.w3.org/2001/XMLSchema#"
    got = {(r["s"], r["p"], r["o"] if r["o_kind"] != "bnode" else "_", r["o_kind"], r["o_datatype"], r["o_lang"]) for r in g.triples.collect()}
    assert got == {
        (a, expand("a"), expand("core:X"), "iri", None, None), *((a, expand("schema:name"), x, "literal", None, None) for x in ("one", "two", "[x]")),
        (a, expand("schema:description"), "deux", "literal", None, "fr"), (a, "http://own/n", "5", "literal", xsd + "integer", None), (a, "http://own/b", "true", "literal", xsd + "boolean", None),
        (a, "http://own/term", "t", "literal", None, None), (a, "http://own/link", "http://own/z", "iri", None, None), (a, expand("core:partOf"), expand("core:f"), "iri", None, None),
        (a, expand("core:hasElement"), expand("core:c"), "iri", None, None), (a, expand("core:hasElement"), "_", "bnode", None, None),
        (a, "http://own/day", "2020-01-01", "literal", "http://own/Date", None), ("http://other/a", "http://other/p", "[not an array]", "literal", None, None),
    }
    lines = ntriples.lines_of(g)
    assert rows(ntriples.parse(lines)[0].where("o_kind <> 'bnode'").drop("source")) == rows(g.triples.where("o_kind <> 'bnode'").drop("source"))


def test_report_says_what_it_leaves_out(spark):
    told = tables.markdown_table(spark.range(12), limit=5)
    assert told.count("\n|") == 6 and told.endswith("7 more rows") and "more" not in tables.markdown_table(spark.range(3), limit=5)


def test_round_trip_through_jsonld(spark, tmp_path):
    fw = nodes.framework_nodes(spark.createDataFrame([("nice-v2", "NICE", "US", "civilian", "specific", "2", "P", None)], "framework_id string, name string, jurisdiction string, sector string, specificity string, version string, publisher string, license string"), "nice")
    raw = spark.createDataFrame([("P1", "aaa; bbb; ccc", "nice-v2")], "element_id string, element_text string, framework_id string")
    every, _ = expand_fragments(nodes.element_nodes(raw, "nice", "TaskStatement"), "nice", "nice-v2")
    unit = nodes.role_nodes(spark.createDataFrame([("U", "Unit", "nice-v2", ["nice:P1"])], "unit_id string, name string, framework_id string, has_element array<string>"), "nice")
    doc = jsonld.document(fw.unionByName(unit).unionByName(every), ["nice"])
    assert list(doc) == ["@context", "@graph"] and "schema:license" not in doc["@graph"][0]
    path = jsonld.write_document(spark, doc, str(tmp_path / "jsonld" / "nice.jsonld"))
    assert jsonld.read_document(spark, path) == doc
    g = jsonld.read(spark, path)
    assert g.subjects("a", "core:Subpoint").count() == 3
    assert {o for _, o in rows(g.pairs("core:elaborates"))} == {expand("nice:P1")}
    assert bindings.unit_bindings(g).count() == 1 and bindings.element_bindings(g).count() == 4
    assert rows(g.triples.drop("source")) == rows(nodes.to_triples(fw.unionByName(unit).unionByName(every)).triples.drop("source"))
    folder = str(tmp_path / "jsonld")
    with pytest.warns(MissingFrameworkWarning):
        both = jsonld.read_union(spark, ["nice", "sfia"], folder)
    assert both.triples.count() == g.triples.count()
    with pytest.raises(FrameworkNotFound) as error:
        jsonld.read_framework(spark, "sfia", folder)
    assert error.value.slug == "sfia"
    with pytest.raises(GraphFileNotFound):
        jsonld.read(spark, str(tmp_path / "none.jsonld"))
    assert len(jsonld.merged([doc, doc])["@graph"]) == 2 * len(doc["@graph"])


def test_stored_graph_prunes_partitions(spark, tmp_path):
    d = demo(spark)
    d.write(str(tmp_path / "g"))
    g = TripleGraph.read(spark, str(tmp_path / "g"))
    assert bindings.element_bindings(g).count() == 7
    plan = g.pairs("core:partOf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "ReadSchema: struct<s:string,o:string>" in plan


def test_csv_keeps_ids_as_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name\n1.10,"a, ""b"""\nNA,\n411,x\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), "id string, name string")
    assert rows(df) == [("1.10", 'a, "b"'), ("411", "x"), (None, None)]
    assert tables.read_csv_if_there(spark, str(tmp_path / "none.csv"), "id string") is None
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    m = {"framework": "f", "source": {"url": "u"}}
    assert tables.read_manifest(spark, tables.write_manifest(spark, str(tmp_path / "m" / "p.yml"), m)) == m
    assert tables.read_manifest(spark, str(tmp_path / "none.yml")) is None
    assert "## f" in tables.ingestion_report(spark, {"f": m, "g": None}, {"f": df})


def test_sqlite_and_xlsx(spark, tmp_path):
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE SkillLevel (code TEXT, level INTEGER)")
        c.execute("INSERT INTO SkillLevel VALUES ('A', 1), ('B', NULL)")
    datasources.register(spark)
    assert rows(spark.read.format("sqlite_table").options(path=db, table="SkillLevel").load()) == [("A", "1"), ("B", None)]
    assert datasources.sqlite_tables(db) == ["SkillLevel"]
    book = str(tmp_path / "x.xlsx")
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def sheet(body):
        return f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'

    def cell(ref, v):
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="(AB-123) One" r:id="r1"/><sheet name="(CD-456) Two" r:id="r2"/><sheet name="Notes" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>DCWF #</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", sheet(f'<row>{cell("A1", "title")}</row><row><c r="A2" t="s"><v>0</v></c>{cell("C2", "Text")}</row><row><c r="A3"><v>411</v></c>{cell("C3", "do")}</row>'))
        z.writestr("xl/worksheets/s2.xml", sheet(f'<row>{cell("A1", "DCWF #")}{cell("B1", "Extra")}</row><row>{cell("A2", "5")}{cell("B2", "e")}</row>'))
    df = spark.read.format("xlsx_sheet").options(path=book, header="DCWF").load()
    assert df.columns == ["dcwf", "x", "text"] and rows(df) == [("411", None, "do")]
    both = datasources.sheets_union(spark, book, r"^\(([A-Z]{2}-\d{3})\)", "DCWF")
    assert rows(both.select("sheet_code", "dcwf", "text", "extra")) == [("AB-123", "411", "do", None), ("CD-456", "5", None, "e")]
    raw = datasources.role_rows(spark, book)
    assert raw.columns == ["role_code", "role_sheet", "x1", "x2", "x3"] and raw.count() == 5
    assert rows(raw.where("role_code = 'CD-456'")) == [("CD-456", "(CD-456) Two", "5", "e", None), ("CD-456", "(CD-456) Two", "DCWF #", "Extra", None)]
    assert rows(datasources.skill_tables(spark, db, ["SkillLevel"])["SkillLevel"]) == [("A", "1"), ("B", None)]
    with pytest.raises(Exception, match="no table"):
        datasources.skill_tables(spark, db)


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("head one\nbody\nhead two\nmore\nend")
    found = tables.blocks(tables.numbered_lines(spark, str(tmp_path / "t.txt")), "file", "^head")
    assert rows(found.select("line", "next_line")) == [(1, 3), (3, 6)]


def test_text(spark):
    df = spark.createDataFrame([(" Threat  (old) & Risk-Manager ", "SkillLevelName")], "a string, b string")
    got = df.select(text.slugify(F.col("a")), text.kebab(F.col("b")), text.squish(F.col("a")), text.truncated(F.col("b"), 8), text.tokens(F.lit("The Data, data of a Café use x1y"))).first()
    assert tuple(got) == ("threat-risk-manager", "skill-level-name", "Threat (old) & Risk-Manager", "Skill...", ["data", "caf", "x1y"])
    assert text.snake_names(["DCWF #", "Work Role", "Work  role", ""]) == ["dcwf", "work_role", "work_role_2", "x"]


def test_stream(spark, tmp_path):
    src, store, check = (str(tmp_path / n) for n in ("src", "store", "check"))
    (tmp_path / "src").mkdir()
    for k, body in enumerate(("<http://x/a> <http://x/p> <http://x/b> .\n", "<http://x/a> <http://x/p> <http://x/b> .\n<http://x/a> <http://x/q> \"l\" .\n")):
        (tmp_path / "src" / f"{k}.nt").write_text(body)
        stream.append(spark, src, store, check).awaitTermination()
    assert spark.read.parquet(store).count() == 2
