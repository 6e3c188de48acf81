import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from latticework.functions.nodes import to_triples
from latticework.operators import bindings
from latticework.plans import ingest
from latticework.plans.adapters import ADAPTERS, assemble
from latticework.sources import tables

META = {"name": "F", "jurisdiction": "US", "sector": "s", "specificity": "k", "version": "1", "publisher": "p"}


def test_elements_and_relations(spark, tmp_path):
    doc = {"elements": [{"element_identifier": "R1", "element_type": "work_role", "title": "A  role", "text": "t", "doc_identifier": "d"}, {"element_identifier": "T1", "element_type": "task", "title": "", "text": " do  it ", "doc_identifier": "d"}, {"element_identifier": "C", "element_type": "category", "title": "c", "text": "", "doc_identifier": "d"}],
           "relationships": [{"source_element_identifier": "R1", "dest_element_identifier": "T1", "relationship_identifier": "x"}, {"source_element_identifier": "C", "dest_element_identifier": "R1", "relationship_identifier": "y"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    elements, relations = tables.elements_and_relations(spark, str(tmp_path / "a.json"))
    assert rows(ingest.role_statements(elements, relations)) == [("R1", "A role", "T1", "task", "do it")]
    assert rows(ingest.role_categories(elements, relations)) == [("R1", "C")]


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"title": "Chief (x) Officer", "alternative_titles": ["a", "b"], "main_tasks": ["t1", "t2"], "key_skills": [], "deliverables": ["d"], "ecompetences": [["A.1", "n", "3"], ["B.2", "m", "?"]]}]))
    p = tables.profiles(spark, str(tmp_path / "p.json"))
    assert ingest.profile_catalog(p).first()["profile_id"] == "chief-officer" and ingest.profile_catalog(p).first()["alternative_titles"] == "a | b"
    assert [r[1:3] for r in rows(ingest.profile_elements(p))] == [("deliverable", 1), ("task", 1), ("task", 2)]
    assert [r["proficiency_level"] for r in ingest.profile_competences(p).orderBy("ecf_code").collect()] == [3, None]


def test_standards_and_sections(spark):
    text = "3-5.SEC.NET.1 contents 4\nshort\n3-5.SEC.NET.1 Explain how networks carry data between many computers.\nMore words on it. Page 3 of 9\nthird\n6-8.DC.ETH Discuss what is right and wrong to do with other people's data online."
    lines = tables.numbered(spark.createDataFrame([("f", text)], "file string, value string"), "file", "value")
    found = {r["standard_id"]: r for r in ingest.standards(lines).collect()}
    assert found["3-5.SEC.NET.1"]["statement_text"] == "Explain how networks carry data between many computers. More words on it. third" and found["3-5.SEC.NET.1"]["source_line"] == 3
    assert found["6-8.DC.ETH"]["sequence"] is None
    body = "\n".join(["x"] * 3 + ["4.1 Data", "Essentials", "• cryptography basics,", "• short", "• integrity and access", "Learning outcomes", "• not this bullet one", "4.2 Soft", "Essentials", "• design of software"])
    areas = spark.createDataFrame([("data", "4.1", "Data Security"), ("soft", "4.2", "Software")], "ka_id string, section string, name string")
    got = ingest.section_bullets(tables.numbered(spark.createDataFrame([("f", body)], "file string, value string"), "file", "value"), areas, after=2)
    assert [r[0] + " " + r[5] for r in rows(got)] == ["data-E01 cryptography basics", "data-E02 integrity and access", "soft-E01 design of software"]
    heads = spark.createDataFrame([("1.1", "Browsing")], "heading_id string, heading string")
    lines = tables.numbered(spark.createDataFrame([("f", "a\n1.1 Browsing data\nshort\nTo articulate information needs and to search for data.")], "file string, value string"), "file", "value")
    assert rows(ingest.described_headings(lines, heads, after=0)) == [("1.1", "To articulate information needs and to search for data.")]


def test_adapters(spark):
    t = {
        "standards": spark.createDataFrame([("1A", "aaa; bbb; ccc", "L1", "Net & Web", "like x and y"), ("1B", "plain", "L1", "Net & Web", " ")], "identifier string, standard string, level string, concept string, clarification string"),
    }
    g = to_triples(assemble(ADAPTERS["csta"], t, META))
    assert g.subjects("a", "core:Example").count() == 1 and g.subjects("a", "csta:Standard").count() == 5 and g.pairs("core:hasExample").count() == 1
    assert bindings.unit_bindings(g).count() == 1 and bindings.role_element_bindings(g).count() == 5 and bindings.role_bindings(g).count() == 0
    d = {"dcwf-roles": spark.createDataFrame([("411", "Support", "def")], "dcwf_code string, work_role string, work_role_definition string"), "master-task-ksa": spark.createDataFrame([("1", "do"), ("1", "do"), (None, "x")], "dcwf_num string, statement string")}
    g = to_triples(assemble(ADAPTERS["dcwf"], d, META))
    assert bindings.role_bindings(g).count() == 1 and bindings.element_bindings(g).count() == 1 and bindings.role_element_bindings(g).count() == 0
    k = {"competence-areas": spark.createDataFrame([("1", "Area")], "area_id string, area_name string"), "competence-descriptions": spark.createDataFrame([("1.1", "1", "Name", ""), ("1.2", "1", "N2", "long one")], "element_id string, area_id string, competence_name string, description string")}
    g = to_triples(assemble(ADAPTERS["digcomp"], k, META | {"license": "CC"}))
    assert sorted(o for _, o in rows(g.pairs("core:elementText"))) == ["Name", "long one"]
    assert g.pairs("schema:license").count() == 1
    n = {"work-roles": spark.createDataFrame([("R", "role", "about")], "element_id string, title string, text string"), **{x: spark.createDataFrame([(x[0], x.rstrip("s") if x != "knowledge" else x, "t")], "element_id string, element_type string, text string") for x in ("tasks", "knowledge", "skills")}, "role-tks-associations": spark.createDataFrame([("R", "t")], "work_role_id string, statement_id string")}
    assert to_triples(assemble(ADAPTERS["nice"], n, META)).subjects("a", "nice:KnowledgeStatement").count() == 1
    e = {"profiles": spark.createDataFrame([("p", "P", "s")], "profile_id string, title string, summary_statement string"), "profile-elements-long": spark.createDataFrame([("p", "task", 1, "do")], "profile_id string, element_type string, element_index int, element_text string")}
    assert to_triples(assemble(ADAPTERS["ecsf"], e, META)).subjects("a", "ecsf:Task").count() == 1
    s = {"skill": spark.createDataFrame([("A", "n", "d")], "code string, name string, description string"), "skill-level": spark.createDataFrame([("A", 1, "x"), ("A", 2, "y")], "code string, level int, description string")}
    assert bindings.role_element_bindings(to_triples(assemble(ADAPTERS["sfia"], s, META))).count() == 2
    c = {"standards": spark.createDataFrame([("3-5.S.N.1", "3-5", "S", "N", "text")], "standard_id string, grade_band string, theme string, sub_concept string, statement_text string"), "sub-concepts": spark.createDataFrame([], "theme string, sub_concept string, sub_concept_name string")}
    assert rows(bindings.unit_bindings(to_triples(assemble(ADAPTERS["cyberorg-k12"], c, META))).select("unit_name")) == [("3-5 N",)]
    z = {"knowledge-areas": spark.createDataFrame([("d", "Data")], "ka_id string, name string"), "essentials": spark.createDataFrame([("d-E01", "d", "x")], "element_id string, ka_id string, element_text string")}
    assert bindings.role_element_bindings(to_triples(assemble(ADAPTERS["csec2017"], z, META))).count() == 1
    sheet = spark.createDataFrame([("a", "L1", "g"), (" ", "L1", "g")], "`Identifier ` string, level string, grades string")
    assert ingest.named_rows(sheet, "identifier").count() == 1 and ingest.rows_with(sheet, "^a$").count() == 1
    assert ingest.levels_and_clusters(sheet.withColumn("concept", F.lit("A b")))[1].first()["cluster_id"] == "L1-A-b"
    assert ingest.table_file("SkillLevel") == "skill-level"


def test_statements_end_where_the_next_section_begins(spark):
    blocks = [
        ("• K-2.SEC.ACC.1 Explain why • passwords matter.  Ver. 1.0", "Explain why passwords matter."),
        ("6-8.CS.PROG Write a script. Programming and Scripting ( PROG ) Students learn", "Write a script. Programming and Scripting ("),
        ("3-5.DC.LAW.2 Name a law that protects data. 6th – 8th Grade Students", "Name a law that protects data."),
        ("9-12.DC.ETH Weigh harms. Glossary of Terms access: to enter", "Weigh harms."),
        ("9-12.DC.ETH.3 Weigh benefits 41 ", "Weigh benefits"),
    ]
    got = spark.createDataFrame(blocks, "raw string, want string").select(ingest.statement(F.col("raw")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    catalog = ingest.sub_concepts(spark)
    assert catalog.count() == 29 and catalog.where("theme = 'SEC' AND sub_concept = 'CIA'").first()[2] == "Confidentiality, Integrity, Availability"


def test_master_list(spark):
    sheet = spark.createDataFrame([("12", " do  this "), (None, "Tasks"), (" ", "x")], "`DCWF #` string, `Task / KSA` string").withColumnRenamed("DCWF #", "DCWF Number")
    assert rows(ingest.master_list(sheet)) == [("12", "do this")]
    with pytest.raises(ValueError):
        ingest.master_list(sheet.withColumnRenamed("DCWF Number", "other"))


def test_the_first_row_of_a_key_stays(spark):
    from latticework.plans.adapters import _first

    df = spark.createDataFrame([("a", k, f"t{k}") for k in range(50)] + [("b", 0, "u"), (None, 1, "v")], "k string, n int, t string").coalesce(1)
    assert rows(_first(df, "k")) == [("a", 0, "t0"), ("b", 0, "u")]
