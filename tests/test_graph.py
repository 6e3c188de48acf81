import pytest
from conftest import rows
from graphs import demo, fixture
from pyspark.sql import functions as F

from latticework import namespaces
from latticework.errors import UnknownPrefix
from latticework.graph import TripleGraph
from latticework.operators import analyses, bindings, verify


@pytest.fixture(scope="module")
def g(spark):
    return fixture(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return TripleGraph.of(spark.createDataFrame([], "s string, p string, o string"))


def test_sets_and_patterns(g):
    assert g.triples.count() == g.triples.distinct().count()
    assert {r[1] for r in rows(g.pairs("core:jurisdiction"))} == {"US", "EU"}
    none = g.pairs("skos:related")
    assert none.count() == 0 and none.columns == ["s", "o"]
    assert g.subjects("a", "core:Framework").count() == 2
    assert g.pairs("core:elaborates").count() == 5 and g.subjects("a", "core:Subpoint").count() == 5
    assert g.pairs("core:hasExample").count() == 1


def test_bindings(g):
    assert bindings.role_bindings(g).count() == 3
    assert bindings.unit_bindings(g).columns == ["unit", "framework", "unit_name", "framework_name"]
    a1 = f"{namespaces.CORE}ua1"
    assert bindings.role_bindings(g).where(F.col("role") == a1).count() == 1  # the repeated triple counts once
    counts = dict(rows(bindings.element_bindings(g).groupBy("framework_name").count()))
    assert counts == {"Framework A": 6, "Framework B": 5}
    per = {r[0].rpartition("#")[2]: r[1] for r in rows(bindings.role_element_bindings(g).groupBy("role").count())}
    assert per == {"ua1": 4, "ua2": 1, "ub1": 5}
    assert [r[2] for r in rows(bindings.example_bindings(g))] == ["Framework A"]
    assert bindings.strict_elements(g).count() == 10


def test_example_in_has_element_stays_out_of_strict(g, spark):
    more = g.union(TripleGraph.from_rows(spark, [("core:ua1", "core:hasElement", "core:a2.example.1", "iri")]))
    assert bindings.strict_elements(more).count() == 10


def test_two_names_and_two_frameworks(g, spark):
    more = g.union(TripleGraph.from_rows(spark, [("core:ua1", "schema:name", "Other name", "literal"), ("core:a3", "core:partOf", "core:nowhere", "iri")]))
    assert bindings.unit_bindings(more).count() == 4
    assert bindings.element_bindings(more).count() == 11


def test_empty_graph(empty, spark):
    for f in (bindings.framework_metadata, bindings.role_bindings, bindings.unit_bindings, bindings.element_bindings, bindings.example_bindings, bindings.role_element_bindings):
        assert f(empty).count() == 0
    assert all(r["status"] == "ok" and r["rows"] == 0 for r in analyses.run_all(spark, empty).collect())


def test_demo(spark):
    d = demo(spark)
    assert [x.count() for x in (bindings.framework_metadata(d), bindings.unit_bindings(d), bindings.role_bindings(d), bindings.element_bindings(d), bindings.example_bindings(d), bindings.role_element_bindings(d))] == [2, 3, 2, 7, 1, 6]
    assert all(r["sector"] is None for r in bindings.framework_metadata(d).collect())
    assert rows(analyses.density(d)) == [("Framework A", 2, 4, 2.0), ("Framework B", 1, 3, 3.0)]
    assert analyses.elements_without_text(d).count() == 1


def test_match(g):
    found = g.match([("?u", "a", "core:Role"), ("?u", "core:hasElement", "?e")], [("?e", "core:hasExample", "?x")])
    assert found.count() == 10 and found.where("x IS NOT NULL").count() == 1
    assert g.match([("?f", "core:jurisdiction", '"US"')]).count() == 1
    with pytest.raises(ValueError):
        g.match([("?a", "a", "core:Role"), ("?b", "a", "core:Example")])


def test_runner_isolates_errors(g, spark):
    def broken(_):
        raise ValueError("no")

    report = {r["query_id"]: r["status"] for r in analyses.run_all(spark, g, analyses={"bad": ("", broken), "good": ("", analyses.units_per_framework)}).collect()}
    assert report == {"bad": "error: ValueError", "good": "ok"}


def test_summary(g, spark):
    summary = analyses.framework_summary(g.cache(), spark.createDataFrame([], "framework_slug string, framework_type string, license string"))
    assert analyses.summary_faults(summary).count() == 0
    assert {r["framework_name"]: (r["element_count_strict"], r["element_count_with_examples"]) for r in summary.collect()} == {"Framework A": (5, 6), "Framework B": (5, 5)}


def test_namespaces(spark):
    assert namespaces.expand("a") == namespaces.RDF_TYPE and namespaces.expand("schema:name") == "http://schema.org/name"
    assert set(namespaces.context("nice")) == {*namespaces.BASE, "nice"}
    with pytest.raises(UnknownPrefix):
        namespaces.context("nowhere")
    with pytest.raises(UnknownPrefix):
        namespaces.expand("nowhere:x")
    df = spark.createDataFrame([("digcomp:1.1:a",), ("x:y",)], "n string")
    assert rows(df.select(namespaces.expanded(F.col("n")))) == [(namespaces.FRAMEWORKS["digcomp"] + "1.1:a",), ("x:y",)]


def test_checks(spark, g, tmp_path):
    df = spark.createDataFrame([("1", "good enough text"), ("1", ""), ("2", None), (None, "short"), ("3", "bad � char text"), ("4", "x" * 5001)], "id string, text string")
    found = {r["check"]: r["severity"] for r in verify.text_checks(df, "f", "text").collect()}
    assert found == {"text.replaced": "hard", "text.empty": "hard", "text.short": "soft", "text.long": "soft", "text.truncation": "pass"}
    ids = verify.id_checks(df, "f", "id").first()
    assert ids["severity"] == "hard" and ids["details"]["examples"] == "1"
    assert verify.id_checks(df, "f", "nope").first()["check"] == "id.present"
    cut = spark.createDataFrame([("y" * 255,)] * 6, "text string")
    assert verify.text_checks(cut, "f", "text").where("check = 'text.truncation'").first()["severity"] == "hard"
    assert {r["metric"]: r["value"] for r in verify.metrics(df, n=F.count("*"), ids=verify.distinct("id")).collect()} == {"n": 6.0, "ids": 5.0}
    assert verify.manifest_checks(spark, "f", None).first()["severity"] == "hard"
    good = dict.fromkeys(verify.REQUIRED_KEYS, {}) | {"retrieval": {"file_sha256": "AB"}}
    assert [r["severity"] for r in verify.manifest_checks(spark, "f", good, "ab").collect()] == ["pass", "pass"]
    assert [r["severity"] for r in verify.manifest_checks(spark, "f", good, None).collect()] == ["pass", "hard"]
    assert {r["check"]: r["details"]["n"] for r in verify.link_checks(g).collect()}["reference.partOf"] == "1"
    audit = str(tmp_path / "audit")
    assert verify.gate(verify.record(spark, "f", "c", "pass", "m"), audit) == {"pass": 1}
    with pytest.raises(verify.VerificationFailed):
        verify.gate(verify.record(spark, "f", "c", "hard", "m"), audit)
    assert sorted(r["overall_status"] for r in spark.read.json(audit).collect()) == ["FAIL", "PASS"]
    assert [r["severity"] for r in verify.report(verify.record(spark, "f", "c", "pass", "m").union(verify.record(spark, "f", "c", "hard", "m"))).collect()] == ["hard", "pass"]
