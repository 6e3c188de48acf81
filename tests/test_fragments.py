import pytest
from conftest import rows
from pyspark.sql import functions as F

from latticework.functions import fragments, nodes
from latticework.namespaces import expand

CASES = {
    "one thing; two thing; three thing": ("Subpoint", ["one thing", "two thing", "three thing"]),
    "Systems including data collection and storage. Tests disaster recovery, and more": ("Subpoint", ["data collection", "storage"]),
    "for example of alpha, beta": ("Subpoint", ["of alpha", "beta"]),
    "tools e.g. alpha, beta, gamma": None,
    "Plans e.g.alpha, beta or gamma": ("Subpoint", ["alpha", "beta", "gamma"]),
    "Uses such as one, or, the, two; etc.; three. Four": ("Subpoint", ["one, or, the, two", "three"]),
    "alpha item;\nBeta item; gamma item; delta": ("Subpoint", ["alpha item", "Beta item", "gamma item", "delta"]),
    "multi\nline Clarification statement: such as aaa, bbb": ("Example", ["aaa", "bbb"]),
    "Know it. Clarification statement: Focus on examples such as red; green; and blue.": ("Example", ["red", "green", "blue"]),
    "Nothing is listed here.": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("slug", [None, "nice"])
def test_parse(spark, slug):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k int, text string")
    found = {r["k"]: r["fragments"] for r in fragments.with_fragments(df, "text", slug=slug).collect()}
    for k, want in enumerate(CASES.values()):
        got = found[k]
        assert [f["ordinal"] for f in got] == list(range(1, len(got) + 1))
        assert ([f["text"] for f in got], {f["node_type"] for f in got}) == ((want[1], {want[0]}) if want else ([], set())), list(CASES)[k]


def test_opt_out(spark, monkeypatch):
    monkeypatch.setenv(fragments.OPT_OUT, "sfia, nice")
    df = spark.createDataFrame([("aaa; bbb; ccc",)], "text string")
    assert [len(fragments.with_fragments(df, "text", slug=s).first()["fragments"]) for s in ("nice", "ecsf", None)] == [0, 3, 3]


def test_expand_and_extend(spark):
    raw = spark.createDataFrame([("P1", "aaa; bbb; ccc", "TaskStatement"), ("P2", "X. Clarification statement: such as dd, ee, fff, ggg", "Skill"), ("P3", "plain", "Skill")], "element_id string, element_text string, subtype string")
    parents = nodes.element_nodes(raw.withColumn("framework_id", F.lit("nice-v2")), "nice", F.col("subtype"))
    every, index = fragments.expand_fragments(parents, "nice", "nice-v2", "nice")
    by = {r["id"]: r for r in every.collect()}
    assert len(by) == 3 + 3 + 2 and index.count() == 5
    assert by["nice:P1.sub.2"]["types"] == ["nice:TaskStatement", "core:Subpoint", "core:RoleElement"] and by["nice:P1.sub.2"]["elaborates"] == "nice:P1"
    assert by["nice:P2"]["has_example"] == ["nice:P2.example.1", "nice:P2.example.2"]
    assert by["nice:P2.example.1"]["types"] == ["core:Example", "core:RoleElement"] and by["nice:P2.example.1"]["elaborates"] is None
    units = spark.createDataFrame([("u", ["nice:P1", "nice:P2", "nice:P1"]), (None, []), ("w", None)], "unit string, ids array<string>")
    out = {r["unit"]: r["ids"] for r in fragments.extend_ids(units, "ids", index).collect()}
    assert out == {"u": ["nice:P1", "nice:P2", "nice:P1.sub.1", "nice:P1.sub.2", "nice:P1.sub.3"], None: [], "w": []}
    assert dict(rows(fragments.extend_ids(units, "ids", index.limit(0)).select("unit", F.size("ids"))))["u"] == 2


def test_constructors(spark):
    df = spark.createDataFrame([("r1", "Role", None, ["nice:P1"])], "unit_id string, name string, description string, has_element array<string>")
    assert nodes.role_nodes(df, "nice").collect() == nodes.unit_nodes(df, "nice", "WorkRole", is_role=True).collect()
    assert nodes.role_nodes(df, "nice").first()["types"] == ["nice:WorkRole", "core:Role", "core:OrganizingUnit"]
    g = nodes.to_triples(nodes.role_nodes(df, "nice"))
    assert g.triples.count() == 5 and rows(g.pairs("core:hasElement")) == [(expand("nice:r1"), expand("nice:P1"))]
    bad = nodes.validated(nodes.role_nodes(df.withColumn("unit_id", F.lit(None).cast("string")), "nice")).first()
    assert not bad["valid"] and bad["missing_fields"] == ["@id"]
