from conftest import rows

from latticework.operators import verify
from latticework.plans.staged import STAGED, framework_metrics, staged_checks
from latticework.sources import tables


def test_metrics(spark):
    def one(*values):
        return spark.createDataFrame([(v,) for v in values], "x string")

    nice = {"tasks": one("a", "b"), "knowledge": one("c"), "skills": one(), "work-roles": one("r")}
    found = {r["metric"]: r["value"] for r in framework_metrics(spark, STAGED["nice"], nice).collect()}
    assert found == {"tasks": 2.0, "knowledge": 1.0, "skills": 0.0, "work_roles": 1.0, "unique_tks": 3.0}
    del nice["skills"]
    assert "unique_tks" not in {r["metric"] for r in framework_metrics(spark, STAGED["nice"], nice).collect()}
    standards = spark.createDataFrame([("K-2", "CS"), ("K-2", None), ("3-5", "CS")], "grade_band string, theme string")
    assert rows(framework_metrics(spark, STAGED["cyberorg-k12"], {"standards": standards})) == [("grade_bands", 2.0), ("standards_total", 3.0), ("themes", 2.0)]
    assert rows(framework_metrics(spark, STAGED["cyberorg-k12"], {"standards": standards.limit(0)})) == [("grade_bands", 0.0), ("standards_total", 0.0), ("themes", 0.0)]
    described = spark.createDataFrame([("d",), (None,)], "description string")
    assert rows(framework_metrics(spark, STAGED["digcomp"], {"competence-descriptions": described})) == [("descriptions_found", 1.0)]
    assert framework_metrics(spark, STAGED["sfia"], {}).count() == 0
    assert sum(len(s.metrics) for s in STAGED.values()) == 30


def test_all_checks_of_a_framework(spark):
    staged = {
        "competence-areas": spark.createDataFrame([("1",), ("1",)], "area_id string"),
        "competences": spark.createDataFrame([("Browsing the web",), (" ",)], "competence_name string"),
    }
    found = staged_checks(spark, "digcomp", staged, dict.fromkeys(verify.REQUIRED_KEYS, "x") | {"retrieval": {}}, {"competence_areas": (2, 2), "descriptions_found": (1, 9)})
    got = {(r["check"], r["message"].split(":")[0] if r["check"] == "counts" else ""): r["severity"] for r in found.collect()}
    assert got[("provenance.keys", "")] == "pass" and got[("counts", "competence_areas")] == "pass" and got[("counts", "descriptions_found")] == "soft"
    assert got[("text.empty.competences.competence_name", "")] == "hard" and got[("text.replaced.competences.competence_name", "")] == "pass"
    assert got[("id.unique.competence-areas.area_id", "")] == "hard" and got[("id.present.competences.competence_id", "")] == "hard"
    assert {r["severity"] for r in staged_checks(spark, "csta", {}, None, None).collect()} == {"hard"}


def test_report(spark):
    full = {
        "framework": "F one", "framework_version": 2, "version_date": "2020-01-02", "source": {"authority": "Office", "filename": "f.pdf", "source_url": "u"}, "retrieval": {"retrieved_date": "d", "pdf_sha256": "ab"},
        "extraction": {"work_roles": 1234, "by_type": {"task": 2000, "note": "x"}, "ok": True}, "licensing": {"source_license": "CC", "terms": ["a"]},
    }
    assert tables.scales(full) == {"work roles": "1,234", "by type": "task=2,000, x"}
    assert tables.summary_rows({"f": full, "g": None}) == [("f", "F one", "2", "2020-01-02", "Office", "work roles: 1,234", "CC"), ("g", None, None, None, None, "", "see provenance")]
    report = tables.ingestion_report(spark, {"f": full, "g": None}, {"f": spark.createDataFrame([("tasks", 3)], "metric string, n int")})
    for line in ("Frameworks staged: 2", "## F one (f)", "- File: f.pdf", "- SHA256: ab", "- by type: task=2,000, x", "- source license: CC", "| tasks | 3 |", "## g (g)", "no manifest"):
        assert line in report.split("\n"), line
    assert "- terms" not in report and "- ok" not in report
