"""What is measured and checked in each framework's staged tables. A framework is data: its metrics, texts and ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verify

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Measure:
    """An aggregate of one table, or its sum over several."""

    tables: tuple[str, ...]
    aggregate: Callable[[], Column]


def _rows(*tables: str) -> Measure:
    return Measure(tables, lambda: F.count("*"))


def _kinds(table: str, column: str) -> Measure:
    return Measure((table,), lambda: verify.distinct(column))


def _filled(table: str, column: str) -> Measure:
    return Measure((table,), lambda: F.count(column))


@dataclass(frozen=True)
class Staged:
    """texts and ids: (table, column) of texts to check and of ids that must be there and unique."""

    metrics: dict[str, Measure]
    texts: tuple[tuple[str, str], ...]
    ids: tuple[tuple[str, str], ...]


#: Metric, table and column names as the frameworks' manifests and staged tables have them.
STAGED = {
    "sfia": Staged(
        {"skills": _rows("skill"), "skill_levels": _rows("skill-level"), "skills_profiles": _rows("skills-profile"), "levels": _rows("level")},
        (("skill", "description"), ("skill-level", "description")),
        (("skill", "code"),),
    ),
    "dcwf": Staged({"work_roles": _rows("dcwf-roles"), "master_task_ksa": _rows("master-task-ksa")}, (("dcwf-roles", "work_role_definition"),), (("dcwf-roles", "dcwf_code"),)),
    "ecsf": Staged(
        {"role_profiles": _rows("profiles"), "profile_elements": _rows("profile-elements-long"), "ecf_cross_references": _rows("ecf-cross-references")},
        (("profile-elements-long", "element_text"), ("profiles", "mission")),
        (("profiles", "profile_id"),),
    ),
    "nice": Staged(
        {
            "work_roles": _rows("work-roles"), "tasks": _rows("tasks"), "knowledge": _rows("knowledge"), "skills": _rows("skills"), "categories": _rows("categories"),
            "competency_areas": _rows("competency-areas"), "role_tks_associations": _rows("role-tks-associations"), "unique_tks": _rows("tasks", "knowledge", "skills"),
        },
        (("tasks", "text"), ("knowledge", "text"), ("skills", "text"), ("work-roles", "text")),
        (("work-roles", "element_id"), ("tasks", "element_id"), ("knowledge", "element_id"), ("skills", "element_id")),
    ),
    "cyberorg-k12": Staged(
        {"grade_bands": _kinds("standards", "grade_band"), "themes": _kinds("standards", "theme"), "sub_concepts": _rows("sub-concepts"), "standards_total": _rows("standards")},
        (("standards", "statement_text"),),
        (("standards", "standard_id"),),
    ),
    "csta": Staged(
        {"standards_count": _rows("standards"), "levels_count": _rows("levels"), "clusters_count": _rows("clusters"), "concepts": _kinds("standards", "concept")},
        (("standards", "standard"),),
        (("standards", "identifier"),),
    ),
    "csec2017": Staged({"knowledge_areas": _rows("knowledge-areas"), "essentials_total": _rows("essentials")}, (("essentials", "element_text"),), (("knowledge-areas", "ka_id"), ("essentials", "element_id"))),
    "digcomp": Staged(
        {"competence_areas": _rows("competence-areas"), "competences": _rows("competences"), "descriptions_found": _filled("competence-descriptions", "description")},
        (("competences", "competence_name"),),
        (("competence-areas", "area_id"), ("competences", "competence_id")),
    ),
}


def framework_metrics(spark: SparkSession, staged: Staged, tables: Tables) -> DataFrame:
    """(metric, value), one pass a table. A metric isn't measured, and has no row, if one of its tables isn't there."""
    measured = {n: m for n, m in staged.metrics.items() if all(t in tables for t in m.tables)}
    parts = [verify.metrics(tables[t], **{n: m.aggregate() for n, m in measured.items() if t in m.tables}) for t in sorted({t for m in measured.values() for t in m.tables})]
    if not parts:
        return spark.createDataFrame([], "metric string, value double")
    return reduce(DataFrame.unionByName, parts).groupBy("metric").agg(F.sum("value").alias("value"))


def staged_checks(spark: SparkSession, slug: str, tables: Tables, manifest: dict[str, Any] | None, bounds: dict[str, tuple[float, float]] | None, sha256: str | None = None) -> DataFrame:
    """All checks of one framework: manifest, counts within bounds, texts, ids. A table that isn't staged has no texts or
    ids to check, and a text column that isn't there none either; an id column that isn't there is a hard fault."""
    staged = STAGED[slug]
    found = [verify.manifest_checks(spark, slug, manifest, sha256), verify.bound_checks(framework_metrics(spark, staged, tables), slug, bounds)]
    for check, columns in ((verify.text_checks, staged.texts), (verify.id_checks, staged.ids)):
        for table, column in columns:
            if table in tables and (check is verify.id_checks or column in tables[table].columns):
                rows = check(tables[table], slug, column)
                found.append(rows.withColumn("check", F.concat_ws(".", "check", F.lit(table), F.lit(column))))
    return reduce(DataFrame.unionByName, found)
