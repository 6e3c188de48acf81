"""Frameworks' staged tables to nodes. An adapter is data: which tables and columns hold units, elements and links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions.fragments import expand_fragments, extend_ids
from ..functions.text import first_present

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Adapter:
    """units: (unit_id, name[, description]); elements: (element_id, element_text, subtype[, source_section, clarification]);
    links: (unit_id, element_id), or None if the source has none."""

    slug: str
    prefix: str
    framework_id: str
    unit_subtype: str
    is_role: bool
    units: Callable[[Tables], DataFrame]
    elements: Callable[[Tables], DataFrame]
    links: Callable[[Tables], DataFrame] | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    #: Whether the examples come in a column `clarification` and not from the text.
    own_examples: bool = False


def _kind(column: str, known: dict[str, str]) -> Column:
    out = F.lit("RoleElement")
    for value, subtype in known.items():
        out = F.when(F.col(column) == value, subtype).otherwise(out)
    return out


def _first(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key, in the order of the source."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy(key).agg(F.min_by(F.struct(*df.columns), "_at").alias("_row")).select("_row.*")


def _nice_units(t: Tables) -> DataFrame:
    return t["work-roles"].selectExpr("element_id AS unit_id", "title AS name", "text AS description")


def _nice_elements(t: Tables) -> DataFrame:
    rows = t["tasks"].unionByName(t["knowledge"]).unionByName(t["skills"]).select("element_id", F.col("text").alias("element_text"), "element_type")
    return _first(rows, "element_id").withColumn("subtype", _kind("element_type", {"task": "TaskStatement", "knowledge": "KnowledgeStatement", "skill": "SkillStatement"})).drop("element_type")


def _sfia_elements(t: Tables) -> DataFrame:
    return t["skill-level"].select(F.concat_ws("-", "code", F.col("level").cast("string")).alias("element_id"), F.col("description").alias("element_text"), F.lit("SkillLevel").alias("subtype"))


def _dcwf_elements(t: Tables) -> DataFrame:
    df = t["master-task-ksa"]
    number, statement = first_present(df, "dcwf_number", "dcwf_num"), first_present(df, "task_ksa", "task_or_ksa", "text", "statement")
    return _first(df.select(F.col(number).alias("element_id"), F.col(statement).alias("element_text"), F.lit("TaskOrKSA").alias("subtype")), "element_id")


def _ecsf_elements(t: Tables) -> DataFrame:
    known = {"task": "Task", "skill": "Skill", "knowledge": "Knowledge", "deliverable": "Deliverable"}
    return t["profile-elements-long"].select(_ecsf_id().alias("element_id"), "element_text", _kind("element_type", known).alias("subtype"))


def _ecsf_id() -> Column:
    return F.concat_ws("-", "profile_id", "element_type", F.col("element_index").cast("string"))


def _grouped(t: Tables) -> DataFrame:
    return t["standards"].withColumn("unit_id", F.concat_ws("-", "grade_band", "theme", "sub_concept"))


def _cyberorg_units(t: Tables) -> DataFrame:
    named = t["sub-concepts"].select("theme", "sub_concept", "sub_concept_name")
    groups = _grouped(t).select("unit_id", "grade_band", "theme", "sub_concept").distinct()
    return groups.join(named, ["theme", "sub_concept"], "left").select("unit_id", F.concat_ws(" ", "grade_band", F.coalesce("sub_concept_name", "sub_concept")).alias("name"))


def _csta_group() -> Column:
    return F.concat_ws("-", "level", F.regexp_replace("concept", "[^A-Za-z0-9]+", "-"))


def _csta_elements(t: Tables) -> DataFrame:
    return t["standards"].select(F.col("identifier").alias("element_id"), F.col("standard").alias("element_text"), F.lit("Standard").alias("subtype"), "clarification")


def _digcomp_elements(t: Tables) -> DataFrame:
    text = F.when(F.length(F.trim("description")) > 0, F.col("description")).otherwise(F.col("competence_name"))
    return t["competence-descriptions"].select("element_id", text.alias("element_text"), F.lit("Competence").alias("subtype"))


ADAPTERS = {
    a.slug: a
    for a in (
        Adapter("nice", "nice", "nice-v2", "WorkRole", True, _nice_units, _nice_elements, lambda t: t["role-tks-associations"].selectExpr("work_role_id AS unit_id", "statement_id AS element_id")),
        Adapter("sfia", "sfia", "sfia-9", "Skill", False, lambda t: t["skill"].selectExpr("code AS unit_id", "name", "description"), _sfia_elements, lambda t: t["skill-level"].select(F.col("code").alias("unit_id"), F.concat_ws("-", "code", F.col("level").cast("string")).alias("element_id"))),
        Adapter("dcwf", "dcwf", "dcwf-v5.1", "WorkRole", True, lambda t: _first(t["dcwf-roles"].selectExpr("dcwf_code AS unit_id", "work_role AS name", "work_role_definition AS description"), "unit_id"), _dcwf_elements),
        Adapter("ecsf", "ecsf", "ecsf-v1", "RoleProfile", True, lambda t: t["profiles"].selectExpr("profile_id AS unit_id", "title AS name", "summary_statement AS description"), _ecsf_elements, lambda t: t["profile-elements-long"].select(F.col("profile_id").alias("unit_id"), _ecsf_id().alias("element_id"))),
        Adapter("cyberorg-k12", "cyberorg", "cyberorg-k12-v1.0", "StandardGroup", False, _cyberorg_units, lambda t: t["standards"].select(F.col("standard_id").alias("element_id"), F.col("statement_text").alias("element_text"), F.lit("Standard").alias("subtype")), lambda t: _grouped(t).selectExpr("unit_id", "standard_id AS element_id")),
        Adapter("csta", "csta", "csta-2017", "StandardGroup", False, lambda t: t["standards"].select(_csta_group().alias("unit_id"), F.concat_ws(" ", "level", "concept").alias("name")).distinct(), _csta_elements, lambda t: t["standards"].select(_csta_group().alias("unit_id"), F.col("identifier").alias("element_id")), own_examples=True),
        Adapter("csec2017", "csec", "csec2017-v1", "KnowledgeArea", False, lambda t: t["knowledge-areas"].selectExpr("ka_id AS unit_id", "name"), lambda t: t["essentials"].select("element_id", "element_text", F.lit("Essential").alias("subtype")), lambda t: t["essentials"].selectExpr("ka_id AS unit_id", "element_id")),
        Adapter("digcomp", "digcomp", "digcomp-2.2", "CompetenceArea", False, lambda t: t["competence-areas"].selectExpr("area_id AS unit_id", "area_name AS name"), _digcomp_elements, lambda t: t["competence-descriptions"].selectExpr("area_id AS unit_id", "element_id")),
    )
}


def assemble(adapter: Adapter, tables: Tables, metadata: dict[str, str]) -> DataFrame:
    """All nodes of a framework: itself, its units with their links, its elements with what their texts enumerate.

    metadata: name, jurisdiction, sector, specificity, version, publisher and, optionally, license, date_published."""
    a, elements = adapter, adapter.elements(tables)
    spark = elements.sparkSession
    row = {"framework_id": a.framework_id} | a.metadata | metadata
    framework = N.framework_nodes(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)), a.prefix)
    made = N.element_nodes(elements.withColumn("framework_id", F.lit(a.framework_id)), a.prefix, F.col("subtype"))
    made, index = expand_fragments(made, a.prefix, a.framework_id, a.slug)
    if a.own_examples:
        noted = elements.where(F.length(F.trim("clarification")) > 0)
        noted = noted.select(F.concat(F.lit(f"{a.prefix}:"), "element_id").alias("parent_id"), F.lit(1).alias("ordinal"), F.col("clarification").alias("text"))
        links = noted.select(F.col("parent_id").alias("id"), F.concat_ws(".", "parent_id", F.lit("example"), F.lit("1")).alias("_link"))
        none = F.array().cast("array<string>")
        linked = F.when(F.col("_link").isNotNull(), F.array_distinct(F.concat(F.coalesce("has_example", none), F.array("_link")))).otherwise(F.col("has_example"))
        made = made.join(links, "id", "left").withColumn("has_example", linked).select(*made.columns).unionByName(N.example_nodes(noted, a.framework_id))
    units = adapter.units(tables).withColumn("framework_id", F.lit(a.framework_id))
    if a.links is not None:
        linked = a.links(tables).select("unit_id", F.concat(F.lit(f"{a.prefix}:"), "element_id").alias("e")).distinct()
        units = units.join(linked.groupBy("unit_id").agg(F.array_sort(F.collect_list("e")).alias("has_element")), "unit_id", "left")
        units = extend_ids(units, "has_element", index)
    return framework.unionByName(N.unit_nodes(units, a.prefix, a.unit_subtype, a.is_role)).unionByName(made)
