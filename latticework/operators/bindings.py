"""Bindings: the joined views of a graph that analyses start from.

Left joins keep their multiplicity: a subject with two names gives two rows. A node without partOf, or whose partOf
isn't a framework, is in no binding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import TripleGraph


def _named(g: TripleGraph, predicate: str, key: str, value: str) -> DataFrame:
    return g.pairs(predicate).select(F.col("s").alias(key), F.col("o").alias(value))


def framework_metadata(g: TripleGraph) -> DataFrame:
    """framework, name, jurisdiction, sector, specificity; what is missing is null."""
    found = g.subjects("a", "core:Framework").withColumnRenamed("s", "framework")
    for predicate, column in (("schema:name", "name"), ("core:jurisdiction", "jurisdiction"), ("core:sector", "sector"), ("core:specificity", "specificity")):
        found = found.join(_named(g, predicate, "framework", column), "framework", "left")
    return found


def _members(g: TripleGraph, kind: str, key: str) -> DataFrame:
    """key, framework: nodes of a type with the frameworks that they are part of."""
    nodes = g.subjects("a", kind).withColumnRenamed("s", key)
    frameworks = g.subjects("a", "core:Framework").withColumnRenamed("s", "framework")
    return nodes.join(_named(g, "core:partOf", key, "framework"), key).join(frameworks, "framework", "left_semi").select(key, "framework")


def _units(g: TripleGraph, kind: str, key: str) -> DataFrame:
    name = f"{key}_name"
    found = _members(g, kind, key).join(_named(g, "schema:name", key, name), key, "left")
    return found.join(_named(g, "schema:name", "framework", "framework_name"), "framework", "left").select(key, "framework", name, "framework_name")


def role_bindings(g: TripleGraph) -> DataFrame:
    """role, framework, role_name, framework_name."""
    return _units(g, "core:Role", "role")


def unit_bindings(g: TripleGraph) -> DataFrame:
    """unit, framework, unit_name, framework_name."""
    return _units(g, "core:OrganizingUnit", "unit")


def _elements(g: TripleGraph, kind: str, key: str) -> DataFrame:
    found = _members(g, kind, key).join(_named(g, "schema:name", "framework", "framework_name"), "framework", "left")
    return found.select(key, "framework", "framework_name")


def element_bindings(g: TripleGraph) -> DataFrame:
    """element, framework, framework_name; Subpoints and Examples are elements too."""
    return _elements(g, "core:RoleElement", "element")


def example_bindings(g: TripleGraph) -> DataFrame:
    """example, framework, framework_name."""
    return _elements(g, "core:Example", "example")


def role_element_bindings(g: TripleGraph) -> DataFrame:
    """role, element: every hasElement triple, whatever the subject's type."""
    return _named(g, "core:hasElement", "role", "element")


def strict_elements(g: TripleGraph) -> DataFrame:
    """Element bindings without Examples."""
    return element_bindings(g).join(example_bindings(g).select(F.col("example").alias("element")), "element", "left_anti").select("element", "framework", "framework_name")
