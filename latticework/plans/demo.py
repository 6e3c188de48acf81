"""A small graph in memory, to try patterns, bindings and analyses on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import TripleGraph


def _typed(rows: list[tuple[str, str, str, str]], node: str, *types: str) -> None:
    rows += [(node, "a", f"core:{t}", "iri") for t in types]


def demo(spark: SparkSession) -> TripleGraph:
    """A workforce framework with two roles and one without roles: 2 frameworks, 3 units, 2 roles, 7 elements, 1 Example, 6 hasElement."""
    r = []
    for f in ("A", "B"):
        _typed(r, f"core:{f}", "Framework")
        r.append((f"core:{f}", "schema:name", f"Framework {f}", "literal"))
    for u, f, role in (("u1", "A", True), ("u2", "A", True), ("u3", "B", False)):
        _typed(r, f"core:{u}", "OrganizingUnit", *(["Role"] if role else []))
        r += [(f"core:{u}", "schema:name", u, "literal"), (f"core:{u}", "core:partOf", f"core:{f}", "iri")]
    for e, u, f in (("e1", "u1", "A"), ("e2", "u1", "A"), ("e3", "u2", "A"), ("e4", "u3", "B"), ("e5", "u3", "B"), ("e1.sub.1", "u1", "A")):
        _typed(r, f"core:{e}", "RoleElement")
        r += [(f"core:{e}", "core:partOf", f"core:{f}", "iri"), (f"core:{u}", "core:hasElement", f"core:{e}", "iri"), (f"core:{e}", "core:elementText", f"text of {e}", "literal")]
    _typed(r, "core:e1.sub.1", "Subpoint")
    r.append(("core:e1.sub.1", "core:elaborates", "core:e1", "iri"))
    _typed(r, "core:e4.example.1", "Example", "RoleElement")
    r += [("core:e4.example.1", "core:partOf", "core:B", "iri"), ("core:e4", "core:hasExample", "core:e4.example.1", "iri")]
    return TripleGraph.from_rows(spark, r)
