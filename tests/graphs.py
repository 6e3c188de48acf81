"""Small graphs whose counts are known by hand."""

from latticework.graph import TripleGraph
from latticework.plans.demo import demo  # noqa: F401  tests import it from here


def _typed(rows, node, *types):
    rows += [(node, "a", f"core:{t}", "iri") for t in types]


def fixture(spark):
    """Two frameworks, units with and without a framework, elements, five Subpoints, one Example, one repeated triple."""
    r = []
    for f, name, j, s, k in (("A", "Framework A", "US", "civilian", "cybersecurity-specific"), ("B", "Framework B", "EU", "general", "general-IT")):
        _typed(r, f"core:{f}", "Framework")
        r += [(f"core:{f}", "schema:name", name, "literal"), (f"core:{f}", "core:jurisdiction", j, "literal"), (f"core:{f}", "core:sector", s, "literal"), (f"core:{f}", "core:specificity", k, "literal")]
    for u, f in (("ua1", "A"), ("ua2", "A"), ("ub1", "B"), ("lost", None), ("wrong", "nowhere")):
        _typed(r, f"core:{u}", "Role", "OrganizingUnit")
        r.append((f"core:{u}", "schema:name", f"Unit {u}", "literal"))
        r += [(f"core:{u}", "core:partOf", f"core:{f}", "iri")] if f else []
    for e, f in (("a1", "A"), ("a2", "A"), ("a3", "A"), ("b1", "B"), ("b2", "B"), ("orphan", None)):
        _typed(r, f"core:{e}", "RoleElement")
        r += [(f"core:{e}", "core:partOf", f"core:{f}", "iri")] if f else []
    r += [(f"core:{u}", "core:hasElement", f"core:{e}", "iri") for u, e in (("ua1", "a1"), ("ua1", "a2"), ("ua2", "a3"), ("ub1", "b1"), ("ub1", "b2"))]
    for parent, unit, f, n in (("a1", "ua1", "A", 2), ("b1", "ub1", "B", 3)):
        for k in range(1, n + 1):
            s = f"core:{parent}.sub.{k}"
            _typed(r, s, "Subpoint", "RoleElement")
            r += [(s, "core:elaborates", f"core:{parent}", "iri"), (s, "core:partOf", f"core:{f}", "iri"), (f"core:{unit}", "core:hasElement", s, "iri")]
    r.append(("core:ua1", "core:partOf", "core:A", "iri"))
    _typed(r, "core:a2.example.1", "Example", "RoleElement")
    r += [("core:a2.example.1", "core:partOf", "core:A", "iri"), ("core:a2", "core:hasExample", "core:a2.example.1", "iri")]
    return TripleGraph.from_rows(spark, r)
