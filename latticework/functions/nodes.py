"""Node constructors as DataFrame transforms, their check, and the melt to triples.

Each takes a table with the columns it names (others are ignored) and gives rows of schemas.NODE. A null leaves a key out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import TripleGraph
from ..namespaces import PREFIXES, RDF_TYPE, expand, expanded
from ..schemas import NODE

_COLUMNS = [tuple(c.split(" ")) for c in NODE.split(", ")]
LITERALS = {
    "name": "schema:name", "description": "schema:description", "element_text": "core:elementText", "source_section": "core:sourceSection",
    "jurisdiction": "core:jurisdiction", "sector": "core:sector", "specificity": "core:specificity", "version": "schema:version",
    "publisher": "schema:publisher", "license": "schema:license", "date_published": "schema:datePublished",
}
LINKS = {"part_of": "core:partOf", "elaborates": "core:elaborates", "has_element": "core:hasElement", "has_example": "core:hasExample"}


def _nodes(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    return df.select(*((made[c] if c in made else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS))


def _own(df: DataFrame, *names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names if n in df.columns}


def _types(prefix: str, subtype: Column | str, *core: str) -> Column:
    own = F.lit(subtype) if isinstance(subtype, str) else subtype
    return F.array(F.concat(F.lit(f"{prefix}:"), own), *(F.lit(f"core:{c}") for c in core))


def framework_nodes(df: DataFrame, prefix: str) -> DataFrame:
    """framework_id, name, jurisdiction, sector, specificity, version, publisher and, optionally, license, date_published."""
    made = _own(df, "name", "jurisdiction", "sector", "specificity", "version", "publisher", "license", "date_published", "description")
    return _nodes(df, made | {"id": F.concat(F.lit("core:framework/"), F.col("framework_id")), "types": _types(prefix, "Framework", "Framework")})


def unit_nodes(df: DataFrame, prefix: str, subtype: str, is_role: bool = False) -> DataFrame:
    """unit_id, name and, optionally, description, framework_id, has_element (array of node ids). Supertypes are asserted: nothing infers them."""
    core = ("Role", "OrganizingUnit") if is_role else ("OrganizingUnit",)
    made = _own(df, "name", "description", "has_element") | {"id": F.concat(F.lit(f"{prefix}:"), F.col("unit_id")), "types": _types(prefix, subtype, *core)}
    if "framework_id" in df.columns:
        made["part_of"] = F.concat(F.lit("core:framework/"), F.col("framework_id"))
    if "has_element" in made:
        made["has_element"] = F.when(F.size("has_element") > 0, F.col("has_element"))
    return _nodes(df, made)


def role_nodes(df: DataFrame, prefix: str, subtype: str = "WorkRole") -> DataFrame:
    """unit_nodes() for units that are roles."""
    return unit_nodes(df, prefix, subtype, is_role=True)


def element_nodes(df: DataFrame, prefix: str, subtype: Column | str = "RoleElement") -> DataFrame:
    """element_id, element_text and, optionally, source_section, framework_id."""
    made = _own(df, "element_text", "source_section") | {"id": F.concat(F.lit(f"{prefix}:"), F.col("element_id")), "types": _types(prefix, subtype, "RoleElement")}
    if "framework_id" in df.columns:
        made["part_of"] = F.concat(F.lit("core:framework/"), F.col("framework_id"))
    return _nodes(df, made)


def subpoint_nodes(df: DataFrame, prefix: str, framework_id: str, subtype: Column | str = "RoleElement") -> DataFrame:
    """parent_id (a node id), ordinal, text."""
    made = {"id": F.concat_ws(".sub.", "parent_id", F.col("ordinal").cast("string")), "types": _types(prefix, subtype, "Subpoint", "RoleElement"), "element_text": F.col("text"), "part_of": F.lit(f"core:framework/{framework_id}"), "elaborates": F.col("parent_id")}
    return _nodes(df, made)


def example_nodes(df: DataFrame, framework_id: str) -> DataFrame:
    """parent_id (a node id), ordinal, text. The link goes from the parent to the Example."""
    made = {"id": F.concat_ws(".example.", "parent_id", F.col("ordinal").cast("string")), "types": F.array(F.lit("core:Example"), F.lit("core:RoleElement")), "element_text": F.col("text"), "part_of": F.lit(f"core:framework/{framework_id}")}
    return _nodes(df, made)


def validated(nodes: DataFrame) -> DataFrame:
    """Adds valid and missing_fields: nodes need an id and a type."""
    missing = F.array_compact(F.array(F.when(F.col("id").isNull() | (F.col("id") == ""), "@id"), F.when(F.col("types").isNull() | (F.size("types") == 0), "@type")))
    return nodes.withColumn("missing_fields", missing).withColumn("valid", F.size("missing_fields") == 0)


def to_triples(nodes: DataFrame, known: dict[str, str] | None = None, source: str | None = None, unique: bool = False) -> TripleGraph:
    """Nodes melted to triples in one pass; null keys give none, compact names become IRIs. If each id occurs once (unique), the
    triples are a set as they come, and no shuffle has to make them one."""
    known = PREFIXES if known is None else known

    def entry(p: str, o: Column, kind: str) -> Column:
        return F.struct(F.lit(expand(p) if p != RDF_TYPE else p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    def entries(p: str, os: Column) -> Column:
        return F.transform(F.array_distinct(F.array_compact(F.coalesce(os, F.array().cast("array<string>")))), lambda o: entry(p, expanded(o, known), "iri"))

    kinds = dict(nodes.dtypes)
    parts = [entries(RDF_TYPE, F.col("types"))]
    parts += [F.array(entry(p, F.col(c), "literal")) for c, p in LITERALS.items() if c in kinds]
    parts += [entries(p, F.col(c) if kinds[c].startswith("array") else F.array(c)) for c, p in LINKS.items() if c in kinds]
    melted = nodes.select(expanded(F.col("id"), known).alias("s"), F.inline(F.concat(*parts)))
    melted = melted.withColumn("source", F.lit(source))
    if not unique:
        return TripleGraph.of(melted)
    tags = [F.lit(None).cast("string").alias(c) for c in ("o_datatype", "o_lang")]
    return TripleGraph(melted.where("s IS NOT NULL AND o IS NOT NULL").select("s", "p", "o", "o_kind", *tags, "source"))
