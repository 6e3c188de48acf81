"""The prose-fragment parser: enumerations in a text become child nodes, by column expressions alone.

A text with a clarification header gives Examples, any other gives Subpoints. The list is what follows the last
introducer up to the end of its sentence, or, without an introducer, a body with two semicolons or more. Items are
trimmed, cut at an inner sentence end, and dropped if short, a bare connective, or broken over lines. Fewer than two
items are none. Ordinals count what is left.

`e.g.` counts as an introducer only if a word follows the dot directly: its closing word boundary needs one.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..namespaces import FRAMEWORKS

#: Slugs whose texts aren't parsed, comma-separated; read when a plan is built.
OPT_OUT = "LATTICEWORK_DISABLE_SUBPOINTS"
HEADER = "(?i)clarification statement:"
#: What introduces a list, and words that are no item by themselves.
INTRODUCER = r"(?i)\b(?:such as|examples? of|examples? include|e\.g\.|including|for example)\b"
NO_ITEM = ["and", "or", "the", "but", "however", "etc", "etc.", "etcetera"]
_SENTENCE_END = r"(?s)\.\s+[A-Z].*\z"
_BLANK = "^[ \\t\\r\\n]+|[ \\t\\r\\n]+\\z"
FRAGMENTS = "array<struct<ordinal:int,text:string,node_type:string>>"


def opted_out(slug: str | None) -> bool:
    return slug is not None and slug in [s.strip() for s in os.environ.get(OPT_OUT, "").split(",")]


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, _BLANK, "")


def _items(raw: Column) -> Column:
    cut = F.transform(raw, lambda x: _trim(F.regexp_replace(_trim(x), _SENTENCE_END, "")))
    return F.filter(cut, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(NO_ITEM) & ~x.rlike(r"(?s)\n.*[A-Z]"))


def with_fragments(df: DataFrame, text: str, out: str = "fragments", slug: str | None = None) -> DataFrame:
    """Adds an array of (ordinal, text, node_type); null and empty texts have none. Steps are columns, so none is computed twice."""
    none = F.array().cast(FRAGMENTS)
    if opted_out(slug):
        return df.withColumn(out, none)
    keep = df.columns
    df = df.withColumn("_body", F.regexp_replace(F.col(text), r"(?id)\A.*?clarification statement:\s*", ""))
    df = df.withColumn("_parts", F.split("_body", INTRODUCER, -1))
    tail = F.regexp_replace(F.element_at("_parts", -1), r"\.\s*\z", "")
    df = df.withColumn("_segment", F.regexp_replace(tail, r"(?s)(\.\s+[A-Z].*|\n.*)\z", ""))
    semicolons = F.length("_body") - F.length(F.replace("_body", F.lit(";"), F.lit("")))
    raw = (
        F.when((F.size("_parts") <= 1) & (semicolons >= 2), F.split("_body", r"\s*;\s*", -1))
        .when(F.size("_parts") <= 1, F.array().cast("array<string>"))
        .when(F.contains("_segment", F.lit(";")), F.split("_segment", r"\s*;\s*(?:and\s+|or\s+)?", -1))
        .otherwise(F.split(F.regexp_replace("_segment", r"\s+(?:and|or)\s+", ", "), r"\s*,\s*", -1))
    )
    df = df.withColumn("_items", _items(raw)).withColumn("_kind", F.when(F.col(text).rlike(HEADER), "Example").otherwise("Subpoint"))
    numbered = F.transform("_items", lambda x, i: F.struct((i + 1).cast("int").alias("ordinal"), x.alias("text"), F.col("_kind").alias("node_type")))
    df = df.withColumn(out, F.when(F.size("_items") >= 2, numbered).otherwise(none))
    return df.select(*(c for c in keep if c != out), out)


def subtype_of(types: Column, prefix: str) -> Column:
    """The first type under a prefix, without it; RoleElement if there is none."""
    if prefix not in FRAMEWORKS:
        raise ValueError(f"not a framework prefix: {prefix!r}")
    own = F.filter(types, lambda t: F.startswith(t, F.lit(f"{prefix}:")))
    return F.coalesce(F.substr(F.get(own, F.lit(0)), F.lit(len(prefix) + 2)), F.lit("RoleElement"))


def expand_fragments(nodes: DataFrame, prefix: str, framework_id: str, slug: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes: element nodes (schemas.NODE). Returns all nodes, parents with hasExample links to their Examples, and the index
    (parent_id, subnode_id, ordinal, node_type). Children are exploded once; no row is visited on the driver."""
    parsed = with_fragments(nodes, "element_text", "_fragments", slug)
    child = parsed.select(F.col("id").alias("parent_id"), "types", "source_section", F.inline("_fragments"))
    kind = F.when(F.col("node_type") == "Example", "example").otherwise("sub")
    child = child.withColumn("subnode_id", F.concat_ws(".", "parent_id", kind, F.col("ordinal").cast("string")))
    example = F.col("node_type") == "Example"
    types = F.when(example, F.array(F.lit("core:Example"), F.lit("core:RoleElement"))).otherwise(F.array(F.concat(F.lit(f"{prefix}:"), subtype_of(F.col("types"), prefix)), F.lit("core:Subpoint"), F.lit("core:RoleElement")))
    made = {"id": F.col("subnode_id"), "types": types, "element_text": F.col("text"), "part_of": F.lit(f"core:framework/{framework_id}"), "elaborates": F.when(~example, F.col("parent_id"))}
    children = child.select(*((made.get(c) if c in made else F.lit(None).cast(t)).alias(c) for c, t in nodes.dtypes))
    links = F.transform(F.filter("_fragments", lambda f: f["node_type"] == "Example"), lambda f: F.concat_ws(".", F.col("id"), F.lit("example"), f["ordinal"].cast("string")))
    parents = parsed.withColumn("has_example", F.when(F.size(links) > 0, F.array_distinct(F.concat(F.coalesce("has_example", F.array().cast("array<string>")), links))).otherwise(F.col("has_example")))
    index = child.select("parent_id", "subnode_id", "ordinal", "node_type")
    return parents.select(*nodes.columns).unionByName(children), index


def extend_ids(units: DataFrame, ids: str, index: DataFrame) -> DataFrame:
    """Adds to each unit's array of element ids the Subpoints of its elements; Examples stay out; repeated ids collapse, in order."""
    points = index.where("node_type = 'Subpoint'").select(F.col("parent_id").alias("_e"), "subnode_id", "ordinal")
    key = [c for c in units.columns if c != ids]
    listed = units.select(*key, F.posexplode_outer(ids).alias("_at", "_e")).join(points, "_e", "left")
    # null keys are a unit like any other: grouping on all columns together needs no null-safe join
    found = listed.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_at", F.lit(0).alias("k"), F.lit(0).alias("ordinal"), F.col("_e").alias("id"))))).alias("_own"), F.sort_array(F.collect_list(F.when(F.col("subnode_id").isNotNull(), F.struct("_at", F.lit(1).alias("k"), "ordinal", F.col("subnode_id").alias("id"))))).alias("_subs"))
    both = F.array_distinct(F.transform(F.concat("_own", "_subs"), lambda x: x["id"]))
    return found.withColumn(ids, both).select(*units.columns)
