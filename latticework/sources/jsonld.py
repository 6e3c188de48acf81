"""JSON-LD documents: a prefix map `@context` and an array of nodes `@graph`."""

from __future__ import annotations

import json
import warnings
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FrameworkNotFound, MissingFrameworkWarning
from ..functions.nodes import LINKS, LITERALS
from ..graph import TripleGraph
from ..namespaces import PREFIXES, RDF_TYPE, context, expand
from ..schemas import NODE
from .files import exists, read_text, require, write_text

SLUGS = {"nice": "nice", "sfia": "sfia", "dcwf": "dcwf", "ecsf": "ecsf", "cyberorg-k12": "cyberorg", "csta": "csta", "csec2017": "csec", "digcomp": "digcomp"}
_MANY = [c for c, t in (x.split(" ") for x in NODE.split(", ")) if t.startswith("array") and c != "types"]
_LINE = "`@context` map<string,string>, `@graph` array<string>"


def read_document(spark: SparkSession, path: str) -> dict[str, Any]:
    """The document as it was authored."""
    return json.loads(read_text(spark, require(spark, path)))


def nodes_of(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Nodes (schemas.NODE, ids compact) and the document's prefixes. Values may be scalars, arrays or {"@id": ...}: each node is
    read as JSON text and its keys are picked by path, so no schema has to foresee which."""
    doc = spark.read.option("multiLine", True).schema(_LINE).json(require(spark, path))
    known = next((r[0] for r in doc.select("`@context`").take(1)), None) or {}
    node = doc.select(F.explode("`@graph`").alias("n"))

    def text(key: str):
        return F.get_json_object("n", f"$['{key}']")

    def ids(key: str):
        raw = text(key)
        many = F.from_json(F.when(raw.isNull(), F.lit(None)).when(F.startswith(raw, F.lit("[")), raw).otherwise(F.concat(F.lit("["), F.when(F.startswith(raw, F.lit("{")), raw).otherwise(F.to_json(F.struct(raw.alias("@id")))), F.lit("]"))), "array<string>")
        return F.transform(many, lambda x: F.coalesce(F.get_json_object(x, "$['@id']"), x))

    back = {v: k for k, v in known.items()}
    core = back.get(PREFIXES["core"], "core")

    def key(name: str) -> str:
        prefix, _, tail = name.partition(":")
        return f"{core if prefix == 'core' else prefix}:{tail}"

    columns = {"id": text("@id"), "types": ids("@type")}
    columns |= {c: text(key(p)) for c, p in LITERALS.items()}
    columns |= {c: ids(key(p)) if c in _MANY else F.get(ids(key(p)), F.lit(0)) for c, p in LINKS.items()}
    wanted = [x.split(" ") for x in NODE.split(", ")]
    nodes = node.select(*(columns[c].cast(t).alias(c) for c, t in wanted))
    return nodes.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in _MANY}), known or context()


#: The datatypes that numbers and truth values have as literals.
_NATIVE = {"BIGINT": "integer", "DECIMAL": "double", "DOUBLE": "double", "BOOLEAN": "boolean"}
_XSD = "http://www.w3.org/2001/XMLSchema#"


def triples_of(spark: SparkSession, path: str) -> DataFrame:
    """The triples of documents, each read by its own context.

    Any predicate is read, of one value or several: strings, numbers and truth values, {"@id": ...}, and {"@value": ...} with
    @language or @type. Links may be plain strings. Terms and prefixes that the context lacks are those of this library;
    keys that neither knows are left out, as the format has it, and so is what a node embeds beyond its @id."""
    doc = spark.read.option("multiLine", True).schema("`@context` map<string,string>, `@graph` array<variant>").json(require(spark, path))
    node = doc.select(F.col("`@context`").alias("known"), F.explode("`@graph`").alias("node")).withColumn("id", F.try_variant_get("node", "$['@id']", "string"))
    ours = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))

    def known(name: Column) -> Column:
        told = F.element_at("known", name)
        return F.coalesce(F.get_json_object(told, "$['@id']"), told, F.element_at(ours, name))

    def iri(name: Column) -> Column:
        prefix = F.substring_index(name, ":", 1)
        base, rest = known(prefix), F.substr(name, F.length(prefix) + 2)
        own = F.when(F.startswith(name, F.lit("_:")), F.concat(F.lit("_:"), F.hex(F.xxhash64(F.lit(path))), F.lit("."), rest))
        return F.coalesce(own, F.when(F.contains(name, F.lit(":")), F.when(base.isNotNull() & ~F.startswith(rest, F.lit("//")), F.concat(base, rest)).otherwise(name)).otherwise(known(name)))

    every = node.lateralJoin(spark.tvf.variant_explode(F.col("node").outer())).where("key <> '@id'")
    many = F.when(F.startswith(F.schema_of_variant("value"), F.lit("ARRAY")), F.col("value").cast("array<variant>")).otherwise(F.array("value"))
    one = every.select("known", "id", "key", F.explode(many).alias("v")).withColumn("kind", F.schema_of_variant("v"))

    def inner(name: str) -> Column:
        return F.try_variant_get("v", f"$['{name}']", "string")

    one = one.select("known", "id", "key", "kind", F.try_variant_get("v", "$", "string").alias("plain"), inner("@id").alias("ref"), inner("@value").alias("value"), inner("@type").alias("type"), inner("@language").alias("lang"))
    one = one.withColumn("p", F.when(F.col("key") == "@type", F.lit(RDF_TYPE)).otherwise(iri(F.col("key"))))
    links = [RDF_TYPE, *map(expand, LINKS.values())]
    is_object = F.startswith("kind", F.lit("OBJECT"))
    target = F.when(is_object, F.col("ref")).when(F.col("p").isin(links), F.col("plain"))
    native = F.element_at(F.create_map(*(F.lit(x) for k, v in _NATIVE.items() for x in (k, _XSD + v))), F.regexp_extract("kind", "^[A-Z]+", 0))
    literal = F.when(is_object, F.col("value")).otherwise(F.col("plain"))
    made = one.select(
        iri(F.col("id")).alias("s"), "p", F.when(target.isNotNull(), iri(target)).otherwise(literal).alias("o"), target.isNotNull().alias("is_link"),
        F.when(is_object, iri(F.col("type"))).otherwise(native).alias("o_datatype"), "lang",
    )
    kind = F.when(~F.col("is_link"), "literal").when(F.startswith("o", F.lit("_:")), "bnode").otherwise("iri")
    tag = {"o_datatype": F.when(~F.col("is_link"), F.col("o_datatype")), "o_lang": F.when(~F.col("is_link"), F.col("lang"))}
    return made.select("s", "p", "o", kind.alias("o_kind"), *(c.alias(n) for n, c in tag.items()), F.lit(path).alias("source"))


def read(spark: SparkSession, path: str = "data/processed/jsonld/_combined.jsonld") -> TripleGraph:
    return TripleGraph.of(triples_of(spark, path))


def read_framework(spark: SparkSession, slug: str, folder: str = "data/processed/jsonld") -> TripleGraph:
    path = f"{folder}/{slug}.jsonld"
    if not exists(spark, path):
        raise FrameworkNotFound(slug, path)
    return read(spark, path)


def read_union(spark: SparkSession, slugs: list[str] | None = None, folder: str = "data/processed/jsonld") -> TripleGraph:
    """The union of frameworks' documents; a missing one is warned of and left out."""
    found = []
    for slug in slugs or list(SLUGS):
        if exists(spark, f"{folder}/{slug}.jsonld"):
            found.append(read_framework(spark, slug, folder))
        else:
            warnings.warn(f"no document for framework {slug!r}", MissingFrameworkWarning, stacklevel=2)
    if not found:
        return TripleGraph.of(spark.createDataFrame([], "s string, p string, o string"))
    return found[0].union(*found[1:])


def document(nodes: DataFrame, prefixes: list[str]) -> dict[str, Any]:
    """A document in authoring form: `@context`, then `@graph`. Documents are of one framework, and are built on the driver."""
    def value(c: str, v: Any) -> Any:
        if c in LINKS:
            return [{"@id": x} for x in v] if isinstance(v, list) else {"@id": v}
        return v

    graph = []
    for row in nodes.collect():
        node = {"@id": row["id"], "@type": row["types"]}
        node |= {p: value(c, row[c]) for c, p in (LITERALS | LINKS).items() if c in row.asDict() and row[c] is not None}
        graph.append(node)
    return {"@context": context(*prefixes), "@graph": graph}


def write_document(spark: SparkSession, doc: dict[str, Any], path: str) -> str:
    return write_text(spark, path, json.dumps(doc, indent=2, ensure_ascii=False))


def merged(docs: list[dict[str, Any]]) -> dict[str, Any]:
    """One document of several: prefixes together, nodes one after the other."""
    return {"@context": reduce(lambda a, b: a | b, (d["@context"] for d in docs), {}), "@graph": [n for d in docs for n in d["@graph"]]}
