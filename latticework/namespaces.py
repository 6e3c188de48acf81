"""Prefix registry: compact names to IRIs and back, on the driver and as column expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import UnknownPrefix

#: The vocabulary shared by all frameworks. Set LATTICEWORK_CORE_IRI to read graphs whose shared vocabulary has another address.
CORE = os.environ.get("LATTICEWORK_CORE_IRI", "https://example.org/framework-graph/ontology#")
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: General vocabularies.
BASE = {
    "schema": "http://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "core": CORE,
}
#: The published frameworks' own vocabularies.
FRAMEWORKS = {
    "nice": "https://nice.nist.gov/framework/terms#",
    "dcwf": "https://public.cyber.mil/wid/dcwf/terms#",
    "ecf": "https://ec.europa.eu/ecf/terms#",
    "sfia": "https://sfia-online.org/en/terms#",
    "ecsf": "https://enisa.europa.eu/ecsf/terms#",
    "cyberorg": "https://cyber.org/standards/terms#",
    "csta": "https://csteachers.org/k12standards/terms#",
    "csec": "https://cybered.acm.org/csec2017/terms#",
    "digcomp": "https://ec.europa.eu/jrc/digcomp/terms#",
}
PREFIXES = BASE | FRAMEWORKS


def context(*prefixes: str) -> dict[str, str]:
    """The base prefixes with those of the named frameworks."""
    unknown = sorted(set(prefixes) - set(FRAMEWORKS))
    if unknown:
        raise UnknownPrefix(f"unknown framework prefixes: {', '.join(unknown)}; known are {', '.join(FRAMEWORKS)}")
    return BASE | {p: FRAMEWORKS[p] for p in prefixes}


def expand(name: str, known: dict[str, str] | None = None) -> str:
    """`a` and prefix:tail to IRIs; full IRIs, in brackets or not, as they are."""
    known = PREFIXES if known is None else known
    if name == "a":
        return RDF_TYPE
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    prefix, colon, tail = name.partition(":")
    if colon and prefix in known:
        return known[prefix] + tail
    if "://" in name or prefix in ("urn", "mailto", "_"):
        return name
    raise UnknownPrefix(f"no prefix in {name!r}" if not colon else f"unknown prefix {prefix!r} in {name!r}")


def expanded(name: Column, known: dict[str, str] | None = None) -> Column:
    """The same for a column, leaving unknown prefixes as they are. Only the first colon parts prefix and tail: tails may have dots and colons."""
    known = PREFIXES if known is None else known
    out = name
    for prefix, iri in known.items():
        out = F.when(F.startswith(name, F.lit(f"{prefix}:")), F.concat(F.lit(iri), F.substr(name, F.lit(len(prefix) + 2)))).otherwise(out)
    return out


def tail(iri: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(iri, "/", -1)
