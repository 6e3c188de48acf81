"""N-Triples: read by one anchored pattern a line, written as distinct lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import TripleGraph
from .files import require

_IRI, _BLANK = r"<([^>\x00-\x20]*)>", r"(_:[A-Za-z0-9][\w.-]*)"
_LITERAL = r'"((?:[^"\\]|\\.)*+)"(?:\^\^<([^>\s]*)>|@([A-Za-z0-9-]+))?'
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s+{_IRI}\s+(?:{_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def _unescaped(text: Column) -> Column:
    """String escapes of N-Triples. Backslashes are set aside first, so an escaped one starts no other escape."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'"), ("\\b", "\b"), ("\\f", "\f")):
        out = F.replace(out, F.lit(a), F.lit(b))
    # \uXXXX: the text is cut at the escapes and each is decoded from its hex digits
    code = r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"
    hexes = F.regexp_extract_all(out, F.lit(r"\\[uU]([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4})"), F.lit(1))
    chars = F.transform(hexes, lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32"))
    pieces = F.split(out, code, -1)
    joined = F.array_join(F.zip_with(pieces, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.replace(F.when(F.size(hexes) > 0, joined).otherwise(out), F.lit("\x00"), F.lit("\\"))


def _escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: A line's groups, the literal last: it alone can hold the separator.
_ORDER, _SEP = (1, 2, 3, 4, 5, 7, 8, 6), "\x01"


def parse(lines: DataFrame, source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Triples and the lines that aren't one. lines: (value). Blank labels are prefixed with the source, so files don't share them.

    A line is matched once: the match is replaced by its groups, which are then split. A line that stays as it was is bad."""
    source = F.lit(None).cast("string") if source is None else source
    rows = lines.withColumn("_source", source).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    rows = rows.withColumn("_groups", F.regexp_replace("value", LINE, _SEP + _SEP.join(f"${k}" for k in _ORDER)))
    good = rows.where(F.col("_groups") != F.col("value")).withColumn("_parts", F.split("_groups", _SEP, 1 + len(_ORDER)))

    def part(k: int) -> Column:
        return F.get("_parts", F.lit(1 + _ORDER.index(k)))

    def blank(label: Column) -> Column:
        return F.when(F.col("_source").isNull(), label).otherwise(F.concat(F.lit("_:"), F.hex(F.xxhash64("_source")), F.lit("."), F.substr(label, F.lit(3))))

    kind = F.when(part(4) != "", "iri").when(part(5) != "", "bnode").otherwise("literal")
    triples = good.select(
        F.when(part(1) != "", part(1)).otherwise(blank(part(2))).alias("s"), part(3).alias("p"),
        F.when(kind == "iri", part(4)).when(kind == "bnode", blank(part(5))).when(F.contains(part(6), F.lit("\\")), _unescaped(part(6))).otherwise(part(6)).alias("o"),
        kind.alias("o_kind"), F.nullif(part(7), F.lit("")).alias("o_datatype"), F.nullif(part(8), F.lit("")).alias("o_lang"), F.col("_source").alias("source"),
    )
    return triples, rows.where(F.col("_groups") == F.col("value")).select("value", F.col("_source").alias("source"))


def read(spark: SparkSession, path: str = "data/processed/ntriples/_combined.nt") -> TripleGraph:
    """A graph from N-Triples; lines that don't parse are left out (bad_lines() has them)."""
    return TripleGraph.of(parse(spark.read.text(require(spark, path)), F.col("_metadata.file_path"))[0])


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(require(spark, path)), F.col("_metadata.file_path"))[1]


def lines_of(g: TripleGraph) -> DataFrame:
    """(value): a line a triple, each once."""
    subject = F.when(F.startswith("s", F.lit("_:")), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))
    tag = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).when(F.col("o_kind") == "bnode", F.col("o")).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tag))
    return g.triples.select(F.concat_ws(" ", subject, F.concat(F.lit("<"), F.col("p"), F.lit(">")), obj, F.lit(".")).alias("value")).dropDuplicates(["value"])


def write(g: TripleGraph, path: str) -> None:
    lines_of(g).write.mode("overwrite").text(path)


def combine(spark: SparkSession, paths: dict[str, str], out: str) -> DataFrame:
    """Write the distinct lines of all files. Returns slug, lines; null lines for a file that is missing, and the others go on."""
    from .files import exists

    there = {k: p for k, p in paths.items() if exists(spark, p)}
    if there:
        spark.read.text(list(there.values())).where("trim(value) <> ''").dropDuplicates(["value"]).write.mode("overwrite").text(out)
    return spark.createDataFrame([(k, spark.read.text(p).count() if k in there else None) for k, p in paths.items()], "slug string, lines long")
