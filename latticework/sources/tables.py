"""Staged tables, manifests, line-numbered text, and reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import exists, read_text, require, write_text


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a given schema: ids such as 1.1 or 411 stay strings. Empty cells and NA are null."""
    options = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "nullValue": "NA", "emptyValue": ""}
    df = spark.read.options(**options).schema(schema).csv(require(spark, path))
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c, t in df.dtypes if t == "string"})


def read_csv_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return read_csv(spark, path, schema) if exists(spark, path) else None


def framework_table(spark: SparkSession, root: str, slug: str, table: str, schema: str) -> DataFrame:
    return read_csv(spark, f"{root}/{slug}/tables/{table}.csv", schema)


def write_csv(df: DataFrame, path: str) -> None:
    """One file: for results of report size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A YAML manifest, or None if there is none or it doesn't parse."""
    import yaml

    if not exists(spark, path):
        return None
    try:
        found = yaml.safe_load(read_text(spark, path))
    except yaml.YAMLError:
        return None
    return found if isinstance(found, dict) else None


def write_manifest(spark: SparkSession, path: str, manifest: dict[str, Any]) -> str:
    import yaml

    return write_text(spark, path, yaml.safe_dump(manifest, sort_keys=False, allow_unicode=True))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text. Files are read whole, as only then a line's number is sure."""
    whole = spark.read.text(require(spark, path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return numbered(whole, "file", "value")


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, text of a column's lines; null texts have none."""
    lines = df.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("line", "text"))
    return lines.withColumn("line", F.col("line") + 1)


def blocks(lines: DataFrame, key: str, starts_at: str) -> DataFrame:
    """Lines that match a pattern open a block: key, line, text, next_line (that of the next block, or one past the end)."""
    last = lines.groupBy(key).agg(F.max("line").alias("last"))
    heads = lines.where(F.col("text").rlike(starts_at))
    heads = heads.withColumn("next_line", F.lead("line").over(Window.partitionBy(key).orderBy("line")))
    return heads.join(last, key).withColumn("next_line", F.coalesce("next_line", F.col("last") + 1)).drop("last")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Role profiles: a JSON array of objects with text, list and [code, name, level] fields."""
    schema = (
        "title string, alternative_titles array<string>, summary_statement string, mission string, main_tasks array<string>, "
        "key_skills array<string>, key_knowledge array<string>, deliverables array<string>, ecompetences array<array<string>>"
    )
    return spark.read.option("multiLine", True).schema(schema).json(require(spark, path))


def elements_and_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON object of `elements` and `relationships`, possibly inside `response.elements`."""
    element = "array<struct<element_identifier:string,element_type:string,title:string,text:string,doc_identifier:string>>"
    relation = "array<struct<source_element_identifier:string,dest_element_identifier:string,relationship_identifier:string>>"
    inner = f"struct<elements:{element},relationships:{relation}>"
    doc = spark.read.option("multiLine", True).schema(f"elements {element}, relationships {relation}, response struct<elements:{inner}>").json(require(spark, path))
    pick = {n: F.coalesce(n, f"response.elements.{n}") for n in ("elements", "relationships")}
    return doc.select(F.inline(pick["elements"])), doc.select(F.inline(pick["relationships"]))


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table of `limit` rows at most, as a report is read by people; it says how many more there are."""
    rows = df.limit(limit + 1).collect()
    more = df.count() - limit if len(rows) > limit else 0
    rows = rows[:limit]
    cells = [[("" if v is None else f"{v:,}" if isinstance(v, int) else str(v)) for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *cells]) + (f"\n\n{more:,} more rows" if more else "")


def _told(manifest: dict[str, Any] | None, *paths: str) -> str | None:
    """The first of some dotted paths that a manifest has."""
    for path in paths:
        value: Any = manifest
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if value is not None:
            return str(value)
    return None


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def scales(manifest: dict[str, Any] | None) -> dict[str, str]:
    """What a manifest's extraction counts, by readable name: numbers, and breakdowns as name=number (what is no number there stands without its name)."""
    found = {}
    for name, value in ((manifest or {}).get("extraction") or {}).items():
        if _number(value):
            found[name.replace("_", " ")] = f"{value:,}"
        elif isinstance(value, dict):
            found[name.replace("_", " ")] = ", ".join(f"{k}={v:,}" if _number(v) else str(v) for k, v in value.items())
    return found


def summary_rows(manifests: dict[str, dict[str, Any] | None]) -> list[tuple[str | None, ...]]:
    """framework_slug, framework, version, version_date, publisher, scales (numbers only), license of each manifest."""
    return [
        (
            slug, _told(m, "framework"), _told(m, "framework_version"), _told(m, "framework_date", "version_date"), _told(m, "source.publisher", "source.authority"),
            " · ".join(f"{k}: {v}" for k, v in scales({"extraction": {k: v for k, v in ((m or {}).get("extraction") or {}).items() if _number(v)}}).items()),
            _told(m, "licensing.source_license", "licensing.sfia_text_license", "licensing.license") or "see provenance",
        )
        for slug, m in sorted(manifests.items())
    ]


SUMMARY = "framework_slug string, framework string, version string, version_date string, publisher string, scales string, license string"


def ingestion_report(spark: SparkSession, manifests: dict[str, dict[str, Any] | None], counts: dict[str, DataFrame]) -> str:
    """A comparison table and a section for each framework (source, retrieval, scales, licensing, counts), as Markdown."""
    out = ["# Ingestion summary", "", f"Frameworks staged: {len(manifests)}", "", markdown_table(spark.createDataFrame(summary_rows(manifests), SUMMARY).orderBy("framework_slug")), ""]
    for slug, m in sorted(manifests.items()):
        out += [f"## {_told(m, 'framework') or slug} ({slug})", ""] + (["no manifest", ""] if m is None else [])
        licensing = (m or {}).get("licensing")
        sections = {
            "Framework": {"Publisher": _told(m, "source.publisher", "source.authority"), "Version": _told(m, "framework_version"), "Version date": _told(m, "framework_date", "version_date")},
            "Source": {
                "Type": _told(m, "source.type"), "Release": _told(m, "source.release_tag"), "File": _told(m, "source.filename", "source.source_filename", "source.pdf_filename"),
                "URL": _told(m, "source.download_url", "source.source_url", "source.url"),
            },
            "Retrieval": {"Retrieved": _told(m, "retrieval.retrieved_date"), "By": _told(m, "retrieval.retrieved_by"), "SHA256": _told(m, *(f"retrieval.{k}_sha256" for k in ("file", "db", "pdf", "text")))},
            "Extracted scales": scales(m),
            "Licensing": {k.replace("_", " "): v for k, v in licensing.items() if isinstance(v, str)} if isinstance(licensing, dict) else {"license": licensing},
        }
        for title, entries in sections.items():
            told = [f"- {k}: {v}" for k, v in entries.items() if v is not None]
            out += [f"### {title}", "", *told, ""] if told else []
        if slug in counts:
            out += ["### Counts", "", markdown_table(counts[slug]), ""]
    return "\n".join(out)
