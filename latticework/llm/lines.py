"""Operator 9: removal of lines that many sites share.

A HyperLogLog sketch of a line's sites is built in each task and merged by aggregation, so a line on all sites costs
one small sketch a task. Lines whose estimate is clearly over the threshold are boilerplate, clearly under it are not;
only those within BAND of it get an exact count of distinct sites. A boilerplate line stays in the document with the
least id that has it, and goes from all others, so no text is lost altogether.

Lines are compared without the white space around them. Every line that isn't blank is judged, however short: menu lines,
and lines of scripts without spaces, which are one word.

Defined cases: a null text is empty; a null site counts as one site of its own; a null doc_id comes after all others;
rows of equal id and text are treated alike; an empty table gives no rows; other columns, whatever their names, are
carried by strip_lines(), but for one named _lines, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, SPACE, documents, keyed, scratch, small, whole, written

MIN_SITES, LOG_K, BAND = 10, 12, 0.10
_LINE = ["l1", "l2"]


def _lines(rows: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: the key, its place, its hash (96 bits) and its site."""
    line = rows.select(*KEY, "_site", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "raw"))
    line = line.withColumn("raw", F.regexp_replace("raw", f"^[{SPACE}]+|[{SPACE}]+$", "")).where("raw <> ''")
    return line.select(*KEY, "place", F.xxhash64("raw").alias("l1"), F.hash("raw").alias("l2"), "_site")


def boilerplate(lines: DataFrame, folder: str, min_sites: int = MIN_SITES) -> DataFrame:
    """l1, l2 and the least id of the lines on min_sites sites or more."""
    spread = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("_site", F.lit(LOG_K)).alias("sketch"), F.min("_id").alias("first"))
    spread = spread.select(*_LINE, "first", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= min_sites * (1 - BAND))
    spread = written(spread, folder, "spread")
    near = spread.where(F.col("n") <= min_sites * (1 + BAND))
    pairs = lines.join(small(near.select(*_LINE)), _LINE, "left_semi").groupBy(*_LINE, "_site").agg(F.count("*").alias("c"))
    exact = pairs.groupBy(*_LINE).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return written(spread.where(F.col("n") > min_sites * (1 + BAND)).select(*_LINE, "first").unionByName(near.join(exact, _LINE).select(*_LINE, "first")), folder, "boilerplate")


def stripped(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`row`, the input's row as a struct, `left`, its text without boilerplate lines (null if it was), n_lines and n_removed."""
    folder = scratch(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    lines = _lines(keyed(docs.select("doc_id", text, F.coalesce(F.xxhash64(F.col(site).cast("string")), F.lit(0)).alias("_site"))))
    common = small(boilerplate(lines, folder, min_sites))
    gone = lines.join(common, _LINE).where(F.col("_id") > F.col("first"))
    gone = written(gone.groupBy(*KEY).agg(F.collect_set("place").alias("gone")), folder, "gone")
    joined = keyed(docs.select(whole(docs).alias("row"), "doc_id", text)).join(gone, KEY, "left").withColumn("parts", F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return joined.select("row", left.alias("left"), F.size("parts").cast("long").alias("n_lines"), removed.alias("n_removed"))


def strip_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows with their text stripped of boilerplate lines, and struct _lines: n_lines, n_removed."""
    columns = [F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "_lines"]
    return stripped(docs, site, min_sites).select(*columns, F.struct("n_lines", "n_removed").alias("_lines"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    left = stripped(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return left.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("left", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, source, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
j AS (SELECT *, regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g') AS raw FROM l),
s AS (SELECT raw, min(doc_id) AS first FROM j
      WHERE raw <> '' GROUP BY raw HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT j.doc_id, count(*) AS n_lines, count(*) FILTER (s.raw IS NOT NULL AND j.doc_id > s.first) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (s.raw IS NULL OR j.doc_id <= s.first), '')) AS kept_sha256
FROM j LEFT JOIN s ON j.raw = s.raw GROUP BY j.doc_id
"""
