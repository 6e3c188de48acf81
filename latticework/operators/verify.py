"""Integrity checks: each gives rows of schemas.CHECK, and a gate stops on a hard one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import LatticeworkError
from ..graph import TripleGraph
from ..schemas import CHECK
from .bindings import element_bindings, example_bindings, role_bindings, strict_elements, unit_bindings

SHORTEST, LONGEST = 10, 5000
#: Lengths at which columns are commonly cut.
CUT_LENGTHS = [255, 256, 1000, 1024, 4000, 4096]
REQUIRED_KEYS = ["framework", "framework_version", "source", "retrieval", "licensing"]


class VerificationFailed(LatticeworkError):
    """A check found a hard fault."""


def _map(**entries: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*(c.cast("string") for c in entries.values()))) if entries else F.create_map().cast("map<string,string>")


def _check(df: DataFrame, framework: str, name: str, severity: Column, message: Column, **details: Column) -> DataFrame:
    return df.select(F.lit(framework).alias("framework"), F.lit(name).alias("check"), severity.alias("severity"), message.alias("message"), _map(**details).alias("details"))


def record(spark: SparkSession, framework: str, check: str, severity: str, message: str, details: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame([(framework, check, severity, message, details or {})], CHECK)


def manifest_checks(spark: SparkSession, framework: str, manifest: dict | None, sha256: str | None = None) -> DataFrame:
    """The provenance manifest: present, its keys, and the declared hash against that of the source file (null: file missing)."""
    if manifest is None:
        return record(spark, framework, "provenance.exists", "hard", "no manifest")
    missing = [k for k in REQUIRED_KEYS if k not in manifest]
    found = record(spark, framework, "provenance.keys", "hard" if missing else "pass", f"missing keys: {', '.join(missing)}" if missing else "required keys present")
    retrieval = manifest.get("retrieval") or {}
    declared = retrieval.get("file_sha256") or retrieval.get("db_sha256")
    if declared:
        right = sha256 is not None and sha256.lower() == str(declared).lower()
        found = found.unionByName(record(spark, framework, "provenance.sha256", "pass" if right else "hard", "hash matches" if right else "file is missing" if sha256 is None else "hash differs", {"declared": str(declared), "found": str(sha256)}))
    return found


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def bound_checks(measured: DataFrame, framework: str, bounds: dict[str, tuple[float, float]] | None) -> DataFrame:
    """measured: (metric, value). A count out of its bounds, or that wasn't measured, is soft; no bounds at all are hard."""
    spark = measured.sparkSession
    if not bounds:
        return record(spark, framework, "counts.declared", "hard", "no expected counts")
    want = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in bounds.items()], "metric string, low double, high double")
    df = want.join(measured, "metric", "left")
    inside = F.col("value").between(F.col("low"), F.col("high"))
    severity = F.when(F.coalesce(inside, F.lit(False)), "pass").otherwise("soft")
    message = F.when(F.col("value").isNull(), "not measured").when(inside, "within bounds").otherwise("out of bounds")
    return _check(df, framework, "counts", severity, F.concat_ws(": ", "metric", message), metric=F.col("metric"), value=F.col("value"), low=F.col("low"), high=F.col("high"))


def metrics(df: DataFrame, **measures: Column) -> DataFrame:
    """(metric, value) of aggregates, all in one pass. distinct() counts null as a value."""
    row = df.agg(*(c.cast("double").alias(n) for n, c in measures.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in measures))))


def named_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: `counts`, a map from the column's values to their numbers of rows. For columns of few values, such as types."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("counts"))


def distinct(column: str) -> Column:
    return F.count_distinct(F.col(column)) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def modal_length(df: DataFrame, text: str) -> DataFrame:
    """length, n of the most frequent length; of equal ones the least."""
    return df.where(F.col(text).isNotNull()).groupBy(F.length(text).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1)


def text_checks(df: DataFrame, framework: str, text: str) -> DataFrame:
    """Replacement characters and empty texts are hard, odd lengths soft, a modal length at a usual cut hard."""
    length, bare = F.length(text), F.trim(F.coalesce(F.col(text), F.lit("")))
    counts = df.agg(
        F.count_if(F.contains(F.col(text), F.lit("�"))).alias("replaced"), F.count_if(bare == "").alias("empty"),
        F.count_if((bare != "") & (length < SHORTEST)).alias("short"), F.count_if(length > LONGEST).alias("long"),
    )

    def one(name: str, bad: str) -> DataFrame:
        n = F.col(name)
        return _check(counts, framework, f"text.{name}", F.when(n > 0, bad).otherwise("pass"), F.concat(n.cast("string"), F.lit(f" {name} texts in {text}")), n=n)

    mode = modal_length(df, text)
    cut = F.col("length").isin(CUT_LENGTHS) & (F.col("n") > 5)
    cuts = _check(mode, framework, "text.truncation", F.when(cut, "hard").otherwise("pass"), F.concat(F.lit("modal length "), F.col("length").cast("string")), length=F.col("length"), n=F.col("n"))
    return reduce(DataFrame.unionByName, [one("replaced", "hard"), one("empty", "hard"), one("short", "soft"), one("long", "soft"), cuts])


def id_checks(df: DataFrame, framework: str, column: str) -> DataFrame:
    """The id column is there, and no id occurs twice; five examples of those that do."""
    if column not in df.columns:
        return record(df.sparkSession, framework, "id.present", "hard", f"no column {column}")
    twice = df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    # row_number under a constant bound is planned as a limit, so five rows are gathered and not all
    five = twice.orderBy("id").limit(5).agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.coalesce("id", F.lit("null"))))).alias("examples"))
    total = twice.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("extra")).crossJoin(five)
    return _check(total, framework, "id.unique", F.when(F.col("extra") > 0, "hard").otherwise("pass"), F.concat(F.col("extra").cast("string"), F.lit(f" repeated ids in {column}")), examples=F.col("examples"))


def reference_checks(child: DataFrame, column: str, parent: DataFrame, key: str, framework: str, name: str) -> DataFrame:
    """Values of column that the parent's key lacks; nulls refer to nothing."""
    lost = child.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).join(parent.select(F.col(key).alias("k")), "k", "left_anti")
    n = lost.agg(F.count("*").alias("n"))
    return _check(n, framework, f"reference.{name}", F.when(F.col("n") > 0, "hard").otherwise("pass"), F.concat(F.col("n").cast("string"), F.lit(f" rows of {column} refer to nothing")), n=F.col("n"))


def graph_metrics(g: TripleGraph) -> DataFrame:
    """(metric, value) of the whole graph: frameworks, units, roles, elements strict and with examples."""
    parts = {
        "frameworks": g.subjects("a", "core:Framework"), "organizing_units": unit_bindings(g).select("unit").distinct(), "roles": role_bindings(g).select("role").distinct(),
        "elements_strict": strict_elements(g), "elements_with_examples": element_bindings(g), "examples": example_bindings(g),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("metric"), F.count("*").cast("double").alias("value")) for n, df in parts.items()])


def link_checks(g: TripleGraph, framework: str = "graph") -> DataFrame:
    """Links of the graph whose target isn't a subject in it."""
    known = g.triples.select("s").distinct()
    return reduce(DataFrame.unionByName, [reference_checks(g.pairs(f"core:{p}"), "o", known, "s", framework, p) for p in ("partOf", "hasElement", "hasExample", "elaborates")])


def severity_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("severity").agg(F.count("*").alias("n"))


def report(checks: DataFrame) -> DataFrame:
    """Hard, then soft, then pass."""
    rank = F.when(F.col("severity") == "hard", 0).when(F.col("severity") == "soft", 1).otherwise(2)
    return checks.orderBy(rank, "framework", "check", "message")


def first_rows(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def gate(checks: DataFrame, audit: str | None = None, script: str = "verify") -> dict[str, int]:
    """Counts by severity, appended to the audit log if one is named; raises if any check is hard."""
    counts = {r[0]: r[1] for r in severity_counts(checks).collect()}
    failed = counts.get("hard", 0) > 0
    if audit is not None:
        names = sorted(r[0] for r in checks.select("framework").distinct().collect())
        spark = checks.sparkSession
        entry = spark.createDataFrame([(script, names, sum(counts.values()), counts.get("pass", 0), counts.get("soft", 0), counts.get("hard", 0), "FAIL" if failed else "PASS")], "script string, frameworks array<string>, check_count int, pass_count int, soft_flag_count int, hard_fail_count int, overall_status string")
        entry.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("timestamp"), "*").write.mode("append").json(audit)
    if failed:
        raise VerificationFailed("; ".join(r[0] for r in checks.where("severity = 'hard'").select(F.concat_ws(" ", "framework", "check", "message")).limit(20).collect()))
    return counts
