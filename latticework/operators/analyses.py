"""Named analyses over a graph, and the runner that reports on each."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import TripleGraph
from .bindings import element_bindings, example_bindings, framework_metadata, role_bindings, role_element_bindings, strict_elements, unit_bindings


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc_nulls_last(key))


def units_per_framework(g: TripleGraph) -> DataFrame:
    return _counted(unit_bindings(g), "framework_name", "organizing_unit_count")


def roles_per_framework(g: TripleGraph) -> DataFrame:
    return _counted(role_bindings(g), "framework_name", "role_count")


def strict_elements_per_framework(g: TripleGraph) -> DataFrame:
    return _counted(strict_elements(g), "framework_name", "element_count_strict")


def elements_per_framework(g: TripleGraph) -> DataFrame:
    return _counted(element_bindings(g), "framework_name", "element_count_with_examples")


def metadata(g: TripleGraph) -> DataFrame:
    return framework_metadata(g).select(F.col("name").alias("framework_name"), "jurisdiction", "sector", "specificity").orderBy("jurisdiction", "framework_name")


def _by_dimension(g: TripleGraph, elements: DataFrame, dimension: str, name: str) -> DataFrame:
    return _counted(elements.join(framework_metadata(g).select("framework", dimension), "framework", "left"), dimension, name)


def strict_by_jurisdiction(g: TripleGraph) -> DataFrame:
    """Frameworks without a jurisdiction are a group of their own."""
    return _by_dimension(g, strict_elements(g), "jurisdiction", "element_count_strict")


def strict_by_sector(g: TripleGraph) -> DataFrame:
    return _by_dimension(g, strict_elements(g), "sector", "element_count_strict")


def by_specificity(g: TripleGraph) -> DataFrame:
    return _by_dimension(g, element_bindings(g), "specificity", "element_count")


def largest_units(g: TripleGraph, k: int = 20) -> DataFrame:
    """The k units with most elements. Equal counts are in order of the unit's id."""
    counts = role_element_bindings(g).groupBy(F.col("role").alias("unit")).agg(F.count("*").alias("element_count"))
    named = counts.join(unit_bindings(g), "unit", "left")
    return named.select("framework_name", "unit_name", "element_count", "unit").orderBy(F.desc("element_count"), "unit", "unit_name").limit(k)


def examples_per_framework(g: TripleGraph) -> DataFrame:
    return _counted(example_bindings(g), "framework_name", "example_count")


def density(g: TripleGraph) -> DataFrame:
    """framework_name, top_level_unit_count, element_count, elements_per_unit (one decimal, half to even)."""
    units = unit_bindings(g).groupBy("framework_name").agg(F.count("*").alias("top_level_unit_count"))
    elements = element_bindings(g).groupBy("framework_name").agg(F.count("*").alias("element_count"))
    return units.join(elements, "framework_name").withColumn("elements_per_unit", F.bround(F.col("element_count") / F.col("top_level_unit_count"), 1))


def unit_sizes(g: TripleGraph) -> DataFrame:
    """Unit bindings with element_count, null for units without elements."""
    counts = role_element_bindings(g).groupBy(F.col("role").alias("unit")).agg(F.count("*").alias("element_count"))
    return unit_bindings(g).join(counts, "unit", "left")


def pairwise(g: TripleGraph, frameworks: list[str] | None = None) -> DataFrame:
    """framework_name, organizing_unit_count, mean, median and most elements of a unit, for the named frameworks or all."""
    sizes = unit_sizes(g)
    if frameworks is not None:
        sizes = sizes.where(F.col("framework_name").isin(frameworks))
    return sizes.groupBy("framework_name").agg(
        F.count("*").alias("organizing_unit_count"), F.avg("element_count").alias("mean_elements"),
        F.percentile("element_count", 0.5).alias("median_elements"), F.max("element_count").alias("max_elements"),
    )


def elements_without_text(g: TripleGraph) -> DataFrame:
    nodes = g.subjects("a", "core:RoleElement").withColumnRenamed("s", "element")
    return nodes.join(g.pairs("core:elementText").select(F.col("s").alias("element")), "element", "left_anti")


def framework_summary(g: TripleGraph, display: DataFrame) -> DataFrame:
    """One row a framework: counts, densities and display columns. display: framework_slug (the IRI's tail), framework_type, license."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("framework").agg(F.count("*").alias(name))

    base = framework_metadata(g).select("framework", F.col("name").alias("framework_name"), "jurisdiction")
    found = base.join(counted(unit_bindings(g), "organizing_unit_count"), "framework").join(counted(strict_elements(g), "element_count_strict"), "framework")
    found = found.join(counted(example_bindings(g), "example_count"), "framework", "left").withColumn("example_count", F.coalesce("example_count", F.lit(0).cast("long")))
    found = found.withColumn("framework_slug", F.substring_index("framework", "/", -1)).join(display, "framework_slug", "left")
    found = found.withColumn("element_count_with_examples", F.col("element_count_strict") + F.col("example_count"))
    per = [(f"elements_per_organizing_unit_{k}", F.bround(F.col(f"element_count_{k}") / F.col("organizing_unit_count"), 1)) for k in ("strict", "with_examples")]
    return found.withColumns(dict(per)).select(
        "framework_slug", "framework_name", "framework_type", "jurisdiction", "organizing_unit_count", "element_count_strict", "element_count_with_examples",
        "example_count", *(name for name, _ in per), "license",
    )


def summary_faults(summary: DataFrame) -> DataFrame:
    """Rows of a summary that break what must hold: counts are positive, strict is at most full, examples are the difference, densities fit."""
    holds = (F.col("organizing_unit_count") > 0) & (F.col("element_count_strict") <= F.col("element_count_with_examples"))
    holds &= F.col("element_count_with_examples") - F.col("element_count_strict") == F.col("example_count")
    holds &= F.col("elements_per_organizing_unit_strict") <= F.col("elements_per_organizing_unit_with_examples")
    return summary.where(~holds)


def density_spread(summary: DataFrame) -> DataFrame:
    """The summary without licences, densest first."""
    return summary.drop("license").orderBy(F.desc("elements_per_organizing_unit_with_examples"), "framework_slug")


def jurisdiction_totals(summary: DataFrame) -> DataFrame:
    """jurisdiction, frameworks (names, in order), n_frameworks, n_elements."""
    return summary.groupBy("jurisdiction").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("framework_name"))).alias("frameworks"), F.count("*").alias("n_frameworks"), F.sum("element_count_with_examples").alias("n_elements")
    )


def jurisdiction_ratio(summary: DataFrame, one: str, other: str) -> DataFrame:
    """Elements of one jurisdiction over those of another."""
    def total(j: str):
        return F.sum(F.when(F.col("jurisdiction") == j, F.col("element_count_with_examples")))

    return summary.agg(total(one).alias("n_one"), total(other).alias("n_other")).withColumn("ratio", F.col("n_one") / F.col("n_other"))


def role_concentration(g: TripleGraph) -> DataFrame:
    """role, role_name, element_count, rank and share of all elements. Roles without elements drop out.

    No task orders all roles: how many are larger is summed over the distinct counts, and only roles of one count are ordered
    among themselves. Shares divide by a total that is aggregated apart.
    """
    counts = role_element_bindings(g).groupBy("role").agg(F.count("*").alias("element_count"))
    roles = role_bindings(g).select("role", "role_name").join(counts, "role")
    total = counts.join(role_bindings(g).select("role").distinct(), "role", "left_semi").agg(F.sum("element_count").alias("total"))
    sizes = roles.groupBy("element_count").agg(F.count("*").alias("n"))
    larger = sizes.select("element_count", (F.sum("n").over(Window.orderBy(F.desc("element_count"))) - F.col("n")).alias("larger"))
    among = F.row_number().over(Window.partitionBy("element_count").orderBy("role", "role_name"))
    ranked = roles.withColumn("among", among).join(larger, "element_count").withColumn("rank", (F.col("larger") + F.col("among")).cast("long"))
    return ranked.crossJoin(total).select("role", "role_name", "element_count", "rank", (F.col("element_count") / F.col("total")).alias("share"))


def top_share(concentration: DataFrame, k: int = 5) -> DataFrame:
    """n_roles, median_elements, and the share of the k largest."""
    return concentration.agg(F.count("*").alias("n_roles"), F.percentile("element_count", 0.5).alias("median_elements"), (F.sum(F.when(F.col("rank") <= k, F.col("element_count"))) / F.sum("element_count")).alias("top_share"))


Analysis = Callable[[TripleGraph], DataFrame]
ANALYSES: dict[str, tuple[str, Analysis]] = {
    "q10": ("Organizing units per framework", units_per_framework),
    "q10b": ("Roles per framework", roles_per_framework),
    "q11": ("Elements per framework, strict", strict_elements_per_framework),
    "q11b": ("Elements per framework, with examples", elements_per_framework),
    "q12": ("Framework metadata", metadata),
    "q13": ("Strict elements by jurisdiction", strict_by_jurisdiction),
    "q14": ("Strict elements by sector", strict_by_sector),
    "q15": ("Largest units", largest_units),
    "q16": ("Examples per framework", examples_per_framework),
}


def run_all(spark: SparkSession, g: TripleGraph, sink: Callable[[str, DataFrame], None] | None = None, analyses: dict[str, tuple[str, Analysis]] | None = None) -> DataFrame:
    """query_id, rows, status, seconds. A failing analysis is reported and the others still run."""
    report = []
    for name, (_, analysis) in (analyses or ANALYSES).items():
        began = time.time()
        try:
            found = analysis(g).cache()
            rows, status = found.count(), "ok"
            if sink is not None:
                sink(name, found)
            found.unpersist()
        except Exception as error:  # noqa: BLE001  reported, not hidden
            rows, status = None, f"error: {type(error).__name__}"
        report.append((name, rows, status, time.time() - began))
    return spark.createDataFrame(report, "query_id string, rows long, status string, seconds double")
