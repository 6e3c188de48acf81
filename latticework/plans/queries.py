"""The registered queries over the driver's tables, each with the SQL that an oracle runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fragments, nodes, text
from ..graph import PartitionedGraph, TripleGraph
from ..namespaces import expand
from ..operators import analyses, bindings, similarity, verify
from ..sources import ntriples, tables
from . import ingest, staged, testbed
from .testbed import sql, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None) -> None:
    _QUERIES[name] = query
    if oracle is not None:
        _SQL[name] = oracle


def _on_graph(name: str, analysis: Callable[[TripleGraph], DataFrame], select: str) -> None:
    _add(name, lambda spark, d: analysis(testbed.graph(spark, d)), sql(select))


# Patterns and bindings
_on_graph("pairs_part_of", lambda g: g.pairs("core:partOf"), "SELECT s, o FROM t WHERE p = 'partOf'")
_on_graph("pairs_absent", lambda g: g.pairs("skos:related"), "SELECT s, o FROM t WHERE p = 'related'")
_on_graph("subjects_framework", lambda g: g.subjects("a", "core:Framework"), "SELECT framework AS s FROM fw")
_on_graph(
    "match_patterns",
    lambda g: g.match([("?unit", "a", "core:Role"), ("?unit", "core:hasElement", "?element"), ("?element", "core:hasExample", "?example")], [("?element", "core:elementText", "?text")]),
    "SELECT u.s AS unit, h.o AS element, x.o AS example, l.o AS text FROM t u JOIN t h ON h.s = u.s AND h.p = 'hasElement' JOIN t x ON x.s = h.o AND x.p = 'hasExample' LEFT JOIN t l ON l.s = h.o AND l.p = 'elementText' WHERE u.p = 'a' AND u.o = 'Role'",
)
_on_graph("framework_metadata", bindings.framework_metadata, "SELECT * FROM meta")
_on_graph("role_bindings", bindings.role_bindings, "SELECT * FROM role")
_on_graph("unit_bindings", bindings.unit_bindings, "SELECT * FROM unit")
_on_graph("element_bindings", bindings.element_bindings, "SELECT * FROM element")
_on_graph("example_bindings", bindings.example_bindings, "SELECT * FROM example")
_on_graph("role_element_bindings", bindings.role_element_bindings, "SELECT * FROM he")
_on_graph("strict_elements", bindings.strict_elements, "SELECT * FROM strict")

# Named analyses
_on_graph("q10_units", analyses.units_per_framework, "SELECT framework_name, count(*) AS organizing_unit_count FROM unit GROUP BY 1")
_on_graph("q10b_roles", analyses.roles_per_framework, "SELECT framework_name, count(*) AS role_count FROM role GROUP BY 1")
_on_graph("q11_strict", analyses.strict_elements_per_framework, "SELECT framework_name, count(*) AS element_count_strict FROM strict GROUP BY 1")
_on_graph("q11b_full", analyses.elements_per_framework, "SELECT framework_name, count(*) AS element_count_with_examples FROM element GROUP BY 1")
_on_graph("q12_metadata", analyses.metadata, "SELECT name AS framework_name, jurisdiction, sector, specificity FROM meta")
_on_graph("q13_jurisdiction", analyses.strict_by_jurisdiction, "SELECT jurisdiction, count(*) AS element_count_strict FROM strict LEFT JOIN meta USING (framework) GROUP BY 1")
_on_graph("q14_sector", analyses.strict_by_sector, "SELECT sector, count(*) AS element_count_strict FROM strict LEFT JOIN meta USING (framework) GROUP BY 1")
_on_graph("q15_largest_units", analyses.largest_units, "SELECT framework_name, unit_name, n AS element_count, role AS unit FROM (SELECT role, count(*) AS n FROM he GROUP BY role) LEFT JOIN unit ON unit = role ORDER BY n DESC, role LIMIT 20")
_on_graph("q16_examples", analyses.examples_per_framework, "SELECT framework_name, count(*) AS example_count FROM example GROUP BY 1")
_on_graph("by_specificity", analyses.by_specificity, "SELECT specificity, count(*) AS element_count FROM element LEFT JOIN meta USING (framework) GROUP BY 1")
_on_graph(
    "density",
    analyses.density,
    "SELECT framework_name, u AS top_level_unit_count, n AS element_count, round_even(n / u, 1) AS elements_per_unit FROM (SELECT framework_name, count(*) AS u FROM unit GROUP BY 1) JOIN (SELECT framework_name, count(*) AS n FROM element GROUP BY 1) USING (framework_name)",
)
_on_graph(
    "pairwise_compare",
    lambda g: analyses.pairwise(g, ["EUROPE", "AMERICA"]),
    "SELECT framework_name, count(*) AS organizing_unit_count, avg(element_count) AS mean_elements, median(element_count) AS median_elements, max(element_count) AS max_elements FROM sized WHERE framework_name IN ('EUROPE', 'AMERICA') GROUP BY 1",
)
_on_graph("elements_without_text", analyses.elements_without_text, "SELECT x.s AS element FROM t x ANTI JOIN (SELECT s FROM t WHERE p = 'elementText') y ON y.s = x.s WHERE x.p = 'a' AND x.o = 'RoleElement'")
_on_graph("top_level_elements", lambda g: g.subjects("a", "core:RoleElement").join(g.pairs("core:elaborates").select("s"), "s", "left_anti"), "SELECT x.s FROM t x ANTI JOIN (SELECT s FROM t WHERE p = 'elaborates') y ON y.s = x.s WHERE x.p = 'a' AND x.o = 'RoleElement'")

_SUMMARY = """, summary AS (SELECT replace(framework, 'http://testbed.example/framework/', '') AS framework_slug, name AS framework_name, 'regional' AS framework_type, jurisdiction,
 u AS organizing_unit_count, n AS element_count_strict, n + coalesce(x, 0) AS element_count_with_examples, coalesce(x, 0) AS example_count,
 round_even(n / u, 1) AS elements_per_organizing_unit_strict, round_even((n + coalesce(x, 0)) / u, 1) AS elements_per_organizing_unit_with_examples, 'open' AS license
 FROM meta JOIN (SELECT framework, count(*) AS u FROM unit GROUP BY 1) USING (framework) JOIN (SELECT framework, count(*) AS n FROM strict GROUP BY 1) USING (framework)
 LEFT JOIN (SELECT framework, count(*) AS x FROM example GROUP BY 1) USING (framework))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    display = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS framework_slug", "'regional' AS framework_type", "'open' AS license")
    return analyses.framework_summary(testbed.graph(spark, sf_dir), display)


_add("framework_summary", _summary, f"WITH {testbed.CTES}{_SUMMARY} SELECT * FROM summary")
_add("jurisdiction_totals", lambda s, d: analyses.jurisdiction_totals(_summary(s, d)), f"WITH {testbed.CTES}{_SUMMARY} SELECT jurisdiction, string_agg(framework_name, ', ' ORDER BY framework_name) AS frameworks, count(*) AS n_frameworks, CAST(sum(element_count_with_examples) AS BIGINT) AS n_elements FROM summary GROUP BY 1")
_add("jurisdiction_ratio", lambda s, d: analyses.jurisdiction_ratio(_summary(s, d), "US", "EU"), f"WITH {testbed.CTES}{_SUMMARY} SELECT *, n_one / n_other AS ratio FROM (SELECT CAST(sum(element_count_with_examples) FILTER (jurisdiction = 'US') AS BIGINT) AS n_one, CAST(sum(element_count_with_examples) FILTER (jurisdiction = 'EU') AS BIGINT) AS n_other FROM summary)")
_CONCENTRATION = "conc AS (SELECT role, role_name, n AS element_count, row_number() OVER (ORDER BY n DESC, role, role_name) AS rank, n / sum(n) OVER () AS share FROM role JOIN (SELECT role, count(*) AS n FROM he GROUP BY role) USING (role))"
_on_graph("role_concentration", analyses.role_concentration, f", {_CONCENTRATION} SELECT * FROM conc")
_on_graph("top_share", lambda g: analyses.top_share(analyses.role_concentration(g)), f", {_CONCENTRATION} SELECT count(*) AS n_roles, median(element_count) AS median_elements, (sum(element_count) FILTER (rank <= 5)) / sum(element_count) AS top_share FROM conc")

# Fragment parser
_PARSED = f"""WITH x AS (SELECT 'p' || p_partkey AS id, {testbed.PARTS} AS t FROM part),
a AS (SELECT id, CASE WHEN regexp_matches(t, '(?i)clarification statement:') THEN 'Example' ELSE 'Subpoint' END AS nt, regexp_replace(t, '(?i)^.*?clarification statement:\\s*', '') AS body FROM x),
b AS (SELECT *, regexp_split_to_array(body, '(?i)\\b(such as|examples? of|examples? include|e\\.g\\.|including|for example)\\b') AS parts FROM a),
e AS (SELECT *, len(parts) > 1 AS has, regexp_replace(regexp_replace(parts[-1], '\\.\\s*$', ''), '(?s)(\\.\\s+[A-Z].*|\\n.*)$', '') AS seg FROM b),
f AS (SELECT *, CASE WHEN NOT has AND length(body) - length(replace(body, ';', '')) >= 2 THEN regexp_split_to_array(body, '\\s*;\\s*')
  WHEN has AND contains(seg, ';') THEN regexp_split_to_array(seg, '\\s*;\\s*(?:and\\s+|or\\s+)?')
  WHEN has THEN regexp_split_to_array(regexp_replace(seg, '\\s+(and|or)\\s+', ', ', 'g'), '\\s*,\\s*') END AS raw FROM e),
g AS (SELECT id, nt, list_filter(list_transform(raw, lambda y: trim(regexp_replace(trim(y), '\\.\\s+[A-Z].*$', ''))),
  lambda y: length(y) >= 3 AND lower(y) NOT IN ('and','or','the','but','however','etc','etc.','etcetera') AND NOT regexp_matches(y, '(?s)\\n.*[A-Z]')) AS items FROM f),
frag AS (SELECT id AS parent_id, CAST(unnest(range(1, len(items) + 1)) AS INTEGER) AS ordinal, nt AS node_type, unnest(items) AS text FROM g WHERE len(items) >= 2)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fragments.with_fragments(testbed.part_texts(spark, sf_dir), "text")
    return found.select(F.col("id").alias("parent_id"), F.inline("fragments")).select("parent_id", "ordinal", "node_type", "text")


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testbed.part_texts(spark, sf_dir).select(F.col("id").alias("element_id"), F.col("text").alias("element_text"), F.lit("nice-v2").alias("framework_id"))
    return nodes.element_nodes(rows, "nice", "TaskStatement")


def _expanded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fragments.expand_fragments(_part_nodes(spark, sf_dir), "nice", "nice-v2")


_add("parse_fragments", _fragments, f"{_PARSED} SELECT * FROM frag")
_INDEX = "'nice:' || parent_id AS parent_id, 'nice:' || parent_id || CASE node_type WHEN 'Example' THEN '.example.' ELSE '.sub.' END || ordinal AS subnode_id, ordinal, node_type"
_add("fragment_index", lambda s, d: _expanded(s, d)[1], f"{_PARSED} SELECT {_INDEX} FROM frag")
_add(
    "expanded_nodes",
    lambda s, d: _expanded(s, d)[0].select("id", F.array_join("types", " ").alias("types"), "element_text", "part_of", "elaborates", F.array_join("has_example", " ").alias("has_example")),
    f"""{_PARSED} SELECT 'nice:' || x.id AS id, 'nice:TaskStatement core:RoleElement' AS types, t AS element_text, 'core:framework/nice-v2' AS part_of, NULL AS elaborates, links AS has_example
FROM x LEFT JOIN (SELECT parent_id, string_agg('nice:' || parent_id || '.example.' || ordinal, ' ' ORDER BY ordinal) AS links FROM frag WHERE node_type = 'Example' GROUP BY 1) ON parent_id = x.id
UNION ALL SELECT 'nice:' || parent_id || CASE node_type WHEN 'Example' THEN '.example.' ELSE '.sub.' END || ordinal,
CASE node_type WHEN 'Example' THEN 'core:Example core:RoleElement' ELSE 'nice:TaskStatement core:Subpoint core:RoleElement' END, text, 'core:framework/nice-v2',
CASE node_type WHEN 'Subpoint' THEN 'nice:' || parent_id END, NULL FROM frag""",
)


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("unit")).agg(F.array_sort(F.collect_list(F.concat(F.lit("nice:p"), "p_partkey"))).alias("ids"))
    found = fragments.extend_ids(units, "ids", _expanded(spark, sf_dir)[1])
    return found.select("unit", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.array_sort("ids"), " ").cast("binary")).alias("ids_md5"))


_add("extend_ids", _extended, f"""{_PARSED}, every AS (SELECT p_brand AS unit, 'nice:p' || p_partkey AS id FROM part UNION SELECT p_brand, 'nice:' || parent_id || '.sub.' || ordinal FROM part JOIN frag ON parent_id = 'p' || p_partkey WHERE node_type = 'Subpoint')
SELECT unit, count(*) AS n_ids, md5(string_agg(id, ' ' ORDER BY id)) AS ids_md5 FROM every GROUP BY 1""")
_add("strict_vs_full", lambda s, d: _expanded(s, d)[0].agg(F.count_if(~F.array_contains("types", "core:Example")).alias("strict"), F.count("*").alias("full")), f"{_PARSED} SELECT (SELECT count(*) FROM x) + count(*) FILTER (node_type = 'Subpoint') AS strict, (SELECT count(*) FROM x) + count(*) AS \"full\" FROM frag")
_add("validate_nodes", lambda s, d: nodes.validated(_expanded(s, d)[0].withColumn("id", F.when(~F.endswith("id", F.lit("7")), F.col("id")))).groupBy("valid", F.array_join("missing_fields", " ").alias("missing_fields")).agg(F.count("*").alias("n")), f"{_PARSED}, ids AS (SELECT id FROM x UNION ALL SELECT subnode_id FROM (SELECT {_INDEX} FROM frag)) SELECT id NOT LIKE '%7' AS valid, CASE WHEN id LIKE '%7' THEN '@id' ELSE '' END AS missing_fields, count(*) AS n FROM ids GROUP BY 1, 2")
_NICE = "https://nice.nist.gov/framework/terms#"
_add(
    "nodes_to_triples",
    lambda s, d: nodes.to_triples(_expanded(s, d)[0], unique=True).triples.groupBy("o_kind", F.regexp_extract("p", "([^#/]+)$", 1).alias("p")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects")),
    f"""{_PARSED}, tr AS (SELECT id AS s, unnest(['elementText', 'partOf', 'type', 'type']) AS p, unnest(['literal', 'iri', 'iri', 'iri']) AS o_kind FROM x
UNION ALL SELECT parent_id || node_type || ordinal, unnest(['elementText', 'partOf', 'type', 'type']), unnest(['literal', 'iri', 'iri', 'iri']) FROM frag
UNION ALL SELECT parent_id || node_type || ordinal, unnest(['elaborates', 'type']), 'iri' FROM frag WHERE node_type = 'Subpoint'
UNION ALL SELECT parent_id, 'hasExample', 'iri' FROM frag WHERE node_type = 'Example')
SELECT o_kind, p, count(*) AS n, count(DISTINCT s) AS subjects FROM tr GROUP BY 1, 2""",
)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ntriples.lines_of(testbed.graph(spark, sf_dir))
    back = TripleGraph.of(ntriples.parse(lines)[0])
    short = back.triples.withColumn("p", F.regexp_extract("p", "([^#/]+)$", 1))
    short = short.withColumn("line", F.concat_ws(" ", "s", F.when(F.col("p") == "type", F.regexp_extract("o", "([^#/]+)$", 1)).otherwise(F.col("o"))))
    digest = F.sum(F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 8), 16, 10).cast("long"))
    return short.groupBy("p", "o_kind").agg(F.count("*").alias("n"), digest.alias("digest"))


_add("ntriples_roundtrip", _round_trip, sql("SELECT CASE p WHEN 'a' THEN 'type' ELSE p END AS p, CASE WHEN p IN ('name', 'jurisdiction', 'sector', 'specificity', 'elementText') THEN 'literal' ELSE 'iri' END AS o_kind, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(s || ' ' || o), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM t WHERE o IS NOT NULL GROUP BY 1, 2"))

# Similarity: documents against the benchmark's items
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = f"""WITH b AS (SELECT 'b' || item_id AS right_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS rt FROM benchmark),
d AS (SELECT doc_id AS left_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS lt FROM documents),
dt AS (SELECT left_id, len(lt) AS na, unnest(lt) AS token FROM d), bt AS (SELECT right_id, len(rt) AS nb, unnest(rt) AS token FROM b),
pairs AS (SELECT left_id, right_id, count(*) / (any_value(na) + any_value(nb) - count(*)) AS similarity FROM dt JOIN bt USING (token) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS rank FROM pairs)"""


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("left_id"), text.tokens(F.col("text")).alias("left_tokens"))
    right = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("right_id"), text.tokens(F.col("text")).alias("right_tokens"))
    return similarity.best_matches(left, right, k).withColumn("rank", F.col("rank").cast("long"))


def _rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("right_id"))


_add("token_counts", lambda s, d: table(s, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens")), f"{_TOKENS} SELECT left_id AS doc_id, len(lt) AS n_tokens FROM d")
_add("jaccard_top1", lambda s, d: _ranked(s, d, 1), f"{_TOKENS} SELECT * FROM ranked WHERE rank <= 1")
_add("jaccard_top3", lambda s, d: _ranked(s, d, 3), f"{_TOKENS} SELECT * FROM ranked WHERE rank <= 3")
_TIER = "CASE WHEN similarity >= 0.30 THEN 'strong' WHEN similarity >= 0.20 THEN 'moderate' WHEN similarity >= 0.10 THEN 'weak' ELSE 'none' END"
_add("alignment_tiers", lambda s, d: _ranked(s, d, 1).groupBy(similarity.tier(F.col("similarity")).alias("tier")).agg(F.count("*").alias("n")), f"{_TOKENS} SELECT {_TIER} AS tier, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY 1")


def _tier_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir, 2).withColumn("tier", similarity.tier(F.col("similarity")))
    first, second = (ranked.where(F.col("rank") == k).groupBy("tier").agg(F.count("*").alias(n)) for k, n in ((1, "n_first"), (2, "n_second")))
    return first.join(second, "tier", "full")


_add("tier_full_join", _tier_join, f"{_TOKENS}, tt AS (SELECT rank, {_TIER} AS tier, count(*) AS n FROM ranked WHERE rank <= 2 GROUP BY 1, 2) SELECT coalesce(f.tier, g.tier) AS tier, f.n AS n_first, g.n AS n_second FROM (SELECT * FROM tt WHERE rank = 1) f FULL JOIN (SELECT * FROM tt WHERE rank = 2) g ON f.tier = g.tier")
_add("similarity_stats", lambda s, d: similarity.similarity_stats(_ranked(s, d, 1)).select(*(F.round(c, 9).alias(c) for c in ("least", "q1", "median", "mean", "q3", "most"))), f"{_TOKENS} SELECT round(min(similarity), 9) AS least, round(quantile_cont(similarity, 0.25), 9) AS q1, round(quantile_cont(similarity, 0.5), 9) AS median, round(avg(similarity), 9) AS mean, round(quantile_cont(similarity, 0.75), 9) AS q3, round(max(similarity), 9) AS most FROM ranked WHERE rank = 1")
_add("best_match_frequency", lambda s, d: similarity.best_match_frequency(_ranked(s, d, 1), _rights(s, d)), f"{_TOKENS} SELECT right_id, count(left_id) AS n FROM b LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING (right_id) GROUP BY 1")

# Integrity
_add(
    "text_integrity",
    lambda s, d: verify.text_checks(table(s, d, "documents"), "documents", "text").select("check", "severity", F.element_at("details", "n").cast("long").alias("n")),
    """WITH c AS (SELECT count(*) FILTER (contains(text, chr(65533))) AS replaced, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty, count(*) FILTER (trim(text) <> '' AND length(text) < 10) AS short, count(*) FILTER (length(text) > 5000) AS long FROM documents)
SELECT 'text.replaced' AS "check", CASE WHEN replaced > 0 THEN 'hard' ELSE 'pass' END AS severity, replaced AS n FROM c UNION ALL SELECT 'text.empty', CASE WHEN empty > 0 THEN 'hard' ELSE 'pass' END, empty FROM c
UNION ALL SELECT 'text.short', CASE WHEN short > 0 THEN 'soft' ELSE 'pass' END, short FROM c UNION ALL SELECT 'text.long', CASE WHEN long > 0 THEN 'soft' ELSE 'pass' END, long FROM c
UNION ALL SELECT 'text.truncation', CASE WHEN length IN (255, 256, 1000, 1024, 4000, 4096) AND n > 5 THEN 'hard' ELSE 'pass' END, n FROM (SELECT length(text) AS length, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, length LIMIT 1)""",
)
_add("length_mode", lambda s, d: verify.modal_length(table(s, d, "documents"), "text").select(F.col("length").cast("long").alias("length"), "n"), "SELECT length(text) AS length, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, length LIMIT 1")
_add("duplicate_ids", lambda s, d: verify.id_checks(table(s, d, "lineitem"), "lineitem", "l_partkey").select("severity", F.element_at("details", "examples").alias("examples")), "WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS k, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT CASE WHEN sum(n - 1) > 0 THEN 'hard' ELSE 'pass' END AS severity, (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM g ORDER BY l_partkey LIMIT 5)) AS examples FROM g")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]
    checks = None
    for child, column, parent, key in links:
        one = verify.reference_checks(table(spark, sf_dir, child), column, table(spark, sf_dir, parent), key, child, parent)
        checks = one if checks is None else checks.unionByName(one)
    return checks.select("framework", "check", "severity", F.element_at("details", "n").cast("long").alias("n"))


_REFS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]
_add("referential_integrity", _references, "SELECT framework, \"check\", CASE WHEN n > 0 THEN 'hard' ELSE 'pass' END AS severity, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS framework, 'reference.{p}' AS \"check\", count(*) AS n FROM {c} x WHERE x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{q} = x.{k})" for c, k, p, q in _REFS) + ")")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = verify.graph_metrics(testbed.graph(spark, sf_dir))
    return verify.bound_checks(measured, "graph", {"frameworks": (5, 5), "organizing_units": (1, 10), "roles": (1, 100), "unheard_of": (0, 1)}).select("severity", F.element_at("details", "metric").alias("metric"), F.element_at("details", "value").cast("double").alias("value"))


_add("count_bounds", _bounds, sql("""SELECT CASE WHEN value BETWEEN low AND high THEN 'pass' ELSE 'soft' END AS severity, metric, value FROM (
SELECT 'frameworks' AS metric, 5 AS low, 5 AS high, CAST(count(*) AS DOUBLE) AS value FROM fw UNION ALL SELECT 'organizing_units', 1, 10, CAST(count(DISTINCT unit) AS DOUBLE) FROM unit
UNION ALL SELECT 'roles', 1, 100, CAST(count(DISTINCT role) AS DOUBLE) FROM role UNION ALL SELECT 'unheard_of', 0, 1, NULL)"""))
_on_graph("link_checks", lambda g: verify.link_checks(g).select("check", "severity", F.element_at("details", "n").cast("long").alias("n")), """SELECT 'reference.' || q AS "check", CASE WHEN n > 0 THEN 'hard' ELSE 'pass' END AS severity, n FROM (
SELECT q, count(t.s) AS n FROM (SELECT unnest(['partOf', 'hasElement', 'hasExample', 'elaborates']) AS q) LEFT JOIN t ON p = q AND o NOT IN (SELECT s FROM t) GROUP BY q)""")

# Text and table shaping
_add("line_blocks", lambda s, d: tables.blocks(tables.numbered(table(s, d, "documents"), "doc_id", "text"), "doc_id", r"^[A-Z][a-z]+ ").select("doc_id", F.col("line").cast("long").alias("line"), F.col("next_line").cast("long").alias("next_line")), """WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS text, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM documents),
e AS (SELECT doc_id, max(line) AS last FROM l GROUP BY 1) SELECT doc_id, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line), last + 1) AS next_line FROM l JOIN e USING (doc_id) WHERE regexp_matches(text, '^[A-Z][a-z]+ ')""")
_add("longest_per_key", lambda s, d: verify.first_rows(table(s, d, "documents"), ["source"], [F.desc(F.length("text")), F.col("doc_id")]).select("source", "doc_id", F.length("text").cast("long").alias("length")), "SELECT source, doc_id, length(text) AS length FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
_add("slugs", lambda s, d: table(s, d, "part").select("p_partkey", text.slugify(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(") & "), "p_name")).alias("slug"), text.truncated(F.col("p_name"), 12).alias("short")), "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' (' || p_brand || ') & ' || p_name), '\\([^)]*\\)', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(p_name) > 12 THEN substring(p_name, 1, 9) || '...' ELSE p_name END AS short FROM part")
_add("event_properties", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
_add("running_ids", lambda s, d: table(s, d, "supplier").select("s_suppkey", F.format_string("n%s-E%02d", F.col("s_nationkey"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).alias("id")), "SELECT s_suppkey, printf('n%d-E%02d', s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS id FROM supplier")


# Node constructors, summaries and units against each other
_CORE = "core:framework/"
_add(
    "framework_nodes",
    lambda s, d: nodes.framework_nodes(table(s, d, "region").selectExpr("concat('r', r_regionkey) AS framework_id", "r_name AS name", "CASE WHEN r_regionkey = 1 THEN 'US' END AS jurisdiction"), "nice").select("id", F.array_join("types", " ").alias("types"), "name", "jurisdiction", "part_of"),
    f"SELECT '{_CORE}r' || r_regionkey AS id, 'nice:Framework core:Framework' AS types, r_name AS name, CASE WHEN r_regionkey = 1 THEN 'US' END AS jurisdiction, NULL::VARCHAR AS part_of FROM region",
)


def _unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("nice:c"), "c_custkey"))).alias("has_element"))
    nation = table(spark, sf_dir, "nation").join(held, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return nation.selectExpr("concat('n', n_nationkey) AS unit_id", "n_name AS name", "concat('r', n_regionkey) AS framework_id", "has_element")


def _unit_nodes(made: DataFrame) -> DataFrame:
    return made.select("id", F.array_join("types", " ").alias("types"), "name", "part_of", F.size("has_element").cast("long").alias("n_elements"), F.md5(F.array_join("has_element", " ").cast("binary")).alias("elements_md5"))


_UNIT_SQL = """SELECT 'nice:n' || n_nationkey AS id, '{types}' AS types, n_name AS name, 'core:framework/r' || n_regionkey AS part_of, e.n AS n_elements, e.h AS elements_md5 FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n, md5(string_agg('nice:c' || c_custkey, ' ' ORDER BY 'nice:c' || c_custkey)) AS h FROM customer GROUP BY 1) e ON e.c_nationkey = n_nationkey"""
_add("unit_nodes", lambda s, d: _unit_nodes(nodes.unit_nodes(_unit_rows(s, d), "nice", "Area")), _UNIT_SQL.format(types="nice:Area core:OrganizingUnit"))
_add("role_nodes", lambda s, d: _unit_nodes(nodes.role_nodes(_unit_rows(s, d), "nice")), _UNIT_SQL.format(types="nice:WorkRole core:Role core:OrganizingUnit"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("concat('nice:o', l_orderkey) AS parent_id", "l_linenumber AS ordinal", "l_returnflag AS text").distinct()


_CHILD_SQL = "SELECT DISTINCT 'nice:o' || l_orderkey || '.{kind}.' || l_linenumber AS id, '{types}' AS types, l_returnflag AS element_text, 'core:framework/nice-v2' AS part_of, {elaborates} AS elaborates FROM lineitem"
_add("subpoint_nodes", lambda s, d: nodes.subpoint_nodes(_children(s, d), "nice", "nice-v2", "Step").select("id", F.array_join("types", " ").alias("types"), "element_text", "part_of", "elaborates"), _CHILD_SQL.format(kind="sub", types="nice:Step core:Subpoint core:RoleElement", elaborates="'nice:o' || l_orderkey"))
_add("example_nodes", lambda s, d: nodes.example_nodes(_children(s, d), "nice-v2").select("id", F.array_join("types", " ").alias("types"), "element_text", "part_of", "elaborates"), _CHILD_SQL.format(kind="example", types="core:Example core:RoleElement", elaborates="NULL::VARCHAR"))
_add("density_spread", lambda s, d: analyses.density_spread(_summary(s, d)), f"WITH {testbed.CTES}{_SUMMARY} SELECT * EXCLUDE (license) FROM summary ORDER BY elements_per_organizing_unit_with_examples DESC, framework_slug")
_add("summary_faults", lambda s, d: analyses.summary_faults(_summary(s, d).withColumn("example_count", F.col("example_count") + (F.col("framework_slug") == "r1").cast("long"))), f"WITH {testbed.CTES}{_SUMMARY} SELECT * REPLACE (example_count + 1 AS example_count) FROM summary WHERE framework_slug = 'r1'")
_on_graph(
    "align_units",
    lambda g: similarity.align_units(g, "^AMERICA$", "^(ASIA|EUROPE)$").withColumn("rank", F.col("rank").cast("long")),
    f""", words AS (SELECT unit, any_value(unit_name) AS unit_name, any_value(framework_name) AS framework_name, string_agg(txt, ' ') AS doc FROM (SELECT unit, unit_name, framework_name, unit_name AS txt FROM unit
UNION ALL SELECT unit, unit_name, framework_name, x.o FROM unit JOIN he ON he.role = unit JOIN t x ON x.s = he.element AND x.p = 'elementText') GROUP BY unit),
toks AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(doc), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)}))) AS ts FROM words),
pr AS (SELECT a.unit AS left_id, a.unit_name AS left_name, b.unit AS right_id, b.unit_name AS right_name, len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) AS sim FROM toks a, toks b
 WHERE a.framework_name = 'AMERICA' AND b.framework_name IN ('ASIA', 'EUROPE'))
SELECT left_id, left_name, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS rank, right_id, right_name, round_even(sim, 3) AS similarity FROM pr QUALIFY rank <= 3""",
)


def _names(spark: SparkSession, sf_dir: str, name: str, key: str, column: str, side: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias(f"{side}_id"), text.tokens(F.col(column)).alias(f"{side}_tokens"))


_add(
    "all_pairs",
    lambda s, d: similarity.all_pairs(_names(s, d, "region", "r_regionkey", "r_name", "left"), _names(s, d, "nation", "n_nationkey", "n_name", "right")),
    f"""WITH l AS (SELECT r_regionkey AS left_id, list_distinct(list_filter(regexp_split_to_array(lower(r_name), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS a FROM region),
r AS (SELECT n_nationkey AS right_id, list_distinct(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS b FROM nation)
SELECT left_id, right_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0.0 END AS similarity FROM l, r""",
)
_add("token_stats", lambda s, d: similarity.token_stats(table(s, d, "documents").select(F.col("source").alias("side"), text.tokens(F.col("text")).alias("tokens"))), _TOKENS.split(",\ndt AS")[0] + " SELECT source AS side, count(*) AS n_units, median(len(lt)) AS median_tokens, max(len(lt)) AS max_tokens FROM d JOIN documents ON doc_id = left_id GROUP BY 1")
_PARENT = "array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 1, 30), ' ')"


def _two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first words as parents' own texts, whole documents as those with their children's."""
    docs = table(spark, sf_dir, "documents")
    right = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("right_id"), text.tokens(F.col("text")).alias("right_tokens"))
    own = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 30), " ")
    passes = [similarity.best_matches(docs.select(F.col("doc_id").alias("left_id"), text.tokens(c).alias("left_tokens")), right, 1).drop("rank") for c in (own, F.col("text"))]
    return similarity.two_pass_alignment(*passes)


_TWO = f"""WITH b AS (SELECT 'b' || item_id AS right_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS rt FROM benchmark),
d AS (SELECT doc_id AS left_id, unnest(['parent', 'full']) AS pass, unnest([{_PARENT}, coalesce(text, '')]) AS t FROM documents),
e AS (SELECT left_id, pass, list_distinct(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS lt FROM d),
dt AS (SELECT left_id, pass, len(lt) AS na, unnest(lt) AS token FROM e), bt AS (SELECT right_id, len(rt) AS nb, unnest(rt) AS token FROM b),
pr AS (SELECT left_id, pass, right_id, count(*) / (any_value(na) + any_value(nb) - count(*)) AS sim FROM dt JOIN bt USING (token) GROUP BY ALL),
best AS (SELECT left_id, pass, right_id, round_even(sim, 3) AS similarity FROM pr QUALIFY row_number() OVER (PARTITION BY left_id, pass ORDER BY sim DESC, right_id) = 1),
two AS (SELECT coalesce(p.left_id, f.left_id) AS left_id, p.right_id AS parent_match, coalesce(p.similarity, 0) AS parent_similarity, f.right_id AS full_match, coalesce(f.similarity, 0) AS full_similarity
 FROM (SELECT * FROM best WHERE pass = 'parent') p FULL JOIN (SELECT * FROM best WHERE pass = 'full') f ON p.left_id = f.left_id),
tiered AS (SELECT *, round_even(full_similarity - parent_similarity, 3) AS delta, {_TIER.replace("similarity", "parent_similarity")} AS parent_tier, {_TIER.replace("similarity", "full_similarity")} AS full_tier FROM two)"""
_add("two_pass_alignment", _two_passes, f"{_TWO} SELECT * FROM tiered")
_add("tier_counts", lambda s, d: similarity.tier_counts(_two_passes(s, d)), f"{_TWO} SELECT tier, (SELECT count(*) FROM tiered WHERE parent_tier = tier) AS n_parent, (SELECT count(*) FROM tiered WHERE full_tier = tier) AS n_full FROM (SELECT unnest(['strong', 'moderate', 'weak', 'none']) AS tier)")



def _lines_graph(spark: SparkSession, sf_dir: str, lang: str | None = None) -> PartitionedGraph:
    """Languages as frameworks, sources as units, documents as standards with their first line as text and the others as children.
    With a language, the graph of that framework: no unit or document is in two of them."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("e"), *(F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")), F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    docs = docs if lang is None else docs.where(F.col("lang") == lang)
    docs = docs.withColumns({"f": F.concat(F.lit("f"), "lang"), "u": F.concat_ws("/", "lang", "source")})
    lines = docs.select("e", F.posexplode("ls").alias("k", "l")).withColumn("c", F.concat_ws(".", "e", "k"))
    kids = lines.where("k > 0")

    def triples(df: DataFrame, s: str, p: str, o: str, literal: bool = False) -> tuple[str, str | None, DataFrame]:
        value = expand(o) if ":" in o else None
        return expand(p), value, df.select(F.col(s).alias("s"), F.lit(expand(p)).alias("p"), (F.lit(value) if value else F.col(o)).alias("o"), F.lit("literal" if literal else "iri").alias("o_kind"))

    frameworks, units = docs.select("f", "lang").distinct(), docs.select("u", "f", "source").distinct()
    return PartitionedGraph([
        triples(frameworks, "f", "a", "core:Framework"), triples(frameworks, "f", "schema:name", "lang", True), triples(units, "u", "a", "core:OrganizingUnit"), triples(units, "u", "schema:name", "source", True),
        triples(units, "u", "core:partOf", "f"), triples(docs, "u", "core:hasElement", "e"), triples(docs, "e", "a", "cyberorg:Standard"), triples(lines.where("k = 0"), "e", "core:elementText", "l", True),
        triples(kids, "e", "core:hasElement", "c"), triples(kids, "c", "core:elementText", "l", True),
    ])


_DOCS = """d AS (SELECT 'd' || doc_id AS element, coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS unit, coalesce(source, 'none') AS unit_name, coalesce(lang, 'none') AS lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
doc AS (SELECT element, unit, unit_name, lang, ls[1] AS text, ls[1] || ' ' || coalesce(array_to_string(list_sort(ls[2:]), ' '), '') AS full_text FROM d)"""
_add("parent_documents", lambda s, d: similarity.parent_documents(_lines_graph(s, d), "cyberorg:Standard", "."), f"WITH {_DOCS} SELECT element, unit, unit_name, text, full_text FROM doc")
_add(
    "align_parents",
    lambda s, d: similarity.align_parents(*(similarity.parent_documents(_lines_graph(s, d, lang), "cyberorg:Standard", f"^{lang}$").cache() for lang in ("en", "de")), text.STOP_WORDS),
    f"""WITH {_DOCS},
tok AS MATERIALIZED (SELECT element, lang, pass, list_distinct(list_filter(regexp_split_to_array(lower(CASE pass WHEN 'parent' THEN text ELSE full_text END), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS ts FROM doc, (SELECT unnest(['parent', 'full']) AS pass) WHERE lang IN ('en', 'de')),
words AS (SELECT element, lang, pass, len(ts) AS n, unnest(ts) AS w FROM tok),
pr AS (SELECT a.pass, a.element AS left_id, b.element AS right_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim FROM words a JOIN words b ON a.w = b.w AND a.pass = b.pass WHERE a.lang = 'en' AND b.lang = 'de' GROUP BY 1, 2, 3),
top AS (SELECT pass, left_id, right_id, sim FROM pr QUALIFY row_number() OVER (PARTITION BY pass, left_id ORDER BY sim DESC, right_id) = 1),
best AS (SELECT t.element AS left_id, t.pass, coalesce(right_id, (SELECT min(element) FROM doc WHERE lang = 'de')) AS right_id, round_even(coalesce(sim, 0), 3) AS similarity FROM tok t LEFT JOIN top ON top.left_id = t.element AND top.pass = t.pass WHERE t.lang = 'en')
SELECT l.element AS left_id, l.unit_name AS left_unit, l.text AS left_text, p.right_id AS parent_match, pd.unit_name AS parent_unit, pd.text AS parent_text, p.similarity AS parent_similarity, {_TIER.replace("similarity", "p.similarity")} AS parent_tier,
 f.right_id AS full_match, fd.unit_name AS full_unit, fd.text AS full_text, f.similarity AS full_similarity, {_TIER.replace("similarity", "f.similarity")} AS full_tier, round_even(f.similarity - p.similarity, 3) AS delta
FROM doc l JOIN best p ON p.left_id = l.element AND p.pass = 'parent' JOIN best f ON f.left_id = l.element AND f.pass = 'full' LEFT JOIN doc pd ON pd.element = p.right_id LEFT JOIN doc fd ON fd.element = f.right_id WHERE l.lang = 'en'""",
)


def _staged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a framework whose tables are some of the driver's; levels aren't staged."""
    tables = {"standards": table(spark, sf_dir, "part").withColumnRenamed("p_type", "concept"), "clusters": table(spark, sf_dir, "supplier")}
    return staged.framework_metrics(spark, staged.STAGED["csta"], tables)


_add("framework_metrics", _staged_metrics, "SELECT 'standards_count' AS metric, count(*)::DOUBLE AS value FROM part UNION ALL SELECT 'concepts', (count(DISTINCT p_type) + max((p_type IS NULL)::INT))::DOUBLE FROM part UNION ALL SELECT 'clusters_count', count(*)::DOUBLE FROM supplier")

# Checks and counts
_add("severity_counts", lambda s, d: verify.severity_counts(_references(s, d)), f"SELECT severity, count(*) AS n FROM ({_SQL['referential_integrity']}) GROUP BY 1")
_add("distinct_metrics", lambda s, d: verify.metrics(table(s, d, "orders").withColumn("k", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))), rows=F.count("*"), kinds=verify.distinct("k"), customers=verify.distinct("o_custkey")), """SELECT unnest(['rows', 'kinds', 'customers']) AS metric, unnest([n, k, c]) AS value FROM (
SELECT count(*)::DOUBLE AS n, (count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END) + max((o_orderstatus = 'P')::INT))::DOUBLE AS k, count(DISTINCT o_custkey)::DOUBLE AS c FROM orders)""")
_add("named_counts", lambda s, d: verify.named_counts(table(s, d, "orders"), "o_orderstatus").select(F.to_json("counts").alias("counts")), "SELECT '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS counts FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)")
_add("kebab_names", lambda s, d: ingest.kebab_names(table(s, d, "part").selectExpr("p_partkey", "replace(initcap(p_name), ' ', '') AS name"), "name"), """SELECT p_partkey, lower(regexp_replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ''), '([a-z])([A-Z])', '\\1-\\2', 'g')) AS name FROM part""")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
