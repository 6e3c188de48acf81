"""A graph over the driver's tables: regions are frameworks, nations units, customers elements, orders their children.

| graph | table | rule |
| Framework | region | metadata by key; one sector is missing |
| OrganizingUnit | nation | part of its region; nation 23 points at no framework, nation 24 at nothing; a Role if n_regionkey < 3 |
| RoleElement | customer | part of its nation's region, element of its nation; text unless c_custkey ends in 0 |
| Subpoint | orders, status F | elaborates the customer, element of the nation, part of the region |
| Example | orders, status O | hasExample from the customer, part of the region |
| RoleElement only | other orders | |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PartitionedGraph
from ..namespaces import expand

BASE = "http://testbed.example/"
JURISDICTION = {0: "AF", 1: "US", 2: "AS", 3: "EU", 4: "US"}
SECTOR = {0: "civilian", 1: "civilian", 2: "defence", 3: "general"}
SPECIFICITY = {0: "general-IT", 1: "cybersecurity-specific", 2: "general-IT", 3: "general-IT", 4: "education"}
PARTS = """CASE p_partkey % 6
  WHEN 0 THEN concat('Stock ', p_type, ' parts such as ', replace(p_name,' ',' core, '), ' kit, and ', p_brand, ' spares.')
  WHEN 1 THEN concat('Store ', p_name, '. Clarification statement: Focus on examples such as keep dry; label ', p_brand, '; and log size ', p_size, '.')
  WHEN 2 THEN concat('Inspect ', p_name, '; record ', p_brand, '; archive ', p_type)
  WHEN 3 THEN concat('Maintains ', p_name, ' inventory.')
  WHEN 4 THEN concat('Covers tools, e.g. ', p_name, ', ', p_brand)
  ELSE concat('Handles materials including ', p_name, ' or ', p_brand, '. Reviews ', p_type, ' yearly.') END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: sentences that reach every branch of the fragment parser."""
    return table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) AS id", f"{PARTS} AS text")


def _chosen(key: Column, values: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def graph(spark: SparkSession, sf_dir: str) -> PartitionedGraph:
    """One select a predicate, so that a pattern with a fixed predicate prunes to the branches that have it.

    Keys are unique in their tables, so the triples are a set by construction and no shuffle has to make them one.
    """
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    fw, unit = F.concat(F.lit(f"{BASE}framework/r"), F.col("r_regionkey")), F.concat(F.lit(f"{BASE}unit/n"), F.col("n_nationkey"))
    region_of = F.concat(F.lit(f"{BASE}framework/r"), F.col("n_regionkey"))
    element = F.concat(F.lit(f"{BASE}element/c"), F.col("c_custkey"))
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ordered = orders.join(located, F.col("o_custkey") == F.col("c_custkey"))
    sub, example = (F.concat(element, F.lit(f".{k}."), F.col("o_orderkey")) for k in ("sub", "example"))
    points, examples, others = (ordered.where(w) for w in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus NOT IN ('F', 'O')"))

    def triples(df: DataFrame, s: Column, p: str, o: Column | str, kind: str = "iri") -> tuple[str, str | None, DataFrame]:
        value = F.lit(expand(o)) if isinstance(o, str) else o
        out = df.select(s.alias("s"), F.lit(expand(p)).alias("p"), value.alias("o"), F.lit(kind).alias("o_kind"), *(F.lit(None).cast("string").alias(c) for c in ("o_datatype", "o_lang")), F.lit("testbed").alias("source"))
        return expand(p), expand(o) if isinstance(o, str) else None, out.where("o IS NOT NULL")

    parts = [
        triples(region, fw, "a", "core:Framework"),
        triples(region, fw, "schema:name", F.col("r_name"), "literal"),
        *(triples(region, fw, f"core:{p}", _chosen(F.col("r_regionkey"), v), "literal") for p, v in (("jurisdiction", JURISDICTION), ("sector", SECTOR), ("specificity", SPECIFICITY))),
        triples(nation, unit, "a", "core:OrganizingUnit"),
        triples(nation.where("n_regionkey < 3"), unit, "a", "core:Role"),
        triples(nation, unit, "schema:name", F.col("n_name"), "literal"),
        triples(nation.where("n_nationkey < 23"), unit, "core:partOf", region_of),
        triples(nation.where("n_nationkey = 23"), unit, "core:partOf", F.lit(f"{BASE}elsewhere")),
        triples(customer, element, "a", "core:RoleElement"),
        triples(located, element, "core:partOf", region_of),
        triples(located, unit, "core:hasElement", element),
        triples(customer.where("c_custkey % 10 <> 0"), element, "core:elementText", F.col("c_name"), "literal"),
        *(triples(points, sub, "a", f"core:{t}") for t in ("RoleElement", "Subpoint")),
        triples(points, sub, "core:elaborates", element),
        triples(points, sub, "core:partOf", region_of),
        triples(points, unit, "core:hasElement", sub),
        *(triples(examples, example, "a", f"core:{t}") for t in ("RoleElement", "Example")),
        triples(examples, example, "core:partOf", region_of),
        triples(examples, element, "core:hasExample", example),
        triples(others, F.concat(F.lit(f"{BASE}element/o"), F.col("o_orderkey")), "a", "core:RoleElement"),
    ]
    return PartitionedGraph(parts)


def _case(key: str, values: dict[int, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


#: The same graph as DuckDB CTEs: t(s, p, o) with short predicates, and the bindings' views.
CTES = f"""
located AS (SELECT c_custkey, c_name, n_nationkey, '{BASE}framework/r' || n_regionkey AS r, '{BASE}unit/n' || n_nationkey AS u, '{BASE}element/c' || c_custkey AS e
            FROM customer JOIN nation ON c_nationkey = n_nationkey),
ordered AS (SELECT o_orderkey, o_orderstatus, located.* FROM orders JOIN located ON o_custkey = c_custkey),
t AS MATERIALIZED (
  SELECT '{BASE}framework/r' || r_regionkey AS s, 'a' AS p, 'Framework' AS o FROM region
  UNION ALL SELECT '{BASE}framework/r' || r_regionkey, 'name', r_name FROM region
  UNION ALL SELECT '{BASE}framework/r' || r_regionkey, 'jurisdiction', {_case("r_regionkey", JURISDICTION)} FROM region
  UNION ALL SELECT '{BASE}framework/r' || r_regionkey, 'sector', {_case("r_regionkey", SECTOR)} FROM region WHERE r_regionkey <> 4
  UNION ALL SELECT '{BASE}framework/r' || r_regionkey, 'specificity', {_case("r_regionkey", SPECIFICITY)} FROM region
  UNION ALL SELECT '{BASE}unit/n' || n_nationkey, 'a', 'OrganizingUnit' FROM nation
  UNION ALL SELECT '{BASE}unit/n' || n_nationkey, 'a', 'Role' FROM nation WHERE n_regionkey < 3
  UNION ALL SELECT '{BASE}unit/n' || n_nationkey, 'name', n_name FROM nation
  UNION ALL SELECT '{BASE}unit/n' || n_nationkey, 'partOf', '{BASE}framework/r' || n_regionkey FROM nation WHERE n_nationkey < 23
  UNION ALL SELECT '{BASE}unit/n' || n_nationkey, 'partOf', '{BASE}elsewhere' FROM nation WHERE n_nationkey = 23
  UNION ALL SELECT '{BASE}element/c' || c_custkey, 'a', 'RoleElement' FROM customer
  UNION ALL SELECT e, 'partOf', r FROM located
  UNION ALL SELECT u, 'hasElement', e FROM located
  UNION ALL SELECT '{BASE}element/c' || c_custkey, 'elementText', c_name FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT e || '.sub.' || o_orderkey, unnest(['a', 'a']), unnest(['RoleElement', 'Subpoint']) FROM ordered WHERE o_orderstatus = 'F'
  UNION ALL SELECT e || '.sub.' || o_orderkey, 'elaborates', e FROM ordered WHERE o_orderstatus = 'F'
  UNION ALL SELECT e || '.sub.' || o_orderkey, 'partOf', r FROM ordered WHERE o_orderstatus = 'F'
  UNION ALL SELECT u, 'hasElement', e || '.sub.' || o_orderkey FROM ordered WHERE o_orderstatus = 'F'
  UNION ALL SELECT e || '.example.' || o_orderkey, unnest(['a', 'a']), unnest(['RoleElement', 'Example']) FROM ordered WHERE o_orderstatus = 'O'
  UNION ALL SELECT e || '.example.' || o_orderkey, 'partOf', r FROM ordered WHERE o_orderstatus = 'O'
  UNION ALL SELECT e, 'hasExample', e || '.example.' || o_orderkey FROM ordered WHERE o_orderstatus = 'O'
  UNION ALL SELECT '{BASE}element/o' || o_orderkey, 'a', 'RoleElement' FROM ordered WHERE o_orderstatus NOT IN ('F', 'O')),
fw AS (SELECT s AS framework FROM t WHERE p = 'a' AND o = 'Framework'),
nm AS (SELECT s, o AS name FROM t WHERE p = 'name'),
po AS MATERIALIZED (SELECT s, o AS framework FROM t SEMI JOIN fw ON fw.framework = t.o WHERE p = 'partOf'),
meta AS (SELECT framework, nm.name, j.o AS jurisdiction, k.o AS sector, c.o AS specificity FROM fw LEFT JOIN nm ON nm.s = framework
         LEFT JOIN t j ON j.s = framework AND j.p = 'jurisdiction' LEFT JOIN t k ON k.s = framework AND k.p = 'sector' LEFT JOIN t c ON c.s = framework AND c.p = 'specificity'),
unit AS (SELECT x.s AS unit, po.framework, un.name AS unit_name, fn.name AS framework_name FROM t x JOIN po ON po.s = x.s LEFT JOIN nm un ON un.s = x.s LEFT JOIN nm fn ON fn.s = po.framework
         WHERE x.p = 'a' AND x.o = 'OrganizingUnit'),
role AS (SELECT x.s AS role, po.framework, un.name AS role_name, fn.name AS framework_name FROM t x JOIN po ON po.s = x.s LEFT JOIN nm un ON un.s = x.s LEFT JOIN nm fn ON fn.s = po.framework
         WHERE x.p = 'a' AND x.o = 'Role'),
element AS MATERIALIZED (SELECT x.s AS element, po.framework, fn.name AS framework_name FROM t x JOIN po ON po.s = x.s LEFT JOIN nm fn ON fn.s = po.framework WHERE x.p = 'a' AND x.o = 'RoleElement'),
example AS MATERIALIZED (SELECT x.s AS example, po.framework, fn.name AS framework_name FROM t x JOIN po ON po.s = x.s LEFT JOIN nm fn ON fn.s = po.framework WHERE x.p = 'a' AND x.o = 'Example'),
he AS (SELECT s AS role, o AS element FROM t WHERE p = 'hasElement'),
strict AS (SELECT element.* FROM element ANTI JOIN example ON example.example = element.element),
sized AS (SELECT unit.*, n AS element_count FROM unit LEFT JOIN (SELECT role, count(*) AS n FROM he GROUP BY role) ON role = unit)"""


def sql(select: str) -> str:
    return f"WITH {CTES} {select}"
