"""Token-set similarity between the units of frameworks.

jaccard() is a column expression. all_pairs() broadcasts nothing by itself: the planner may, by size. indexed_pairs()
meets units on shared tokens instead, so pairs without one are never made; it gives the same pairs above zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nearest
from ..functions.text import tokens
from ..graph import TripleGraph
from .bindings import role_element_bindings, unit_bindings


#: Fixed value: right blocks, some megabytes each, that a task holds at most.
BLOCKS = 16


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 if either has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def unit_documents(g: TripleGraph) -> DataFrame:
    """unit, framework, unit_name, framework_name, document: name, description and the texts of all children."""
    units = unit_bindings(g)
    links = g.pairs("core:hasElement").select(F.col("s").alias("unit"), F.col("o").alias("child"))
    texts = g.pairs("core:elementText").select(F.col("s").alias("child"), F.col("o").alias("text"))
    children = links.join(texts, "child").groupBy("unit").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("_children"))
    described = g.pairs("schema:description").select(F.col("s").alias("unit"), F.col("o").alias("_description"))
    return units.join(described, "unit", "left").join(children, "unit", "left").select(*units.columns, F.concat_ws(" ", "unit_name", "_description", "_children").alias("document"))


def tokenised(df: DataFrame, text: str, stop_words: list[str] | None = None) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text), stop_words))


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left: left_id, left_tokens; right: right_id, right_tokens. Every pair: for tables of framework size only."""
    return left.join(right).select("left_id", "right_id", jaccard(F.col("left_tokens"), F.col("right_tokens")).alias("similarity"))


def indexed_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of all_pairs() with a similarity over 0, by an equi-join on tokens and a count of the overlap."""
    a = left.select("left_id", F.size("left_tokens").alias("na"), F.explode("left_tokens").alias("token"))
    b = right.select("right_id", F.size("right_tokens").alias("nb"), F.explode("right_tokens").alias("token"))
    shared = a.join(b, "token").groupBy("left_id", "right_id", "na", "nb").agg(F.count("*").alias("both"))
    return shared.select("left_id", "right_id", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))


def best_matches(left: DataFrame, right: DataFrame, k: int = 3, block: int = 8192) -> DataFrame:
    """top_matches() of the pairs of indexed_pairs(), without making them: both sides are dealt into blocks, the right one into
    blocks of about so many units, every left block meets every right one, and what is handed on is the k best of a left row
    among BLOCKS right blocks. Tokens are compared by 64-bit hashes."""
    def hashed(df: DataFrame, side: str) -> DataFrame:
        return df.select(f"{side}_id", F.array_distinct(F.transform(f"{side}_tokens", lambda w: F.xxhash64(w))).alias("_set")).where(F.size("_set") > 0)

    ids = {side: df.schema[f"{side}_id"].dataType.simpleString() for side, df in (("left", left), ("right", right))}
    n_blocks = -(-right.count() // block) or 1
    # sorted, as a task that is repeated must make the same blocks again; dealt anew, as the cross join reads a side many times
    lefts = hashed(left, "left").sortWithinPartitions("left_id").mapInArrow(nearest.packed, f"ids array<{ids['left']}>, block binary")
    rights = hashed(right, "right").repartition(n_blocks).mapInArrow(nearest.indexed, f"ids array<{ids['right']}>, block binary").repartition(-(-n_blocks // BLOCKS))
    lefts = lefts.repartition(2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = lefts.select(F.col("ids").alias("left_ids"), F.col("block").alias("left")).crossJoin(rights.select(F.col("ids").alias("right_ids"), F.col("block").alias("right")))
    return top_matches(met.mapInArrow(nearest.nearest(k), f"left_id {ids['left']}, right_id {ids['right']}, similarity double"), k)


def top_matches(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k best of each left_id with their rank; equal ones in order of right_id."""
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Tiers from the strongest down: least similarity and name.
TIERS = [(0.30, "strong"), (0.20, "moderate"), (0.10, "weak")]


def tier(similarity: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(TIERS):
        out = F.when(similarity >= least, name).otherwise(out)
    return out


def two_pass_alignment(parents: DataFrame, full: DataFrame) -> DataFrame:
    """Best matches on parents' own texts and on full documents, their tiers and the change. Both: left_id, right_id, similarity.

    Similarities are rounded to three digits before tiers and change are taken."""
    def best(pairs: DataFrame, name: str) -> DataFrame:
        return top_matches(pairs, 1).select("left_id", F.col("right_id").alias(f"{name}_match"), F.bround("similarity", 3).alias(f"{name}_similarity"))

    joined = best(parents, "parent").join(best(full, "full"), "left_id", "full")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("parent_similarity", "full_similarity")})
    return joined.withColumns({"delta": F.bround(F.col("full_similarity") - F.col("parent_similarity"), 3), "parent_tier": tier(F.col("parent_similarity")), "full_tier": tier(F.col("full_similarity"))})


def tier_counts(alignment: DataFrame) -> DataFrame:
    """tier, n_parent, n_full: the counts of both passes side by side, every tier present."""
    spark = alignment.sparkSession
    names = spark.createDataFrame([(n, k) for k, n in enumerate([*(n for _, n in TIERS), "none"])], "tier string, place int")
    for name in ("parent", "full"):
        counts = alignment.groupBy(F.col(f"{name}_tier").alias("tier")).agg(F.count("*").alias(f"n_{name}"))
        names = names.join(counts, "tier", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return names.orderBy("place").drop("place")


def token_stats(sides: DataFrame) -> DataFrame:
    """side, n_units, median_tokens, max_tokens. sides: side, tokens."""
    n = F.size("tokens")
    return sides.groupBy("side").agg(F.count("*").alias("n_units"), F.percentile(n, 0.5).alias("median_tokens"), F.max(n).cast("long").alias("max_tokens"))


def similarity_stats(best: DataFrame) -> DataFrame:
    """least, q1, median, mean, q3 and most of best-match similarities."""
    s = "similarity"
    return best.agg(F.min(s).alias("least"), F.percentile(s, 0.25).alias("q1"), F.percentile(s, 0.5).alias("median"), F.avg(s).alias("mean"), F.percentile(s, 0.75).alias("q3"), F.max(s).alias("most"))


def best_match_frequency(best: DataFrame, rights: DataFrame) -> DataFrame:
    """How often each right_id is a best match, 0 included. rights: right_id."""
    counts = best.groupBy("right_id").agg(F.count("*").alias("n"))
    return rights.select("right_id").distinct().join(counts, "right_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def align_units(g: TripleGraph, left: str, right: str, stop_words: list[str] | None = None, k: int = 3) -> DataFrame:
    """The k best units of one framework (by a pattern on its name) for each of another's: left_id, left_name, rank, right_id, right_name, similarity."""
    docs = tokenised(unit_documents(g), "document", stop_words)

    def side(pattern: str, name: str) -> DataFrame:
        return docs.where(F.col("framework_name").rlike(pattern)).select(F.col("unit").alias(f"{name}_id"), F.col("unit_name").alias(f"{name}_name"), F.col("tokens").alias(f"{name}_tokens"))

    a, b = side(left, "left"), side(right, "right")
    best = top_matches(all_pairs(a, b), k).withColumn("similarity", F.bround("similarity", 3))
    named = best.join(a.select("left_id", "left_name"), "left_id").join(b.select("right_id", "right_name"), "right_id")
    return named.select("left_id", "left_name", "rank", "right_id", "right_name", "similarity")


def parent_documents(g: TripleGraph, kind: str, units: str) -> DataFrame:
    """element, unit, unit_name, text, full_text: nodes of a type that a unit holds whose framework's name matches `units`.

    text is the node's own, full_text that with the texts of its Subpoints and Examples after it. A node without a text or
    a unit drops out; of several units or texts the least stays."""
    parents = g.subjects("a", kind).select(F.col("s").alias("element"))
    texts = g.pairs("core:elementText").select(F.col("s").alias("element"), F.col("o").alias("text"))
    links = reduce(DataFrame.unionByName, [g.pairs(f"core:{p}").select(F.col("s").alias("parent"), F.col("o").alias("element")) for p in ("hasElement", "hasExample")])
    held = links.join(parents.select(F.col("element").alias("parent")), "parent", "left_semi").join(texts, "element")
    children = held.groupBy(F.col("parent").alias("element")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("_children"))
    named = unit_bindings(g).where(F.col("framework_name").rlike(units)).select("unit", "unit_name")
    of = role_element_bindings(g).withColumnRenamed("role", "unit").join(named, "unit")
    first = parents.join(texts, "element").join(of, "element").groupBy("element").agg(F.min(F.struct("unit", "unit_name", "text")).alias("_first"))
    full = F.concat_ws(" ", "_first.text", F.coalesce("_children", F.lit("")))
    return first.join(children, "element", "left").select("element", "_first.*", full.alias("full_text"))


def align_parents(left: DataFrame, right: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Two passes over parent_documents() of both sides, on own and on full texts: for every left element its best right
    one, that one's unit and text, and the similarity in each pass, with change and tiers. Where nothing is shared the
    similarity is 0 and the match the least right element; without right elements there is none. Both sides are read several
    times: cache or write them first if they are dear to make."""
    def best(column: str) -> DataFrame:
        a, b = (tokenised(d.select(F.col("element").alias(f"{s}_id"), column), column, stop_words).withColumnRenamed("tokens", f"{s}_tokens") for s, d in (("left", left), ("right", right)))
        found = a.select("left_id").join(best_matches(a, b, 1).drop("rank"), "left_id", "left").join(least, how="left")
        return found.select("left_id", F.coalesce("right_id", "_least").alias("right_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

    least = right.agg(F.min("element").alias("_least"))
    both = two_pass_alignment(best("text"), best("full_text"))
    told = left.select(F.col("element").alias("left_id"), F.col("unit_name").alias("left_unit"), F.col("text").alias("left_text"))
    both = told.join(both, "left_id")
    for name in ("parent", "full"):
        said = right.select(F.col("element").alias(f"{name}_match"), F.col("unit_name").alias(f"{name}_unit"), F.col("text").alias(f"{name}_text"))
        both = both.join(said, f"{name}_match", "left")
    return both.select("left_id", "left_unit", "left_text", *(f"{n}_{c}" for n in ("parent", "full") for c in ("match", "unit", "text", "similarity", "tier")), "delta")
