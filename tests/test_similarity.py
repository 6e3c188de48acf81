import random
import time

from conftest import rows
from graphs import demo
from pyspark.sql import functions as F

from latticework.graph import TripleGraph
from latticework.operators import similarity as S


def test_pairs_agree(spark):
    left = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", [])], "left_id string, left_tokens array<string>")
    right = spark.createDataFrame([("p", ["x", "y", "z"]), ("q", ["y"]), ("r", [])], "right_id string, right_tokens array<string>")
    crossed = S.all_pairs(left, right)
    assert crossed.count() == 9
    assert rows(crossed.where("similarity > 0")) == rows(S.indexed_pairs(left, right))
    for k, block in ((1, 512), (2, 1), (3, 2)):
        assert rows(S.best_matches(left, right, k, block)) == rows(S.top_matches(S.indexed_pairs(left, right), k))
    best = S.top_matches(crossed, 1)
    assert {r["left_id"]: r["right_id"] for r in best.collect()} == {"a": "p", "b": "p", "c": "p"}
    assert rows(S.best_match_frequency(best, right)) == [("p", 3), ("q", 0), ("r", 0)]
    two = S.two_pass_alignment(S.indexed_pairs(left, right), crossed)
    assert {r["left_id"]: (r["parent_tier"], r["full_tier"], r["delta"]) for r in two.collect()} == {"a": ("strong", "strong", 0.0), "b": ("strong", "strong", 0.0), "c": ("none", "none", 0.0)}
    assert [tuple(r) for r in S.tier_counts(two).collect()] == [("strong", 2, 2), ("moderate", 0, 0), ("weak", 0, 0), ("none", 1, 1)]


def test_units(spark):
    d = demo(spark)
    docs = {r["unit_name"]: r["document"] for r in S.unit_documents(d).collect()}
    assert docs["u2"] == "u2 text of e3"
    assert S.align_units(d, "A$", "B$", k=3).columns == ["left_id", "left_name", "rank", "right_id", "right_name", "similarity"]
    assert S.align_units(d, "A$", "B$").select(F.max("similarity")).first()[0] == 1.0


def test_parents_with_their_children(spark):
    r = []
    for f, name in (("L", "Left set"), ("R", "Right set")):
        r += [(f"core:{f}", "a", "core:Framework", "iri"), (f"core:{f}", "schema:name", name, "literal"), (f"core:u{f}", "a", "core:OrganizingUnit", "iri"), (f"core:u{f}", "core:partOf", f"core:{f}", "iri"), (f"core:u{f}", "schema:name", f"unit {f}", "literal")]
    said = {"l1": ("L", "alpha beta"), "l2": ("L", "nothing shared"), "r1": ("R", "alpha beta gamma delta"), "r2": ("R", "zeta"), "r3": ("R", "alone"), "l3": ("L", None)}
    for e, (f, text) in said.items():
        r += [(f"core:{e}", "a", "csta:Standard" if f == "R" else "cyberorg:Standard", "iri"), (f"core:u{f}", "core:hasElement", f"core:{e}", "iri")]
        r += [(f"core:{e}", "core:elementText", text, "literal")] if text else []
    for parent, p, child, text in (("l1", "hasElement", "l1.sub.1", "zeta"), ("l1", "hasExample", "l1.example.1", "alpha"), ("r2", "hasElement", "r2.sub.1", "beta alpha")):
        r += [(f"core:{parent}", f"core:{p}", f"core:{child}", "iri"), (f"core:{child}", "core:elementText", text, "literal")]
    g = TripleGraph.from_rows(spark, r)
    left, right = S.parent_documents(g, "cyberorg:Standard", "^Left"), S.parent_documents(g, "csta:Standard", "^Right")
    assert {d["text"]: d["full_text"] for d in left.collect()} == {"alpha beta": "alpha beta alpha zeta", "nothing shared": "nothing shared "}
    assert S.parent_documents(g, "csta:Standard", "^Left").count() == 0
    got = {d["left_text"]: (d["parent_text"], d["parent_similarity"], d["parent_tier"], d["full_text"], d["full_similarity"], d["full_tier"], d["delta"]) for d in S.align_parents(left, right).collect()}
    assert got["alpha beta"] == ("alpha beta gamma delta", 0.5, "strong", "zeta", 1.0, "strong", 0.5)
    assert got["nothing shared"] == ("alpha beta gamma delta", 0.0, "none", "alpha beta gamma delta", 0.0, "none", 0.0) and len(got) == 2
    none = S.align_parents(left, right.limit(0)).collect()
    assert [(d["parent_match"], d["full_similarity"]) for d in none] == [(None, 0.0)] * 2


def test_best_matches_by_blocks(spark):
    """Copies, sets without tokens and ties on both sides, in one block and in many; more tokens than the mask has bits."""
    rnd = random.Random(5)

    def sets(n, side):
        return [(f"{side}{'é' * (i % 17 == 0)}{i}", sorted({f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(rnd.choice([0, 1, 3, 30, 200]))})) for i in range(n)]

    right = sets(200, "r")
    left = spark.createDataFrame(sets(250, "l"), "left_id string, left_tokens array<string>").repartition(3)
    right = spark.createDataFrame(right + [(f"copy{i}", right[7][1]) for i in range(50)], "right_id string, right_tokens array<string>")
    for k in (1, 3, 400):
        want = rows(S.top_matches(S.indexed_pairs(left, right), k))
        for block in (8192, 10):
            assert rows(S.best_matches(left, right, k, block)) == want


def test_best_matches_of_many(spark):
    """24 million pairs of sets of 150 tokens are a matter of seconds; every left set has one right set of the same tokens."""
    def side(name, n, turn):
        words = F.transform(F.sequence(F.lit(0), F.lit(149)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id") % turn, i), F.lit(20_000)).cast("string")))
        return spark.range(0, n, 1, 4).select(F.col("id").alias(f"{name}_id"), F.array_distinct(words).alias(f"{name}_tokens"))

    began = time.time()
    best = S.best_matches(side("left", 6000, 4000), side("right", 4000, 4000), 1).collect()
    assert time.time() - began < 25
    assert len(best) == 6000 and all(r["right_id"] == r["left_id"] % 4000 and r["similarity"] == 1.0 for r in best)
