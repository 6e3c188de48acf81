"""Operator 10 (native): benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of letters and digits; shingles are five words. A document's window for an item is as many
shingles as the item has. A window that reaches SIMILARITY lacks at most a fifth of the item's shingles, so it has one of
any choice of a few more than that. Each item's choice are those that the fewest items have, so phrases that many items
share offer no pairs. One scan of the corpus meets these few hashes; only documents with a hit are looked at again, for
their own items: a running count over the places of an item's shingles leaves out windows that can't reach SIMILARITY,
whatever their order.

Each distinct window is fingerprinted once, however many documents have it, and a multi-index finds the items of its size
within RADIUS bits: over BLOCKS blocks, RADIUS differing bits leave some block with at most RADIUS // BLOCKS differing, so
the index holds each item's blocks with up to that many bits flipped and every fingerprint within the radius is met.
Candidates are verified exactly by weighted Jaccard similarity (a shingle weighs its number of occurrences). At similarity
0.8 fingerprints differ by 10 bits on average (deviation 3), so a radius of 15 loses few windows at the threshold and
practically none above 0.85.

The scan's hashes are broadcast, BLOCK_SHINGLES at a time: a benchmark with more of them costs another scan. Equal items
are one. No text moves but those with a hit.

Defined cases: null and blank texts and items of fewer than five words match nothing; a null doc_id or item_id is kept
as null; repeated rows give the same match once; an empty table, either one, gives no rows; other columns, whatever their
names, are ignored by matches() and carried by without_benchmark().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, documents, keyed, scratch, small, whole, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 8
BLOCK_SHINGLES = 1_000_000
_BITS = 64 // BLOCKS
_LANES = 0x0000000100000001
_ITEM, _SEEN = ["g1", "g2"], ["m", "w1", "w2"]


def _shingles(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the hashes of a text's shingles. A hash of five words is made of those of four and one, and so on down: columns of
    their own, so that none is computed twice."""
    df = df.withColumn("_ws", _shingles(F.col(text))).withColumn("_g1", F.transform("_ws", lambda w: F.xxhash64(w)))
    for step, (first, second, made) in ((1, ("_g1", "_g1", "_g2")), (2, ("_g2", "_g2", "_g4")), (4, ("_g4", "_g1", out))):
        n = F.size(second) - step
        joined = F.zip_with(F.slice(first, 1, n), F.slice(second, 1 + step, n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(made, F.when(n > 0, joined).otherwise(F.array().cast("array<bigint>")))
    return df.drop("_ws", "_g1", "_g2", "_g4")


def _simhash(hashes: Column) -> Column:
    """Bit k is set if over half the hashes have it. Two counters of 32 bits share a sum."""
    zero, half = F.lit(0).cast("long"), F.size(hashes)
    counts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(hashes, zero, lambda a, h: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_LANES))))

    def bit(a: Column, s: Column) -> Column:
        low = F.when(s["c"].bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), s["k"])).otherwise(zero)
        high = F.when(F.shiftrightunsigned(s["c"], 32) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), s["k"] + 32)).otherwise(zero)
        return a.bitwiseOR(low).bitwiseOR(high)

    return F.aggregate(F.transform(counts, lambda c, k: F.struct(c.alias("c"), k.alias("k"))), zero, bit)


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays as multisets."""

    def times(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, _BITS * k).bitwiseAND(F.lit((1 << _BITS) - 1))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, its shingles, their number m and the key of the content."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = _hashed(rows, "text", "item_hashes").drop("text").where(F.size("item_hashes") > 0)
    return rows.withColumns({"m": F.size("item_hashes"), "g1": F.xxhash64("item_hashes"), "g2": F.hash("item_hashes").cast("long")})


def _choice(items: DataFrame) -> DataFrame:
    """Of each item, hashes h of which any window that reaches SIMILARITY has one: all others together are too few."""
    each = items.select(*_ITEM, "m", F.explode("item_hashes").alias("h")).groupBy(*_ITEM, "m", "h").agg(F.count("*").alias("n"))
    each = each.join(each.groupBy("h").agg(F.count("*").alias("n_items")), "h")
    order = Window.partitionBy(*_ITEM).orderBy("n_items", "h").rowsBetween(Window.unboundedPreceding, -1)
    spare = F.col("m") - F.ceil(F.col("m") * SIMILARITY - 1e-9)
    return each.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") <= spare).select("h", *_ITEM)


def _index(items: DataFrame) -> DataFrame:
    """Each item's fingerprint, by its size, block and block value with up to RADIUS // BLOCKS bits flipped."""
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << _BITS) - 1)), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)

    def flipped(k: int) -> Column:
        return F.transform(flips, lambda m: F.struct(F.lit(k).alias("b"), _block(F.col("item_fp"), k).bitwiseXOR(m.cast("long")).alias("v")))

    keys = F.flatten(F.array(*map(flipped, range(BLOCKS))))
    return items.withColumn("item_fp", _simhash(F.col("item_hashes"))).select("m", *_ITEM, "item_fp", F.inline(keys))


def _starts(places: Column, n: Column, m: Column) -> Column:
    """Of the sorted places of an item's shingles in a text of n: starts of windows of m that can reach SIMILARITY.

    A window that starts beside a hit is no better than the next one, which gives up nothing and may gain a hit: only hits and
    the last window need a look. From SIMILARITY up a window holds `least` of the item's shingles, so its first hit and the
    hit `least` - 1 later lie within it."""
    last = F.greatest(F.lit(0), n - m)
    least = F.ceil((F.least(n, m) + m) * SIMILARITY / (1 + SIMILARITY) - 1e-9).cast("int")
    within = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + least - 1) < p + m, F.lit(False)))
    ending = F.when(F.coalesce(F.get(places, F.size(places) - least) >= last, F.lit(False)), F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.transform(within, lambda p: F.least(p, last)), ending))


def _candidates(rows: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """KEY and the content key of items of which the row has a chosen shingle."""
    choice = written(_choice(items), folder, "choice")
    parts = -(-choice.count() // BLOCK_SHINGLES) or 1
    # outer: else a filter on the array's size would hash the text twice
    hashes = _hashed(rows, "text", "hs").select(*KEY, F.explode_outer("hs").alias("h"))
    found = [hashes.join(F.broadcast(choice.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k)), "h").select(*KEY, *_ITEM).distinct() for k in range(parts)]
    return written(reduce(DataFrame.unionByName, found).distinct(), folder, "candidates")


def _windows(rows: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """doc_id, KEY, m, the window's hashes and their key, for each window that holds enough of an item's shingles. A row's items are
    gathered beside its text's hashes, which are never copied for each."""
    found = _candidates(rows, items, folder)
    held = found.join(small(items.select(*_ITEM, "m", "item_hashes"), 20_000), _ITEM)
    held = held.groupBy(*KEY).agg(F.collect_list(F.struct("m", "item_hashes")).alias("held"))
    texts = rows.join(small(found.select(*KEY).distinct()), KEY, "left_semi").dropDuplicates(["doc_id", *KEY])
    texts = _hashed(texts.join(held, KEY), "text", "hs").drop("text").withColumn("all", F.sequence(F.lit(0), F.greatest(F.size("hs") - 1, F.lit(0))))

    def starts(item: Column) -> Column:
        places = F.filter("all", lambda i: F.coalesce(F.array_contains(item["item_hashes"], F.get("hs", i)), F.lit(False)))
        # the places are bound by a one-entry array, as each use of an expression in a lambda's body computes it again
        return F.flatten(F.transform(F.array(places), lambda own: F.transform(_starts(own, F.size("hs"), item["m"]), lambda at: F.struct(at.alias("at"), item["m"].alias("m")))))

    texts = texts.withColumn("starts", F.array_distinct(F.flatten(F.transform("held", starts))))
    own = F.transform("starts", lambda x: F.struct(x["m"].alias("m"), F.slice("hs", x["at"] + 1, x["m"]).alias("own")))
    seen = texts.select("doc_id", *KEY, F.inline(F.array_distinct(own)))
    return written(seen.withColumns({"w1": F.xxhash64("own"), "w2": F.hash("own").cast("long")}), folder, "windows")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, KEY, item_id, similarity: the best window of each document and item, from SIMILARITY up."""
    folder = scratch(docs.sparkSession)
    named = written(_items(benchmark), folder, "items")
    items = written(named.drop("item_id").dropDuplicates(_ITEM), folder, "contents")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    windows = _windows(rows, items, folder)
    distinct = written(windows.select(*_SEEN, "own").dropDuplicates(_SEEN).withColumn("fp", _simhash(F.col("own"))), folder, "distinct")
    probes = distinct.select(*_SEEN, "fp", F.inline(F.array(*(F.struct(F.lit(k).alias("b"), _block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)))))
    near = probes.join(small(written(_index(items), folder, "index")), ["m", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select(*_SEEN, *_ITEM).distinct()
    both = near.join(distinct.select(*_SEEN, "own"), _SEEN).join(small(items.select(*_ITEM, "item_hashes"), 20_000), _ITEM)
    good = both.select(*_SEEN, *_ITEM, _similarity(F.col("own"), F.col("item_hashes")).alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    found = windows.select("doc_id", *KEY, *_SEEN).join(written(good, folder, "good"), _SEEN).groupBy("doc_id", *KEY, *_ITEM).agg(F.max("similarity").alias("similarity"))
    return found.join(named.select("item_id", *_ITEM).distinct(), _ITEM).select("doc_id", *KEY, "item_id", "similarity")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that match no item, with all their columns."""
    keys = written(matches(docs, benchmark).select(*KEY).distinct(), scratch(docs.sparkSession), "found")
    return keyed(docs.select(whole(docs).alias("row"), "doc_id", "text")).join(small(keys), KEY, "left_anti").select("row.*")


def op10_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity."""
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "similarity")
