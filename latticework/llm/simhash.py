"""Operator 8: near-duplicates by SimHash, found with BK-trees.

Equal fingerprints collapse first, so a group of copies is one node whatever its size. A radius r over b > r blocks
leaves b - r blocks equal, so two linked fingerprints share the bits of at least one choice of b - r blocks: those
bits are the shard. Each shard is one BK-tree, whose children are keyed by their Hamming distance to the parent;
a search follows only the edges within the radius. The trees of many small shards are held together as one forest
in arrays, built and searched level by level.

The trees are not broadcast: together they hold every fingerprint, which grows with the corpus. Trees and probes meet
by a shuffle on the shard. A shard of more than SHARD_ROWS fingerprints is split: each part is a tree of its own that
its later parts' fingerprints also probe, so no tree is larger, and no link is lost. With more fingerprints the
shards' keys get longer (4 blocks up to FEW, then 5, then 6), which keeps shards small.

A shard gives links to the least fingerprint reached in it, never all pairs; components() joins them up.

Defined cases: a text without words has fingerprint zero and is linked like any other; a null doc_id takes part but
names no component (null if all its members' ids are null); repeated rows and ids are each returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, scratch, written
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
SHARD_ROWS, CHUNK_ROWS, FEW = 20_000, 100_000, 50_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles; a bit is set if over half the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode().lower().split()  # bytes: A-Z only, and just the six space characters
    if not ws:
        return 0
    if len(ws) <= shingle:
        return xxh64_intdigest(b" ".join(ws), SEED)
    joined, n = b" ".join(ws), len(ws) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the text's hashes _h1 and _h2 of every row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2), batch.column(3)], names=["doc_id", "fp", "_h1", "_h2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumns({"_h1": F.xxhash64("text"), "_h2": F.hash("text", F.lit(1))}).mapInArrow(run, "doc_id long, fp long, _h1 long, _h2 int")


class Forest:
    """BK-trees over distinct fingerprints, one for each run of equal shards; the first of a run is its root."""

    def __init__(self, fps: np.ndarray, shards: np.ndarray):
        self.fps, n = fps, len(fps)
        new = np.ones(n, dtype=bool)
        new[1:] = shards[1:] != shards[:-1]
        self.root = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        at, node = np.flatnonzero(~new), self.root[~new]
        keys, children = [], []
        while len(at):  # all wait at a node; the first at each edge becomes the child, the others go down to it
            edge = node * 65 + np.bitwise_count(fps[at] ^ fps[node])
            found, first, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(at[first])
            rest = np.ones(len(at), dtype=bool)
            rest[first] = False
            at, node = at[rest], at[first][back][rest]
        keys, children = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def near(self, fps: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (probe, node) within the radius: each probe searches the tree of its root."""
        for k in range(0, len(fps), 4096):
            probe, node = np.arange(k, min(k + 4096, len(fps))), roots[k : k + 4096]
            while len(probe):
                d = np.bitwise_count(fps[probe] ^ self.fps[node]).astype(np.int64)
                hit = d <= radius
                yield probe[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
                probe = np.repeat(probe, n)
                node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(probe))]


class _Groups:
    """Union-find over the places of an array, by rounds of pointing to the least."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            x, y = up[a], up[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _links(fps: np.ndarray, shards: np.ndarray, trees: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of shard, tree members first. Links (fingerprint, least one of its group within the shard)."""
    order = np.lexsort((fps.view("<i8"), ~trees, shards))
    fps, shards, trees = fps[order], shards[order], trees[order]
    member = np.flatnonzero(trees)
    forest, groups = Forest(fps[member], shards[member]), _Groups(len(fps))
    first = np.minimum(np.searchsorted(shards[member], shards), max(len(member) - 1, 0))
    probes = np.flatnonzero(shards[member][first] == shards) if len(member) else member
    for a, b in forest.near(fps[probes], first[probes], radius):
        groups.join(probes[a], member[b])
    up = groups.roots()
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, up, fps.view("<i8"))
    own, root = fps.view("<i8"), least[up]
    linked = own != root
    return own[linked], root[linked]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by shard; whole shards are searched, about CHUNK_ROWS rows at a time."""
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> pa.RecordBatch:
            fps, shards, trees = (table.column(c).to_numpy() for c in ("fp", "shard", "tree"))
            a, b = _links(fps.view("<u8"), shards, trees.astype(bool), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                shards = table.column("shard").to_numpy()
                edge = int(np.searchsorted(shards, shards[-1]))
                if edge:
                    yield found(table.slice(0, edge))
                    held = table.slice(edge).combine_chunks().to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _block(fp: Column, k: int, blocks: int) -> Column:
    low, high = 64 * k // blocks, 64 * (k + 1) // blocks
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _sharded(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """A row for each fingerprint and choice of blocks - radius blocks; the shard is a hash of the choice and its bits."""
    keys = [F.xxhash64(F.lit(k), *(_block(F.col("fp"), c, blocks) for c in choice)) for k, choice in enumerate(combinations(range(blocks), blocks - radius))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("shard"))


def link(fps: DataFrame, folder: str, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, few: int = FEW) -> DataFrame:
    """fps: distinct fingerprints (fp). Links (u, v) whose components are those of all pairs within the radius."""
    n = fps.count()
    blocks = radius + 1 + (n > few) + (n > 100 * few)
    rows = _sharded(fps, blocks, radius)
    counts = written(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows), folder, "large-shards")
    if counts.isEmpty():
        parts = rows.select("fp", "shard", F.lit(True).alias("tree"))
    else:  # a large shard's part p is a tree that parts p, p + 1, ... probe; its shard is a hash of both
        parts = rows.join(counts, "shard", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / shard_rows).cast("int"))
        parts = parts.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        parts = parts.select("fp", "shard", "parts", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p"))
        parts = parts.select("fp", F.when(F.col("parts") == 1, F.col("shard")).otherwise(F.xxhash64("shard", "p")).alias("shard"), (F.col("own") == F.col("p")).alias("tree"))
    return parts.repartition("shard").sortWithinPartitions("shard", F.desc("tree")).mapInArrow(_search(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable)."""
    return grouped(docs, radius, shingle).drop("_h1", "_h2")


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The same with _h1 and _h2, which tell rows of equal id and different texts apart."""
    folder = scratch(docs.sparkSession)
    rows = written(fingerprints(docs, shingle), folder, "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "distinct")
    found = components(link(distinct.select("fp"), folder, radius), folder)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_h1", "_h2")


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
