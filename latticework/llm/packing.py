"""Operator 7: best-fit packing of documents into sequences, online and with bounded space.

A packer keeps at most `max_open` open bins, found by a bitset keyed by free space: the lowest set bit at or above a
piece's length is the best fit. If none fits, a bin opens; if too many are open, the fullest closes.

Every task of the scan packs what it reads, with no shuffle. Bins that it leaves open (at most `max_open`) are
packed again as whole items with those of other tasks, fullest first, so the waste does not grow with the number of
tasks. Only lengths, places and checksums move, never text.

Defined cases: a null or empty text is its end id alone; null and repeated ids are kept as they are; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, scratch, written
from .encoding import END, crc, default_tokenizer, encoder

CAPACITY, MAX_OPEN, BINS_A_TASK = 2048, 1024, 20_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, offset bigint"
BIN = f"sequence_id bigint, used int, closed boolean, pieces array<struct<{PIECE}>>"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


class BestFit:
    """add(length, items) puts items into a bin; closed bins gather in `done` as (used, items)."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.mask, self.n_open = 0, 0
        self.done: list[tuple[int, list]] = []

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return found

    def add(self, length: int, items: list) -> None:
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open >= self.max_open:
                fullest = (self.mask & -self.mask).bit_length() - 1
                self.done.append((self.capacity - fullest, self._take(fullest)))
            found, free = [], self.capacity
        found += items
        free -= length
        if not free:
            self.done.append((self.capacity, found))
            return
        self.by_free[free].append(found)
        self.mask |= 1 << free
        self.n_open += 1

    def still_open(self) -> list[tuple[int, list]]:
        return [(self.capacity - free, items) for free, stack in enumerate(self.by_free) for items in stack]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def _batch(bins: list[tuple[int, list]], closed: bool, ids: Iterator[int]) -> pa.RecordBatch:
    offsets, cols = [0], [[] for _ in _NAMES]
    for _, items in bins:
        at = 0
        for item in items:
            for c, v in zip(cols, (*item, at), strict=True):
                c.append(v)
            at += item[3]
        offsets.append(len(cols[0]))
    pieces = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)
    return pa.RecordBatch.from_arrays([pa.array([next(ids) for _ in bins], pa.int64()), pa.array([u for u, _ in bins], pa.int32()), pa.array([closed] * len(bins), pa.bool_()), lists], names=["sequence_id", "used", "closed", "pieces"])


def _numbers(level: int) -> Iterator[int]:
    """Sequence numbers that no other task gives."""
    from pyspark import TaskContext

    k = (TaskContext.get().partitionId() << 36) + level
    while True:
        yield k
        k += 2


def _pack_documents(tokenizer: str, capacity: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, ids = encoder(tokenizer), BestFit(capacity, max_open), _numbers(0)
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1)), strict=True):
                all_ids = np.concatenate([body, END])
                for piece, (start, length) in enumerate(cut(len(all_ids), capacity)):
                    packer.add(length, [(doc, piece, start, length, crc(all_ids[start : start + length]))])
            if packer.done:
                yield _batch(packer.done, True, ids)
                packer.done = []
        yield _batch(packer.still_open(), False, ids)

    return run


def _pack_bins(capacity: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids = BestFit(capacity, max_open), _numbers(1)
        for batch in batches:
            for used, pieces in zip(batch.column("used").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                packer.add(used, [tuple(p[c] for c in _NAMES[:-1]) for p in pieces])
            if packer.done:
                yield _batch(packer.done, True, ids)
                packer.done = []
        yield _batch(packer.still_open(), True, ids)

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    arrow_batches(spark)
    folder = scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(rows.mapInArrow(_pack_documents(tokenizer or default_tokenizer(), capacity, max_open), BIN), folder, "first")
    left = first.where("not closed")
    tasks = 1 + left.count() // BINS_A_TASK
    again = left.select("sequence_id", "used", "closed", "pieces").repartition(tasks).sortWithinPartitions(F.desc("used"), "sequence_id").mapInArrow(_pack_bins(capacity, capacity), BIN)
    return first.where("closed").unionByName(again).select("sequence_id", F.inline("pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
