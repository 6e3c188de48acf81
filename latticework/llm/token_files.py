"""Operator 2: token ids in binary files of patched frame-of-reference blocks.

A file is: blocks, then a footer, then the footer's length (u64) and the magic. A block holds BLOCK ids (the last
one fewer, padded): its minimum (u32), a bit width (u8) chosen so that a given percentile of the differences fits,
the number of exceptions (u16), the packed differences, then the exceptions' places (u8) and full ids (u32).
The footer has the documents' ids, null flags and lengths and an index of the blocks' starts, so any document can
be read alone.

Defined cases: a null text is empty (its ids are the end id alone); a null doc_id sorts first and stays null;
repeated rows are kept, equal ids in order of their text; an empty table makes no files; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, scratch
from .encoding import END, crc, default_tokenizer, encoder

BLOCK, PERCENTILE, MAGIC = 256, 90, b"LWPFOR01"
_LANES = BLOCK // 64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) numbers below 2**width as (m, bytes): 64 numbers fill `width` words."""
    m, out = len(values), np.zeros((len(values) * _LANES, max(width, 1)), dtype="<u8")
    if width:
        lanes = np.ascontiguousarray(values.reshape(m * _LANES, 64).T.astype("<u8"))
        for i in range(64):
            word, off = divmod(i * width, 64)
            out[:, word] |= lanes[i] << np.uint64(off)
            if off + width > 64:
                out[:, word + 1] |= lanes[i] >> np.uint64(64 - off)
    return out[:, :width].copy().view(np.uint8).reshape(m, _LANES * width * 8)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    m = len(raw)
    if not width:
        return np.zeros((m, BLOCK), dtype="<u4")
    words = np.ascontiguousarray(raw).view("<u8").reshape(m * _LANES, width)
    out, mask = np.empty((64, m * _LANES), dtype="<u8"), np.uint64((1 << width) - 1)
    for i in range(64):
        word, off = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(off)
        if off + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - off))
        out[i] = x & mask
    return out.T.reshape(m, BLOCK).astype("<u4")


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks for a number of ids that BLOCK divides."""
    if not len(ids):
        return []
    rows = ids.reshape(-1, BLOCK).astype("<u4")
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    fits = np.partition(diff, rank, axis=1)[:, rank]
    widths = np.frompyfunc(lambda x: int(x).bit_length(), 1, 1)(fits).astype(np.int64)
    over = diff >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    n_over = over.sum(axis=1)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        packed = _pack(np.where(over[at], 0, diff[at]), int(width))
        for k, body in zip(at, packed, strict=True):
            block = int(low[k]).to_bytes(4, "little") + bytes([int(width)]) + int(n_over[k]).to_bytes(2, "little") + body.tobytes()
            if n_over[k]:
                where = np.flatnonzero(over[k])
                block += where.astype(np.uint8).tobytes() + rows[k, where].tobytes()
            out[k] = block
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at the given places of data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(starts):
        return np.zeros(0, dtype="<u4")
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4").ravel()
    widths = raw[starts + 4].astype(np.int64)
    n_over = raw[starts[:, None] + np.arange(5, 7)].copy().view("<u2").ravel().astype(np.int64)
    out = np.empty((len(starts), BLOCK), dtype="<u4")
    for width in np.unique(widths):
        at, size = np.flatnonzero(widths == width), _LANES * int(width) * 8
        body = raw[(starts[at] + 7)[:, None] + np.arange(size)]
        out[at] = _unpack(body, int(width)) + low[at][:, None]
    for k in np.flatnonzero(n_over):
        p, n = int(starts[k]) + 7 + _LANES * int(widths[k]) * 8, int(n_over[k])
        out[k, raw[p : p + n]] = raw[p + n : p + 5 * n].copy().view("<u4")
    return out.ravel()


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


class TokenFileWriter:
    """Streams documents into one file; holds less than a batch of ids."""

    def __init__(self, stream):
        self.stream, self.at, self.n_tokens = stream, 0, 0
        self.rest, self.starts = np.zeros(0, dtype="<u4"), []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        self.docs += [(d, len(x)) for d, x in docs]
        ids = np.concatenate([self.rest, *(x for _, x in docs)])
        self.n_tokens += len(ids) - len(self.rest)
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:].copy()

    def _blocks(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids):
            self.starts.append(self.at)
            self.stream.write(block)
            self.at += len(block)

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest[-1], dtype="<u4")]))
        footer = b"".join([
            np.array([len(self.docs), self.n_tokens, len(self.starts)], dtype="<u8").tobytes(),
            np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes(),
            np.array([d is None for d, _ in self.docs], dtype=np.uint8).tobytes(),
            np.array([n for _, n in self.docs], dtype="<u8").tobytes(),
            np.array(self.starts, dtype="<u8").tobytes(),
        ])
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.stream.close()


class TokenFile:
    """Reads one file: all documents in order, or one alone."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        foot, self.end = source.read(n), size - 16 - n
        docs, self.n_tokens, blocks = (int(x) for x in np.frombuffer(foot, "<u8", 3))
        self.doc_ids = np.frombuffer(foot, "<i8", docs, 24)
        self.nulls = np.frombuffer(foot, np.uint8, docs, 24 + 8 * docs)
        self.lengths = np.frombuffer(foot, "<u8", docs, 24 + 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(foot, "<u8", blocks, 24 + 17 * docs).astype(np.int64)

    def ids(self, first_block: int, last_block: int) -> np.ndarray:
        edge = int(self.starts[last_block]) if last_block < len(self.starts) else self.end
        at = int(self.starts[first_block])
        self.source.seek(at)
        return decode_blocks(self.source.read(edge - at), self.starts[first_block:last_block] - at)

    def document(self, k: int) -> np.ndarray:
        start = int(self.lengths[:k].sum())
        stop = start + int(self.lengths[k])
        return self.ids(start // BLOCK, -(-stop // BLOCK))[start % BLOCK :][: stop - start]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        rest, block = np.zeros(0, dtype="<u4"), 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist(), strict=True):
            if len(rest) < n:
                parts, have = [rest], len(rest)
                while have < n:
                    to = min(len(self.starts), block + max(2048, -(-(n - have) // BLOCK)))
                    parts.append(self.ids(block, to))
                    have, block = have + len(parts[-1]), to
                rest = np.concatenate(parts)
            yield (None if null else doc), rest[:n]
            rest = rest[n:]


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str | None = None) -> list[dict]:
    """Write the documents in ascending doc_id order. Returns one entry a file, in order, with the place of its first id.

    Rows are range-partitioned by id and text hash, so one repeated id can't fill a task. Each attempt of a task writes
    under a name of its own and only files of attempts that ended well are listed: a lost executor leaves at most an
    unlisted file. The list has a line a file, so it is bounded by the number of partitions, not by documents.
    """
    arrow_batches(spark)
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, enc = None, encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, base = _file_system(folder)
                fs.create_dir(base, recursive=True)
                path = f"{base}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.lwt"
                writer = TokenFileWriter(fs.open_output_stream(path))
            docs, ids = batch.column("doc_id").to_pylist(), enc.ids(batch.column("text"))
            writer.add([(d, np.concatenate([x, END])) for d, x in zip(docs, ids, strict=True)])
        if writer is not None:
            writer.close()
            row = {"part": TaskContext.get().partitionId(), "file": path.rpartition("/")[2], "n_docs": len(writer.docs), "n_tokens": writer.n_tokens}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = sorted((r.asDict() for r in ordered.mapInArrow(write, "part int, file string, n_docs long, n_tokens long").collect()), key=lambda r: r["part"])
    before = [0, *accumulate(f["n_tokens"] for f in files)]
    return [f | {"start": s} for f, s in zip(files, before, strict=False)]


def read_token_files(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. One task reads one file, a few blocks at a time."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for f in batch.to_pylist():
                fs, base = _file_system(folder)
                at, rows = f["start"], []
                with fs.open_input_file(f"{base}/{f['file']}") as source:
                    for doc, ids in TokenFile(source):
                        rows.append((doc, at, len(ids), crc(ids)))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["file"], f["start"]) for f in files], "file string, start long")
    return listed.repartition(len(files)).mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    return read_token_files(spark, folder, write_token_files(spark, documents(spark, sf_dir), folder))
