"""Operator 4: exact repeats between documents, by fixed-block anchors.

A window of WINDOW words always holds a whole block of BLOCK words that starts at a multiple of BLOCK
(WINDOW = 2 * BLOCK - 1). So the non-overlapping blocks of all documents are the index, and every rolling window of
BLOCK words of every document probes it. A hit is extended: all windows of WINDOW words around it are held against
each other by a hash of 128 bits, two of 64 made of different word hashes, and those whose words also start in a document
with a smaller id are covered. The union of the covered windows is the maximal exact repeats.

Rolling windows outnumber documents by hundreds, so they travel packed: a task hashes some megabytes of text with
numpy, deals the windows to buckets and sends one compressed array a bucket. Within such a chunk equal hashes meet
first: only the least and greatest documents' entries are sent on, so a passage that a third of all documents share
costs a bucket two entries a chunk, not one a document; a bucket merges what comes in the same way, so it never holds
more than its different windows. The number of buckets, and of the partitions that they are dealt to, follows the input's
size. Copies of a whole text take no part: all their windows lie in the first of them.

Defined cases: a null or blank text has no words; fewer than WINDOW words are never removed; a null doc_id counts as
greater than all others, and rows with equal ids never remove each other's words; repeated rows each come back; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, scratch, written

WINDOW, BLOCK = 13, 7
CHUNK_CHARS, BUCKET_ROWS, MERGE_ROWS, CHARS_A_WORD = 6_000_000, 1_500_000, 3_000_000, 6
#: A set of row keys (16 bytes each) up to this size is broadcast; beyond it rows meet by a shuffle.
BROADCAST_KEYS = 1_000_000
LAST = np.iinfo(np.int64).max
_U = np.uint64
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F, "other byte": 0xA0761D6478BD642F, "other": 0xD6E8FEB86659FD93}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Rolling:
    """Hashes of stretches of a sequence of numbers, by differences of a running sum; powers are kept and grown."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, dtype=_U)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values):
            n = len(values) + len(values) // 4
            self.up, self.down = _powers(self.base, n), _powers(self.back, n)
        sums = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])


_rolling: dict[str, _Rolling] = {}


def _hash(kind: str, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if kind not in _rolling:
        _rolling[kind] = _Rolling(_BASES[kind])
    return _rolling[kind](values, starts, ends)


def _word_hashes(texts: list[str | None], kind: str = "byte") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and the number of words of each text."""
    hashes, counts = [], []
    group: list[bytes] = []

    def flush() -> None:
        raw = np.frombuffer(b"\n".join([*group, b""]), dtype=np.uint8)
        gap = _SPACE[raw]
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        hashes.append(_hash(kind, raw.astype(_U) + _U(1), starts, ends))
        edges = np.cumsum([0, *(len(g) + 1 for g in group)])
        counts.append(np.diff(np.searchsorted(starts, edges)))
        group.clear()

    size = 0
    for text in texts:
        group.append((text or "").encode())
        size += len(group[-1])
        if size > 2_000_000:
            flush()
            size = 0
    if group:
        flush()
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64))


def _windows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of k words: the place of the first word, the text's number, the place in the text."""
    n = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(counts) - counts, n) + at, doc, at


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _blob(oid: np.ndarray, h1: np.ndarray, doc: np.ndarray, at: np.ndarray, marked: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Entries in order of text and place, as compressed columns. low: 8 bytes of hash, of which 5 stay if there is no high."""
    begins = _runs(doc)
    which, n = doc[begins], np.diff(np.append(begins, len(doc)))
    step = np.diff(at, prepend=0)
    step[begins] = at[begins]
    keys = oid[which]
    planes = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3 if not len(high) else 0 :].T)
    body = b"".join([
        np.array([len(which), len(doc), len(high)], dtype="<u4").tobytes(), np.diff(keys, prepend=0).astype("<i8").tobytes(), h1[which].astype("<i8").tobytes(),
        n.astype("<u4").tobytes(), np.ascontiguousarray(step.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), np.packbits(marked).tobytes(), planes.tobytes(), high.astype("<u8").tobytes(),
    ])
    return len(body).to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unblob(data: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    d, n, wide = (int(x) for x in np.frombuffer(raw, "<u4", 3))
    p = 12
    keys, p = np.cumsum(np.frombuffer(raw, "<i8", d, p)), p + 8 * d
    h1, p = np.frombuffer(raw, "<i8", d, p), p + 8 * d
    each, p = np.frombuffer(raw, "<u4", d, p).astype(np.int64), p + 4 * d
    step, p = np.frombuffer(raw, np.uint8, 4 * n, p).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64), p + 4 * n
    marked, p = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), p), count=n).astype(bool), p + -(-n // 8)
    size = 8 if wide else 5
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, 8 - size :] = np.frombuffer(raw, np.uint8, size * n, p).reshape(size, n).T
    p += size * n
    run, first = np.cumsum(step), np.cumsum(each) - each
    at = run - np.repeat(run[first] - step[first], each) if n else run
    return {"oid": np.repeat(keys, each), "h1": np.repeat(h1, each), "at": at, "marked": marked, "low": low.view("<u8").ravel(), "high": np.frombuffer(raw, "<u8", n if wide else 0, p)}


def _spans(begins: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(begins.tolist(), np.append(begins, n)[1:].tolist(), strict=True)


PACKED = "part int, oid long, h1 long, places binary, entries binary"
_PACKED = pa.schema([("part", pa.int32()), ("oid", pa.int64()), ("h1", pa.int64()), ("places", pa.binary()), ("entries", pa.binary())])
PLACES = "oid long, h1 long, places binary"
_PLACES = pa.schema([("oid", pa.int64()), ("h1", pa.int64()), ("places", pa.binary())])


def _by_text(oid: np.ndarray, h1: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((at, h1, oid))
    oid, h1, at = oid[order], h1[order], at[order].astype("<u4")
    begins = np.union1d(_runs(oid), _runs(h1))
    for a, b in _spans(begins, len(oid)):
        yield int(oid[a]), int(h1[a]), at[a:b].tobytes()


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[dict[str, list]]:
    """Rows of some batches together, up to about so many bytes of text."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            held.append(part)
            size += part.column("text").nbytes
            if size >= chars:
                yield pa.Table.from_batches(held).to_pydict()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).to_pydict()


def _dealt(oid: np.ndarray, h1: np.ndarray, buckets: int, sure: np.ndarray, sent: np.ndarray, doc: np.ndarray, at: np.ndarray, marked: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """A chunk's rows: places that are sure already, by text, and the entries to send, by bucket."""
    rows = [(buckets + abs(o % buckets), o, h, p, None) for o, h, p in _by_text(oid[doc[sure]], h1[doc[sure]], at[sure])]
    bucket = (low % _U(buckets)).astype(np.int64)
    sent = sent[np.lexsort((at[sent], doc[sent], bucket[sent]))]
    begins = _runs(bucket[sent])
    for a, b in _spans(begins, len(sent)):
        s = sent[a:b]
        rows.append((int(bucket[s[0]]), None, None, None, _blob(oid, h1, doc[s], at[s], marked[s], low[s], high[s] if len(high) else high)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PACKED, strict=True)], schema=_PACKED)


def _collapsed(order: np.ndarray, begins: np.ndarray, ids: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in order of hash: those of hashes that several texts have; those to go on, which are all others and, of such a hash,
    one of the least and one of the greatest text, marked if any is; the marks."""
    n, own = np.diff(np.append(begins, len(order))), ids[order]
    least, most = np.minimum.reduceat(own, begins), np.maximum.reduceat(own, begins)
    shared, run = np.repeat(least < most, n), np.repeat(np.arange(len(n)), n)
    picked = []
    for end in (least, most):
        at = np.flatnonzero(shared & (own == end[run]))
        picked.append(at[np.unique(run[at], return_index=True)[1]])
    picked = np.unique(np.concatenate(picked))
    marked = marked.copy()
    marked[order[picked]] = np.logical_or.reduceat(marked[order], begins)[run[picked]]
    return order[shared], order[np.concatenate([np.flatnonzero(~shared), picked])], marked


def _anchors(buckets: int, chars: int):
    """Every rolling window of BLOCK words; marked if it is a block of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, chars):
            words, counts = _word_hashes(table["text"])
            oid, h1 = (np.array(table[c], dtype=np.int64) for c in ("oid", "h1"))
            first, doc, at = _windows(counts, BLOCK)
            if not len(first):
                continue
            low = _hash("word", words, first, first + BLOCK)
            order = np.argsort(low, kind="stable")
            sure, sent, marked = _collapsed(order, _runs(low[order]), oid[doc], at % BLOCK == 0)
            yield _dealt(oid, h1, buckets, sure, sent, doc, at, marked, low, np.zeros(0))

    return run


def _extended(buckets: int, chars: int):
    """The windows of WINDOW words that hold a hit; a text's hits come as arrays of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, chars):
            words, counts = _word_hashes(table["text"])
            oid, h1 = (np.array(table[c], dtype=np.int64) for c in ("oid", "h1"))
            first, doc, at = _windows(counts, WINDOW)
            if not len(first):
                continue
            around = np.zeros(len(words) + 1, dtype=np.int64)
            for begin, hits in zip((np.cumsum(counts) - counts).tolist(), table["hits"], strict=True):
                places = np.frombuffer(b"".join(hits), dtype="<u4").astype(np.int64)
                np.add.at(around, begin + np.maximum(places - (WINDOW - BLOCK), 0), 1)
                np.add.at(around, begin + places + 1, -1)
            near = np.cumsum(around)[first] > 0
            first, doc, at = first[near], doc[near], at[near]
            if not len(first):
                continue
            low, high = _hash("word", words, first, first + WINDOW), _hash("other", _word_hashes(table["text"], "other byte")[0], first, first + WINDOW)
            ids, order = oid[doc], np.lexsort((high, low))
            begins = np.union1d(_runs(low[order]), _runs(high[order]))
            least = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.append(begins, len(order))))
            later = ids[order] > least
            yield _dealt(oid, h1, buckets, order[later], order[~later], doc, at, np.zeros(len(doc), dtype=bool), low, high)

    return run


def _judged(entries: dict[str, np.ndarray], indexed: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's entries so far, those that are hits, and those that what is still to come must meet. With `indexed`, hits are all
    of a hash that an index block shares with a later text; else those after the first text. Only the last call is exact
    on index blocks: before, any hash of several texts counts, as extension decides."""
    keys = [entries["high"], entries["low"]] if len(entries["high"]) else [entries["low"]]
    order = np.lexsort(keys)
    begins = np.unique(np.concatenate([_runs(k[order]) for k in keys]))
    n, oid = np.diff(np.append(begins, len(order))), entries["oid"][order]
    if not indexed:
        later = oid > np.repeat(np.minimum.reduceat(oid, begins), n)
        return order[later], order[~later]
    if last:
        least = np.minimum.reduceat(np.where(entries["marked"][order], oid, LAST), begins)
        return order[np.repeat(least < np.maximum.reduceat(oid, begins), n)], order[:0]
    sure, sent, entries["marked"] = _collapsed(order, begins, entries["oid"], entries["marked"])
    return sure, sent


def _met(indexed: bool, merge_rows: int):
    """Batches come sorted by part: buckets to judge, and places to hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, limit = None, [], 0, merge_rows

        def judged(last: bool) -> pa.RecordBatch:
            nonlocal held, rows, limit
            entries = {c: np.concatenate([e[c] for e in held]) for c in held[0]}
            hits, left = _judged(entries, indexed, last)
            found = list(_by_text(entries["oid"][hits], entries["h1"][hits], entries["at"][hits]))
            held = [] if last else [{c: v[left] if len(v) else v for c, v in entries.items()}]
            rows = 0 if last else len(left)
            limit = max(merge_rows, 2 * rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 3, _PLACES, strict=True)], schema=_PLACES)

        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column("places")))
            if known.num_rows:
                yield known.select(["oid", "h1", "places"])
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if blob is None:
                    continue
                if p != part and held:
                    yield judged(True)
                part = p
                held.append(_unblob(blob))
                rows += len(held[-1]["oid"])
                if rows >= limit:
                    yield judged(False)
        if held:
            yield judged(True)

    return run


_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, copy, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "starts")), strict=True):
            ws, spans, kept = (text or "").encode().split(), [], None
            if copy and len(ws) >= WINDOW:
                kept, spans = [], [(0, len(ws))]
            elif starts:
                cover = np.zeros(len(ws) + 2, dtype=np.int64)
                places = np.unique(np.frombuffer(b"".join(starts), dtype="<u4")).astype(np.int64)
                cover[places + 1] += 1
                cover[places + WINDOW + 1] -= 1
                gone = np.cumsum(cover)[:-1] > 0  # one place later, so an edge is seen on both sides
                edges = np.flatnonzero(np.diff(np.append(gone, False)))
                spans = [(a, b - a) for a, b in edges.reshape(-1, 2).tolist()]
                kept = [w for w, g in zip(ws, gone[1:].tolist(), strict=True) if not g]
            kept = ws if kept is None else kept
            rows.append((doc, len(ws), len(ws) - len(kept), b" ".join(kept).decode(), [{"first": a, "words": n} for a, n in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _KEPT, strict=True)], schema=_KEPT)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key: oid orders texts; h1 parts rows that share an id, and is 0 if none do."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    twice = not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()
    return rows.withColumns({"oid": F.coalesce("doc_id", F.lit(int(LAST))), "h1": F.xxhash64("text") if twice else F.lit(0).cast("long")})


def _meet(rows: DataFrame, packed, indexed: bool, buckets: int) -> DataFrame:
    sent = rows.mapInArrow(packed, PACKED).repartition(buckets, "part").sortWithinPartitions("part")
    return sent.mapInArrow(_met(indexed, MERGE_ROWS), PLACES)


def _small(keys: DataFrame) -> DataFrame:
    """The keys with a broadcast hint if their number allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def covered_windows(rows: DataFrame, folder: str) -> DataFrame:
    """oid, h1, starts: where the covered windows of a text start. rows: oid, h1, text, each text once."""
    arrow_batches(rows.sparkSession)
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = max(64, -(-chars // CHARS_A_WORD // BUCKET_ROWS))
    hits = _meet(rows.select("oid", "h1", "text"), _anchors(buckets, CHUNK_CHARS), True, buckets)
    hits = written(hits.groupBy("oid", "h1").agg(F.collect_list("places").alias("hits")), folder, "hits")
    hit = rows.select("oid", "h1", "text").join(_small(hits.select("oid", "h1")), ["oid", "h1"], "left_semi")
    found = _meet(hit.join(hits, ["oid", "h1"]).select("oid", "h1", "text", "hits"), _extended(buckets, CHUNK_CHARS), False, buckets)
    return written(found.groupBy("oid", "h1").agg(F.collect_list("places").alias("starts")), folder, "starts")


def kept_texts(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, n_words, n_removed, `kept`, the words that stay, joined by one space, and `removed`, the runs of words that
    go (first, words)."""
    folder = scratch(docs.sparkSession)
    rows = _keyed(docs)
    # distinct comes before the join, so that a large group of copies can be split there
    texts = rows.select("oid", "h1", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("same")).distinct()
    first = texts.groupBy("same").agg(F.min("oid").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    copies = written(texts.join(first, "same").where("oid > first").select("oid", "h1").withColumn("copy", F.lit(True)), folder, "copies")
    copies = _small(copies)
    starts = covered_windows(rows.join(copies, ["oid", "h1"], "left_anti"), folder)
    joined = rows.join(copies, ["oid", "h1"], "left").join(starts, ["oid", "h1"], "left")
    return joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:bigint,words:bigint>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return kept_texts(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_block_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


OP4_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS p FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS words FROM s),
f AS (SELECT words, min(doc_id) AS first FROM g GROUP BY words),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS k FROM g JOIN f USING (words) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.k) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.k = x.k WHERE c.k IS NULL GROUP BY 1) y ON y.doc_id = w.doc_id
"""
