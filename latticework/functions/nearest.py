"""Nearest token sets by Jaccard similarity, block against block, in Arrow and NumPy.

packed() and indexed() make the blocks of the two sides, one row each; nearest() takes rows that hold a block of either side.
All three are for mapInArrow. Every set of the left block is scored against every set of the right one: the commonest tokens
of a right block meet as bits of a mask, the others by lists of the sets that hold them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

#: Sets of a left block, and pairs scored at once, some megabytes that a core's cache holds.
LEFT_ROWS, CELLS = 2048, 1 << 18
#: Tokens of a right block that are bits of a 64-bit mask.
BITS = 64

Batches = Iterator[pa.RecordBatch]


def _sets(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """ids, and the tokens of all sets, none of them empty, with their number by set. Columns: id, set."""
    ids, sets = (c.combine_chunks() for c in table.columns)
    return ids, pa.compute.list_value_length(sets).to_numpy(), sets.flatten().to_numpy()


def _block(ids: pa.Array, block: tuple) -> pa.RecordBatch:
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, pa.array([pickle.dumps(block, protocol=5)], pa.binary())], ["ids", "block"])


def packed(batches: Batches) -> Batches:
    """Left blocks, numbered within the task's partition."""
    from pyspark import TaskContext

    task, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        ids, sizes, tokens = _sets(pa.Table.from_batches(held))
        words, local = np.unique(tokens, return_inverse=True)
        return _block(ids, ((task, number), words, local.astype(np.min_scalar_type(len(words))), sizes.astype(np.int32)))

    for batch in batches:
        for start in range(0, batch.num_rows, LEFT_ROWS):
            held.append(batch.slice(start, LEFT_ROWS))
            rows += held[-1].num_rows
            if rows >= LEFT_ROWS:
                yield block()
                number, held, rows = number + 1, [], 0
    if rows:
        yield block()


def indexed(batches: Batches) -> Batches:
    """The task's partition as one right block, in order of id."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, sizes, tokens = _sets(table.take(pa.compute.sort_indices(table.column(0), null_placement="at_start")))
    words, local, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    common = np.argsort(-counts, kind="stable")[:BITS]
    bit, masks = np.full(len(words), BITS, np.uint8), np.zeros(len(sizes), np.uint64)
    bit[common] = np.arange(len(common))
    order = np.argsort(local, kind="stable")
    rows = np.repeat(np.arange(len(sizes), dtype=np.min_scalar_type(len(sizes))), sizes)[order]
    bits = bit[local[order]]
    often = bits < BITS
    np.bitwise_or.at(masks, rows[often], np.uint64(1) << bits[often].astype(np.uint64))
    counts[common] = 0
    yield _block(ids, (words, counts.astype(np.int32), rows[~often], sizes.astype(np.int32), bit, masks))


def _best(left: tuple, right: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both blocks and the similarity of the k best of each left set; of equal ones the first in the right block."""
    _, own, local, na = left
    words, counts, rows, nb, bit, masks = right
    n, at = len(nb), np.append(0, np.cumsum(na))
    place = np.minimum(np.searchsorted(words, own), len(words) - 1)
    known = words[place] == own
    bits = np.append(np.uint64(1) << np.arange(BITS, dtype=np.uint64), np.uint64(0))
    mask = np.bitwise_or.reduceat(np.where(known, bits[bit[place]], np.uint64(0))[local], at[:-1])
    length, first = np.where(known, counts[place], 0), (np.cumsum(counts, dtype=np.int64) - counts)[place]
    out, step = [], max(1, CELLS // n)
    for i in range(0, len(na), step):
        j = min(i + step, len(na))
        word, row = local[at[i] : at[j]], np.repeat(np.arange(j - i) * n, na[i:j])
        row, word = row[some := length[word] > 0], word[some]
        long = length[word]
        place_in = np.repeat(first[word] - (np.cumsum(long) - long), long)
        place_in += np.arange(len(place_in))
        both = np.bincount(np.repeat(row, long) + rows[place_in], minlength=(j - i) * n).astype(np.float32).reshape(j - i, n)
        both += np.bitwise_count(mask[i:j, None] & masks[None])
        # rounding keeps order, so what is among the best before it is among the best, or equal to one of them, after it
        rough = (na[i:j, None].astype(np.float32) + nb.astype(np.float32)) - both
        np.divide(both, rough, out=rough)
        least = rough.max(1) if k == 1 else np.partition(rough, n - k, 1)[:, n - k] if k < n else np.zeros(j - i, np.float32)
        a, b = np.nonzero(rough >= np.maximum(least, np.float32(1e-30))[:, None])
        shared = both[a, b].astype(np.float64)
        out.append(_first(a + i, b, shared / (na[a + i] + nb[b] - shared), k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first(a: np.ndarray, b: np.ndarray, similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar of each a, by b where equal."""
    order = np.lexsort((b, -similarity, a))
    a = a[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[kept], b[order][kept], similarity[order][kept]


def nearest(k: int) -> Callable[[Batches], Batches]:
    """left_id, right_id and similarity of the k best of each left set over the right blocks that follow each other beside its
    block; pairs that share nothing are left out. Columns: left_ids, left, right_ids, right."""
    def run(batches: Batches) -> Batches:
        left, ids, found = None, None, []

        def told() -> pa.RecordBatch:
            a, similarity, right = (np.concatenate([f[c] for f in found]) if c < 2 else pa.concat_arrays([f[c] for f in found]) for c in range(3))
            if len(found) > 1:
                place = np.empty(len(right), np.int64)
                place[pa.compute.sort_indices(right, null_placement="at_start").to_numpy()] = np.arange(len(right))
                a, place, similarity = _first(a, place, similarity, k)
                right = right.take(pa.compute.sort_indices(right, null_placement="at_start").take(pa.array(place)))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), right, pa.array(similarity)], ["left_id", "right_id", "similarity"])

        for batch in batches:
            for i in range(batch.num_rows):
                block = pickle.loads(batch.column(1)[i].as_buffer())
                if left is None or block[0] != left[0]:
                    if found:
                        yield told()
                    left, ids, found = block, batch.column(0)[i].values, []
                a, b, similarity = _best(left, pickle.loads(batch.column(3)[i].as_buffer()), k)
                found.append((a, similarity, batch.column(2)[i].values.take(pa.array(b))))
        if found:
            yield told()

    return run
