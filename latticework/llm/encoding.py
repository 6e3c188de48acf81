"""Byte-level BPE ids by the tokenizers library, with equal chunks encoded once.

A text's ids are its chunks' ids in order, if no pre-token of a byte-level BPE crosses a chunk's border. Chunks are cut on
the bytes of a whole batch at once: before each space, around each line break, and before a mark that ends a run of Latin
letters. That is right unless white space comes in runs of three, or of two at the text's end, as then what the run
belongs to depends on what follows; such texts, few in most corpora, are cut by CHUNK instead. Equal chunks of a batch meet in
a dictionary; each comes from a bounded memory, and only new ones reach the library.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of the Latin blocks up to U+024F. A run of them ends a chunk before the marks below, where any pre-token ends.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CHUNK = re.compile(f" ?[{LATIN}]+(?=[.,;:!?{WHITE}]|$)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
END = np.zeros(1, dtype="<u4")
#: Of bytes: white space of ASCII, letters of ASCII, the marks of CHUNK, first bytes of two-byte Latin letters.
_WHITE, _LETTER, _MARK, _LEAD = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\x0b\x0c\r ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,;:!?", bytes(range(0xC3, 0xC9))))


def _texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends; null counts as empty."""
    arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    arr = arr.fill_null("").cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, edges - edges[0]


def _cuts(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and which texts can't be cut so."""
    n, of = len(raw), lambda at: np.searchsorted(edges, at, side="right") - 1
    cut = np.zeros(n + 1, dtype=bool)
    cut[edges[edges < n]] = True
    white = _WHITE[raw]
    cut[:n][raw == 32] = True
    lines = np.flatnonzero(raw == 10)
    cut[lines] = cut[lines + 1] = True
    marks = np.flatnonzero(_MARK[raw])
    marks = marks[marks > 0]
    before = raw[marks - 1]
    wide = _LEAD[raw[np.maximum(marks - 2, 0)]] & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (marks > 1)
    cut[marks[(_LETTER[before] | wide) & ~np.isin(marks, edges)]] = True
    bad = np.zeros(len(edges), dtype=bool)
    runs = np.flatnonzero(white[:-2] & white[1:-1] & white[2:]) if n > 2 else np.zeros(0, dtype=np.int64)
    ends = edges[1:][np.diff(edges) > 1]
    ends = ends[white[ends - 1] & white[ends - 2]]
    bad[of(runs)] = True  # a run over two texts' border costs time, not rightness
    bad[of(ends - 1)] = True
    for first, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = np.flatnonzero(raw == first)
        at = at[np.isin(raw[np.minimum(at + 1, n - 1)], second)]
        bad[of(at if third is None else at[np.isin(raw[np.minimum(at + 2, n - 1)], third)])] = True
    return np.flatnonzero(cut[:n]), bad[:-1]


class Encoder:
    """ids(texts) for one tokenizer file; remembers up to twice `remembered` chunks, those in use longest."""

    def __init__(self, path: str, remembered: int = 600_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunkable = '"ByteLevel"' in self.tokenizer.to_str()[:20_000] and self.tokenizer.normalizer is None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.remembered, self.longest = remembered, longest

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of different chunks."""
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, chunks))
        gaps = [i for i, b in enumerate(found) if b is None]
        new = []
        for i in gaps:
            found[i] = self.old.get(chunks[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, self._direct([chunks[i].decode() for i in new]), strict=True):
            found[i] = ids
        self.young.update((chunks[i], found[i]) for i in gaps if len(chunks[i]) <= self.longest)
        return found

    def _by_chunk(self, text: str) -> np.ndarray:
        chunks = [c.encode() for c in CHUNK.findall(text)]
        each = list(dict.fromkeys(chunks))
        known = dict(zip(each, self._known(each), strict=True))
        return np.frombuffer(b"".join(map(known.__getitem__, chunks)), dtype="<u4")

    def ids(self, texts, size: int = 6_000_000) -> list[np.ndarray]:
        """Ids of each text of a list or an Arrow array, about `size` bytes at a time; null counts as empty."""
        raw, edges = _texts(texts)
        stops = np.unique(np.append(np.searchsorted(edges, np.arange(size, len(raw), size)), len(edges) - 1))
        out = []
        for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out += self._ids(raw[edges[a] : edges[b]], edges[a : b + 1] - edges[a])
        return out

    def _ids(self, raw: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
        data = raw.tobytes()
        special = [s for s in self.special if s in data]
        begins, slow = _cuts(raw, edges) if self.chunkable else (edges[:0], np.ones(len(edges) - 1, dtype=bool))
        special = {k for k in range(len(edges) - 1) if any(s in data[edges[k] : edges[k + 1]] for s in special)} if special else set()
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw)).astype(np.int64)), pa.py_buffer(data)])
        encoded = chunks.dictionary_encode()
        place = encoded.indices.to_numpy().astype(np.int64)
        found = self._known(encoded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        own = sizes[place]
        ends = np.cumsum(own)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[place] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.append(0, ends)[np.searchsorted(begins, edges)]
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k in {*np.flatnonzero(slow).tolist(), *special}:
            text = data[edges[k] : edges[k + 1]].decode()
            out[k] = self._by_chunk(text) if self.chunkable and k not in special else np.frombuffer(self._direct([text])[0], dtype="<u4")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
