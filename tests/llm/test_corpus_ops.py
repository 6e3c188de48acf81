"""Token files, rollups, repeats, packing, near-duplicates and the pipeline against brute force on small tables."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import components, encoding, packing, repeats, rollups, simhash, token_files
from latticework.llm.common import scratch
from test_text_ops import SCHEMA, WORD, odd, table


@pytest.fixture(scope="module")
def enc():
    return encoding.Encoder(encoding.default_tokenizer(), remembered=50)


def _plain(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0  　'.,;!?-_09azAZéßñ²Ⅷ漢\x1c😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_encode_as_the_whole(text):
    e = encoding.encoder(encoding.default_tokenizer())
    assert e.ids([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\xa0\u2009'.,!aZéßŁ×÷ñ9_\u0301’漢"), max_size=12), max_size=8), st.sampled_from([1, 7, 6_000_000]))
def test_batches_encode_as_their_texts(texts, size):
    e = encoding.encoder(encoding.default_tokenizer())
    assert [x.tolist() for x in e.ids(texts, size)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_and_knows_special_tokens(enc):
    texts = [f"word{k} other{k % 7}, it's <|endoftext|> end" if k % 5 == 0 else f"word{k} other{k % 7}, it's" for k in range(300)] + [None, "", "y" * 500]
    for k in range(0, len(texts), 40):
        for t, ids in zip(texts[k : k + 40], enc.ids(texts[k : k + 40]), strict=True):
            assert ids.tolist() == _plain(enc, t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=900))
def test_blocks_round_trip(values):
    ids = np.array(values + [0] * (-len(values) % token_files.BLOCK), dtype="<u4")
    blocks = token_files.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert token_files.decode_blocks(b"".join(blocks), starts).tolist() == ids.tolist()


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_reads_whole_and_by_document():
    rng = np.random.default_rng(0)
    docs = [(k if k % 3 else None, rng.integers(0, 50_257, rng.integers(0, 2000)).astype("<u4")) for k in range(40)]
    out = _Source()
    out.close = lambda: None
    writer = token_files.TokenFileWriter(out)
    for k in range(0, 40, 7):
        writer.add(docs[k : k + 7])
    writer.close()
    file = token_files.TokenFile(out)
    assert [(d, x.tolist()) for d, x in file] == [(d, x.tolist()) for d, x in docs]
    assert file.document(17).tolist() == docs[17][1].tolist()


def test_token_files(spark, enc):
    rows = [(7, "b b"), (3, None), (None, "nulls first"), (5, ""), (7, "a"), (1, "same"), (1, "same")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    folder = scratch(spark)
    files = token_files.write_token_files(spark, df, folder)
    got = token_files.read_token_files(spark, folder, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 3, 5, 7, 7]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(7)]
    assert {r["ids_crc32"] for r in got if r["doc_id"] == 1} == {zlib.crc32(np.array([*_plain(enc, "same"), 0], dtype="<u4").tobytes())}
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(spark, df.limit(0), folder)).count() == 0


def test_best_fit_keeps_its_bounds():
    rng = random.Random(1)
    packer = packing.BestFit(100, 5)
    for k in range(2000):
        packer.add(rng.randint(1, 100), [k])
        assert packer.n_open <= 5 and packer.n_open == sum(map(len, packer.by_free)) and packer.mask == sum(1 << f for f, s in enumerate(packer.by_free) if s)
    assert sorted(x for _, items in packer.done + packer.still_open() for x in items) == list(range(2000))
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)] and packing.cut(1) == [(0, 1)]


def test_pack(spark, enc, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 3, 200, 700, 2500]))) for _ in range(60)] + [None]
    got = packing.pack(spark, table(spark, texts).repartition(5)).collect()
    for d, t in enumerate(texts):
        ids = np.array([*_plain(enc, t), 0], dtype="<u4")
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids)) and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048
    offline = packing.BestFit(2048, 10**9)  # best fit of all pieces, longest first: no bound on space, one task
    for n in sorted((r["length"] for r in got), reverse=True):
        offline.add(n, [0])
    assert len(bins) <= len(offline.done) + len(offline.still_open()) + 1


def _near(fps, radius):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_forest_finds_every_neighbour():
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(5)]
    fps = np.array(sorted(set(fps)), dtype="<u8")
    shards = np.sort(np.arange(len(fps)) % 3)
    forest = simhash.Forest(fps, shards)
    got = {(int(a), int(b)) for x, y in forest.near(fps, forest.root, 3) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if shards[i] == shards[j] and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3}


@pytest.mark.parametrize("shard_rows,few", [(20_000, 10**9), (3, 10**9), (20_000, 10), (20_000, 1)])
def test_links_lose_no_pair(spark, shard_rows, few):
    rng = random.Random(4)
    fps = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << b) for b in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    folder = scratch(spark)
    found = {r["node"]: r["root"] for r in components.components(simhash.link(df, folder, shard_rows=shard_rows, few=few), folder).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = {}
    for f, g in zip(signed, _near(fps, 3), strict=True):
        groups.setdefault(g, []).append(f)
    for own in groups.values():
        assert {found.get(f, f) for f in own} == {min(own)}


def test_near_duplicates(spark):
    base = " ".join(f"word{k}" for k in range(400))
    texts = [base, base + " tail", "", None, " \n", "Alpha BETA", "alpha beta", "É", "é", base.upper()]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        from xxhash import xxh64_intdigest

        hs = [xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        assert got[d]["fingerprint"] == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"
    assert [got[d]["component_id"] for d in (0, 9, 2, 3, 4, 5, 6)] == [0, 0, 2, 2, 2, 5, 5] and got[7]["component_id"] != got[8]["component_id"]


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    found = dict(components.components(spark.createDataFrame(links, "u long, v long"), scratch(spark)).collect())
    assert found == {k: 0 for k in range(1, 51)} | {k: 100 for k in range(101, 140)} | {301: 300}
    assert components.components(spark.createDataFrame([], "u long, v long"), scratch(spark)).count() == 0


def _removed(docs):
    """Brute force for rows of (id or None, text)."""
    first = {}
    order = [float("inf") if d is None else d for d, _ in docs]
    ws = [WORD.findall(t or "") for _, t in docs]
    for o, w in zip(order, ws, strict=True):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, o), o)
    out = []
    for (d, _), o, w in zip(docs, order, ws, strict=True):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < o for j in range(k, k + 13)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,merge", [(6_000_000, 3_000_000), (2000, 3_000_000), (1500, 10)])
def test_repeats(spark, monkeypatch, chunk, merge):
    rng = random.Random(5)
    pool = [[f"p{rng.randint(0, 50)}" for _ in range(n)] for n in (12, 13, 14, 30, 60)]
    docs = []
    for k in range(120):
        body = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(pool)
        docs.append((k, " ".join(body)))
    docs += [(k, "again and " * 30) for k in (130, 131, 140)] + [(200, docs[3][1]), (201, docs[3][1]), (201, docs[3][1]), (201, docs[4][1]), (None, docs[5][1]), (None, docs[6][1] + " more"), (300, None), (301, ""), (302, " ".join(pool[1]))]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], SCHEMA).repartition(3)
    monkeypatch.setattr(repeats, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(repeats, "MERGE_ROWS", merge)
    assert sorted(map(tuple, repeats.without_repeats(df).collect()), key=repr) == _removed(docs)
    some = docs[:120]
    unique = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in some], SCHEMA).repartition(3)
    assert sorted(map(tuple, repeats.without_repeats(unique).collect()), key=repr) == _removed(some)


def test_kept_texts_and_removed_runs(spark):
    shared = " ".join(f"s{k}" for k in range(15))
    texts = [f"a b {shared} c", f"d  {shared}\ne f {shared}", f"d  {shared}\ne f {shared}", "short", None]
    got = {r["doc_id"]: (r["kept"], [tuple(x) for x in r["removed"]]) for r in repeats.kept_texts(table(spark, texts)).collect()}
    assert got == {0: (f"a b {shared} c", []), 1: ("d e f", [(1, 15), (18, 15)]), 2: ("", [(0, 33)]), 3: ("short", []), 4: ("", [])}


def test_rollups(spark):
    folder = scratch(spark)
    store = rollups.RollupStore(spark, folder)
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, old_source string"
    assert store.totals().count() == 0
    load = spark.createDataFrame([("insert", "a", "en", "v", 10, None, None), ("insert", "a", "en", "v", 5, None, None), ("insert", None, "en", "v", None, None, None)], schema)
    assert store.apply("b1", load) and not store.apply("b1", load)
    moved = spark.createDataFrame([("delete", "a", "en", "v", None, 10, None), ("revise", "b", "en", "v", 7, 5, "a")], schema)
    assert store.apply("b2", moved)
    want = {("b", "en", "v", 1, 7), (None, "en", "v", 1, 0)}
    assert set(map(tuple, store.totals().collect())) == want
    assert store.compact() and not store.compact() and not store.apply("b2", moved)
    assert set(map(tuple, store.totals().collect())) == want
    assert store.apply("b3", moved.limit(0)) and set(map(tuple, rollups.RollupStore(spark, folder).totals().collect())) == want
    with pytest.raises(ValueError):
        store.apply("a/b", load)


@pytest.mark.parametrize("op", ["files", "rollups", "repeats", "pack", "simhash"])
def test_odd_rows_and_empty_tables(spark, op):
    def files(df):
        folder = scratch(spark)
        return token_files.read_token_files(spark, folder, token_files.write_token_files(spark, df, folder))

    run = {"files": files, "rollups": rollups.counted, "repeats": repeats.without_repeats, "pack": lambda d: packing.pack(spark, d).where("piece = 0"), "simhash": simhash.near_duplicates}[op]
    assert run(odd(spark).limit(0)).count() == 0
    assert run(odd(spark)).count() == 8


def test_pipeline(spark, tmp_path, enc):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    common = "the of and to in is it that was for on are as with his they at be this from".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    item = prose(40)
    texts = [prose(150) for _ in range(40)]
    texts += [texts[2], texts[1] + " end", prose(60) + " " + item + " " + prose(60), "too short", "### $$$ %%% " * 60, None]
    rows = [(k, t if t is None or k >= 40 else f"{t}\na line that all sites have", "en", f"s{k}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(range(40))
    body = {k: texts[k] + ("\na line that all sites have" if k == 0 else "") for k in range(40)}
    for r in packed:
        ids = np.array([*_plain(enc, body[r["doc_id"]]), 0], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_copied_junk_changes_no_verdict(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    common = "the of and to in is it that was for on are as with his they at be this from".split()
    plain = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(150)) for _ in range(60)]
    junk = " ".join(rng.choice([f"sale{c}" for c in "abcdefghijklmno"]) for _ in range(400))
    kept = [{r["doc_id"] for r in pipeline.quality_rules(spark, table(spark, plain + [junk] * n), "").select("doc_id").collect()} for n in (0, 60)]
    assert kept[0] == set(range(60)) == kept[1] & set(range(60))


def test_short_lines_go(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(k, f"own line number {k} here\nRead more\n\n版权所有\nrare", "en", f"s{k}", 0) for k in range(12)]
    rows = [(k, t if k < 9 else t.replace("rare", ""), *rest) for k, t, *rest in rows]
    left = {r["doc_id"]: r["text"] for r in pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert left[0] == rows[0][1]
    assert all(left[k] == f"own line number {k} here\n\n{'rare' if k < 9 else ''}" for k in range(1, 12))


def test_one_id_with_two_texts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(200)) for _ in range(2)]
    rows = [(1, texts[0], "en", "a", 0), (2, texts[0] + " end", "en", "a", 0), (2, texts[1], "en", "a", 0), (None, texts[0], "en", "a", 0)]
    rows += [(1, texts[0] + " tail", "en", "a", 0)]
    left = [(r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert (2, texts[1]) in left and (None, texts[0]) in left and len(left) == 3


CLASHING = ["_q", "_t", "_id", "_h1", "_lines", "_gone", "ref_words", "row", "left", "verdict", "parts", "h", "m", "fp", "n_removed"]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, tmp_path, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(None, None), (1, ""), (2, "some words here for the test"), (3, "other words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd(spark).drop("h", "place", "term")
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(f"own {k}"))
    name, run = pipeline.STAGES[stage]
    got = run(spark, docs, str(tmp_path))
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "best-fit packing":
        assert got.where("piece = 0").count() == 8
        return
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    assert all(r[c] == f"own {k}" for r in rows for k, c in enumerate(CLASHING))
    left = sorted((r["doc_id"], (r["text"] or "")[:5]) for r in rows if r["doc_id"] is not None)
    assert left == {"quality rules": [], "line dedup": [(1, ""), (2, ""), (3, " \t\r\n\x0b"), (4, "w0 w1"), (4, "w0 w1"), (5, "xxxxx")], "SimHash near-dedup": [(1, ""), (4, "w0 w1"), (5, "xxxxx")], "benchmark decontamination": [(1, ""), (2, ""), (3, " \t\r\n\x0b"), (4, "w0 w1"), (4, "w0 w1"), (5, "xxxxx")]}[name]
    assert sum(r["doc_id"] is None for r in rows) == {"quality rules": 0, "line dedup": 2, "SimHash near-dedup": 2, "benchmark decontamination": 0}[name]


def test_near_dedup_keeps_what_only_shares_an_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(16)
    one, two = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(100)) for _ in range(2))
    df = spark.createDataFrame([(1, one, "en", "a", 0), (2, one, "en", "a", 0), (2, two, "en", "a", 0)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, df, "").collect()) == sorted([(1, one), (2, two)])
