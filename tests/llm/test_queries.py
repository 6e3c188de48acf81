"""The registered queries themselves, over small tables with odd rows, against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import encoding, packing, pii, rollups, simhash, token_files
from latticework.llm.common import scratch
from test_corpus_ops import _near
from test_text_ops import SCHEMA, WORD, _base

#: Names that operators could use for columns of their own.
CLASHING = ["_q", "_t", "_id", "_h1", "_lines", "_gone", "ref_words", "_row", "term", "fp", "copies"]


def texts_of(rng):
    words = [f"w{k}" for k in range(300)]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 900])))) for k in range(40)]
    out += [(40, "call +1 389 555 5010 or write ann@corp.example now"), (41, "ann@corp.example sits with Zorblatt in r12"), (42, "Zorblatt left"), (43, "Zorblatt left")]
    out += [(k, f"desk line {k} hq@corp.example the usual words") for k in range(44, 52)] + [(52, "card 4111 1111 1111 1111, ip 10.0.0.1, ann.lee@x.example 10.0.0.2"), (53, "10.0.0.1.2.3.4.5@mail.example")]
    out += [(60, None), (61, ""), (62, " \n\t"), (None, "no id here w1 w2"), (7, "a second text of one id"), (5, out[5][1]), (70, out[5][1]), (71, "x" * 30_000), (72, "é ü 漢字 " * 30)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    docs = texts_of(rng)
    path = tmp_path_factory.mktemp("tables")
    rows = [(d, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for d, t in docs]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(1))
    df.write.parquet(str(path / "documents.parquet"))
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 50, 2)] + [(4, 0, 0), (4, 1, 0), (6, None, None), (8, 0, None), (None, 0, 1), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows, labels


@pytest.fixture(scope="module")
def ids_of():
    tok = encoding.Encoder(encoding.default_tokenizer()).tokenizer
    return lambda text: np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_op2(spark, tables, ids_of):
    path, rows, _ = tables
    got = sorted(map(tuple, token_files.op2_token_files(spark, path).collect()), key=lambda r: r[1])
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(i), zlib.crc32(i.tobytes())) for d, t, *_ in rows for i in [ids_of(t)])
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)


def test_op3(spark, tables, ids_of):
    path, rows, labels = tables
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    poor = {d for d, q, _ in labels if d is not None and q == 0} - toxic
    want = Counter(), Counter()
    for d, t, lang, source, _ in rows:
        if d in toxic:
            continue
        key, n = ((source, lang, "white_space"), len(WORD.findall(t or ""))) if d in poor else ((source, lang, "byte_bpe_50k"), len(ids_of(t)) - 1)
        want[0][key] += 1
        want[1][key] += n
    got = rollups.op3_token_rollups(spark, path).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == {k: (want[0][k], want[1][k]) for k in want[0]} and len(got) == len(want[0])


def test_rollups_of_repeated_ids(spark, tmp_path):
    rows = [(1, "a b", "en", "s", 3), (2, "c d", "en", "s", 3), (2, "e f", "en", "s", 3), (3, "g", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["tokenizer"]: (r["n_docs"], r["n_tokens"]) for r in rollups.op3_token_rollups(spark, str(tmp_path)).collect()}
    assert got["white_space"] == (2, 4) and got["byte_bpe_50k"][0] == 1


def _batch(spark, n, source="a"):
    return spark.createDataFrame([("insert", source, "en", "v", n)], "op string, source string, lang string, tokenizer string, n_tokens long")


def test_two_writers_of_a_store(spark, monkeypatch):
    folder = scratch(spark)
    one, two = rollups.RollupStore(spark, folder), rollups.RollupStore(spark, folder)

    def total():
        return [tuple(r)[3:] for r in rollups.RollupStore(spark, folder).totals().collect()]

    monkeypatch.setattr(one, "batches", set)  # both looked before either had committed
    monkeypatch.setattr(two, "batches", set)
    assert one.apply("b1", _batch(spark, 10)) and two.apply("b1", _batch(spark, 10)) and total() == [(1, 10)]
    monkeypatch.undo()
    assert not one.apply("b1", _batch(spark, 10)) and one.apply("b2", _batch(spark, 5)) and total() == [(2, 15)]
    seen = one.markers()
    assert two.apply("b3", _batch(spark, 1))
    monkeypatch.setattr(one, "markers", lambda: seen)  # a batch comes in while a compaction runs
    assert one.compact()
    monkeypatch.undo()
    assert total() == [(3, 16)]
    monkeypatch.setattr(two, "markers", lambda: seen)  # and a second compaction of the same batches
    assert two.compact()
    monkeypatch.undo()
    assert total() == [(3, 16)] and one.compact() and total() == [(3, 16)]
    _batch(spark, 99).write.parquet(f"{folder}/sums/orphan")
    assert one.vacuum() > 0 and total() == [(3, 16)] and len(one.markers()) == 1
    assert one.vacuum(older_than=-10) == 1 and not one.apply("b2", _batch(spark, 5)) and one.batches() == {"b1", "b2", "b3"}
    assert two.apply("b4", _batch(spark, 4)) and total() == [(4, 20)]


def disclosed(texts):
    """The spans of each text, by the stated formula, and the sanitised text."""
    distinct = sorted({t or "" for t in texts})
    n, held, have, both = len(distinct), Counter(), Counter(), Counter()
    base = {t: _base(t) for t in distinct}
    for t in distinct:
        out, at = "", 0
        for s, _, e in base[t]:
            out, at = out + t[at:s] + "\n", max(at, e)
        terms = set(re.findall(r"[^\W_]+", (out + t[at:]).lower()))
        own = {(k, re.sub("[^0-9]", "", t[s:e]) if k >= 2 else t[s:e].lower()) for s, k, e in base[t]}
        held.update(own)
        have.update(terms)
        both.update((c, w) for c in own for w in terms)
    told = {}
    for (c, w), b in both.items():
        part = math.log(b * n / (held[c] * have[w])) / math.log(n / held[c]) if held[c] < n else 0
        met = have[w] == b or have[w] * (sum(map(bool, base.values())) / n) <= pii.CHANCE * b
        if part >= pii.GENERALISE and math.log2((have[w] + 1) / b) <= pii.LEFT and met:
            told[w] = max(told.get(w, 0), 5 if part >= pii.REMOVE else 4)
    out = {}
    for t in distinct:
        spans = [(s, k, e) for s, k, e in base[t]]
        for m in re.finditer(r"[^\W_]+", t):
            if m[0].lower() in told and not any(s < m.end() and m.start() < e for s, _, e in base[t]):
                spans.append((m.start(), told[m[0].lower()], m.end()))
        spans.sort()
        safe, at = "", 0
        for s, k, e in spans:
            w = t[s:e]
            shape = "[number]" if w.isdigit() else "[code]" if re.search("[0-9]", w) else "[name]" if w[0].isupper() else "[word]"
            safe, at = safe + t[at:s] + (f"[{pii.KINDS[k]}]" if k < 4 else shape if k == 4 else ""), max(at, e)
        out[t] = spans, safe + t[at:]
    return out


def check_op6(spark, path, texts):
    """Compares the query with brute force; returns the kinds of span that came up."""
    want = disclosed([t for _, t in texts])
    names = [*pii.KINDS, "generalise", "remove"]

    def told(spans):
        return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)

    expected = Counter()
    for d, t in texts:
        spans, safe = want[t or ""]
        base = [s for s in spans if s[1] < 4]
        counts = [sum(s[1] == k for s in base) for k in range(4)]
        expected[(d, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), hashlib.sha256(safe.encode()).hexdigest())] += 1
    got = pii.op6_disclosure(spark, path)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised_sha256"]
    assert Counter(map(tuple, got.collect())) == expected
    return {names[k] for spans, _ in want.values() for _, k, _ in spans}


def test_op6(spark, tables):
    path, rows, _ = tables
    assert check_op6(spark, path, [r[:2] for r in rows]) == {*pii.KINDS, "remove"}


def test_op6_where_entities_are_rare(spark, tmp_path):
    texts = [(0, "Li sits in r12, li.x@corp.example"), (1, "r12 is where LI sits"), (2, "Li"), (2, "Li"), (3, "Li sits in r12, li.x@corp.example")] + [(k, f"plain words sits in filler{k % 280}") for k in range(10, 310)]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert check_op6(spark, str(tmp_path), texts) == {"email", "generalise", "remove"}


def test_disclosure_counts_every_text_of_an_entity(spark):
    # the entity is in 1005 of 10,000 texts, in 1000 of them with no term beside it; the term in 20, 5 of them with the entity
    rows = [(k, f"{k}@x.example" if k >= 1005 else "all@x.example " + "\n" * k) for k in range(1000)]
    rows += [(k, f"all@x.example term u{k}") for k in range(1000, 1005)] + [(k, f"term v{k}") for k in range(1005, 1020)] + [(k, f"plain v{k}") for k in range(1020, 10_000)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    assert pii.sanitise(df).where("exists(_all, s -> s.found = 'term')").count() == 0


def test_sanitised_text(spark):
    text = "mail ann@corp.example or +1 389 555 5010, ask Zorblatt of r12"
    rows = [(0, text)] + [(k, f"ask the mail of {k} or plain words") for k in range(1, 400)] + [(500, "Zorblatt is in r12"), (501, "r12")]
    got = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)).collect()}
    assert got[0] == "mail [email] or [phone], ask  of [code]" and got[500] == " is in [code]" and got[7] == rows[7][1]


def test_op7(spark, tables, ids_of):
    path, rows, _ = tables
    got = packing.op7_best_fit_packing(spark, path).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = ids_of(t)
        want.update((d, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids))))
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1 + math.ceil(sum(r["length"] for r in got) / 2048 * 1.1)


def test_op8(spark, tables):
    path, rows, _ = tables
    fps = [simhash.fingerprint(t) for _, t, *_ in rows]
    groups = _near(fps, 3)
    least = {}
    for (d, *_), g in zip(rows, groups, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = Counter((d, f"{f:016x}", least.get(g)) for (d, *_), f, g in zip(rows, fps, groups, strict=True))
    assert Counter(map(tuple, simhash.op8_simhash_near_duplicates(spark, path).collect())) == want
