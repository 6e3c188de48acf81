"""Quality rules, licences, lines, personal data and decontamination against brute force on small tables."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework.llm import decontam, licenses, lines, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, lang="en", source="s"):
    rows = [(k, t, lang, source, len(t) if t else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a clashing extra column."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "some words here for the test", "en", "a", 1), (None, "some words here for the test", "en", "a", 1), (3, " \t\r\n\v", "xx", "b", 2), (4, long, "en", "a", 3), (4, long, "en", "a", 3), (5, "x" * 50_000, "en", None, 4)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(7)).withColumn("place", F.lit("p")).withColumn("term", F.lit(1.5))


def test_quality_base(spark):
    rng = random.Random(1)
    texts = ["a b c d e f g h " * 5, "one\ntwo\none\n\n \n two", "# $ % & words " * 30, "", None, "Ünï cödé #x\x85y z"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 120))) for _ in range(30)]
    for row in quality.quality(table(spark, texts)).collect():
        text = texts[row["doc_id"]] or ""
        w = WORD.findall(text)
        counts = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        said = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(said) - len(set(said)), len(covered))
        assert tuple(row)[1:6] == want
        assert row["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_rejects_what_diverges(spark):
    rng = random.Random(2)
    common = "the of and to in is it that was for on are as with his they at be this from".split()
    plain = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(60)]
    listed = " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(200))
    shouted = plain[0].upper()
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(table(spark, [*plain, listed, shouted, listed[:300]])).collect()}
    assert all(kept[k] for k in range(60)) and not kept[60] and not kept[61]
    assert kept[62]  # short texts are not judged by words


def prose(rng, n, common="the of and to in is it that was for on are as with his they at be this from"):
    return " ".join(rng.choice(common.split()) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_a_rare_language_is_not_its_own_measure(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, 120), "en", "s", 0) for k in range(60)]
    noise = " ".join("".join(rng.choices("#$%&*<>|~^=@", k=5)) for _ in range(80))
    rows += [(100 + k, noise + f" {k}", lang, "s", 0) for k, lang in enumerate(["zz", "en", None, ""])]
    rows += [(200 + k, prose(rng, 120, "ka lo mi nu pe ra so tu"), lang, "s", 0) for k, lang in enumerate(["yy", None])] + [(202, "".join(chr(0x4E00 + rng.randint(0, 999)) + " " * (k % 6 == 0) for k in range(400)), "xx", "s", 0)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[100 + k]["kept"] for k in range(4)) and all(got[100 + k]["char_distance"] > 0.5 for k in range(4))
    assert all(got[k]["kept"] and got[k]["word_distance"] is None for k in (200, 201, 202)) and got[0]["kept"] and got[0]["word_distance"] is not None


def test_every_language_has_its_own_reference(spark):
    rng = random.Random(13)
    spoken = {f"l{k}": " ".join("".join(rng.choices("klmnopqrstuvwxyz", k=3)) for _ in range(20)) for k in range(300)}
    rows = [(100 * k + j, prose(rng, 100, common), lang, "s", 0) for k, (lang, common) in enumerate(spoken.items()) for j in range(quality.MIN_DOCS)]
    rows.append((50, prose(rng, 100, spoken["l7"]), "l299", "s", 0))
    assert len(spoken) > quality.SET_LANGUAGES
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept.pop(50) and all(kept.values())


def _dice(text, template, threshold=0.8):
    """The best window of a template by brute force: (place, dice), or None."""
    ws, ts = licenses.normal(text or ""), licenses.normal(template)
    pairs, own = list(zip(ws, ws[1:], strict=False)), list(zip(ts, ts[1:], strict=False))
    last, b, best = max(0, len(pairs) - len(own)), set(own), None
    for at in sorted({min(i, last) for i, x in enumerate(pairs) if x in b} | {last}):
        a = set(pairs[at : at + len(own)])
        dice = 2 * len(a & b) / (len(a) + len(b))
        if dice >= threshold and (best is None or dice > best[1]):
            best = at, dice
    return best


def test_licenses(spark):
    rng = random.Random(20)
    gpl, mit = licenses.TEMPLATES["GPL-3.0 file header"], licenses.TEMPLATES["MIT text"]
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(gpl, 70))
    texts = ["Text.\nLicensed under the Apache License, Version 2.0.\nmore", "licensed UNDER the apache license version 2.0", "This is not a licence at all", "All rights reserved.", None, "", "Released under the MIT License. " * 9]
    texts += [f"{prose(rng, 40)}\n{wrapped}\n{prose(rng, 60)}", f"Copyright 2020 A. N. Other\n\n{mit}", f"Copyright 2020 X. Released under the MIT License. See LICENSE for details. {prose(rng, 30)}", "reserved", mit[: len(mit) * 3 // 4], mit[: len(mit) // 2]]
    for _ in range(40):
        ws = licenses.normal(rng.choice(list(licenses.TEMPLATES.values())))
        for _ in range(rng.randint(0, max(1, len(ws) // 8))):
            ws[rng.randrange(len(ws))] = rng.choice(["the", "of", "license", "changed"])
        texts.append(" ".join([prose(rng, rng.randint(0, 20)), *ws[rng.randint(0, 2) :], prose(rng, rng.randint(0, 20))]))
    found = {r["doc_id"]: {x["template"]: (x["place"], x["dice"]) for x in r["found"]} for r in licenses.scan(table(spark, texts)).collect()}
    assert found == {d: {n: best for n, t in licenses.TEMPLATES.items() if (best := _dice(text, t))} for d, text in enumerate(texts)}
    assert found[0] == {"Apache-2.0": (1, 1.0)} and found[6] == {"MIT": (0, 1.0)} and found[2] == found[4] == found[5] == found[10] == {}
    assert found[7]["GPL-3.0 file header"][1] == 1.0 and found[8]["MIT text"][1] == 1.0 and "MIT" in found[9] and "MIT text" in found[11] and "MIT text" not in found[12]


def test_many_templates(spark, monkeypatch):
    every = {f"t{k}": f"notice number {k} of this kind stands here" for k in range(450)}
    for size in (50_000, 40):
        monkeypatch.setattr(licenses, "BLOCK_BIGRAMS", size)
        named = every if size > 40 else dict(list(every.items())[425:])
        assert licenses.scan(table(spark, ["notice number 431 of this kind stands here"]), named, 0.99).first()["found"][0]["template"] == "t431"
    with pytest.raises(ValueError):
        licenses.scan(table(spark, ["x"]), {"one": "word"})


def test_bigram_hashes_are_the_engines(spark):
    pairs = [("the", "license"), ("é", "漢字"), ("a" * 40, "")]
    got = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b")).collect()
    assert [r[0] for r in got] == [licenses._hash(*p) for p in pairs]


def test_lines(spark):
    rows = [(k, f"own line number {k} here\n  shared on many sites \nshort\nshared on nine sites" if k < 9 else f"own line number {k} here\nshared on many sites\nshort", "en", f"s{k}", 0) for k in range(12)]
    rows += [(12, "shared on many sites", "en", None, 0), (13, None, "en", "s1", 0)]
    got = {r["doc_id"]: (r["text"], tuple(r["_lines"])) for r in lines.strip_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "shared on many sites" in got[0][0] and got[0][1] == (4, 0)
    for k in range(1, 9):
        assert got[k][0] == f"own line number {k} here\nshared on nine sites" and got[k][1] == (4, 2)
    assert got[12] == ("", (1, 1)) and got[13][0] is None


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_base(spark):
    rng = random.Random(3)
    texts = ["x a@b.c_d@e.f.g, a@b..c a@b", "1.2.3.4.5.6.7.8 0256.1.1.1 0255.01.1.1 999.1.1.1", "é4111 1111 1111 1111é 4111-1111-1111-1112", "+1 (389) 555-5010 +12 34", "", None, "9" * 20_000, "a." * 20_000 + "@x.y", "1-" * 3000 + "1"]
    texts += ["".join(rng.choices("a1234567890.@+-( )%_é", k=200)) for _ in range(150)]
    for row in pii.sanitise(table(spark, texts)).collect():
        got = [(s["start"], s["k"], s["end"]) for s in row["_spans"]]
        assert got == _base(texts[row["doc_id"]] or ""), texts[row["doc_id"]]


def test_disclosing_terms(spark):
    texts = [f"filler{k} common words\nasked Zorblatt about contact@secret.org today common" for k in range(8)]
    texts += [f"nothing common here today filler{k} asked about" for k in range(200)] + ["Zorblatt alone"]
    got = {r["doc_id"]: r for r in pii.sanitise(table(spark, texts)).collect()}
    spans = [(texts[3][s["start"] : s["end"]], s["k"]) for s in got[3]["_all"]]
    assert ("contact@secret.org", 0) in spans and ("Zorblatt", len(pii.KINDS) + 1) in spans
    assert not any(w in ("common", "today", "asked", "about") for w, _ in spans)
    assert [s["k"] for s in got[3]["_spans"]] == [0] and len(got[100]["_all"]) == 0


def test_rare_and_distant_terms_disclose(spark):
    texts = ["Li sits in r12\n" + "common words " * 20 + "\nmail li.x@secret.org today", "common words today\nr12 is where LI sits", "Li"]
    texts += [f"common words today sits in mail is where filler{k}" for k in range(200)]
    got = {r["doc_id"]: [(texts[r["doc_id"]][s["start"] : s["end"]], s["k"]) for s in r["_all"]] for r in pii.sanitise(table(spark, texts)).collect()}
    low, high = len(pii.KINDS), len(pii.KINDS) + 1
    # one document has the entity; of 203, Li is in 3 (0.79 of what tells it) and r12 in 2 (0.87)
    assert got[0] == [("Li", low), ("r12", high), ("li.x@secret.org", 0)]
    assert got[1] == [("r12", high), ("LI", low)] and got[2] == [("Li", low)] and got[100] == []


def test_decontamination(spark):
    rng = random.Random(4)

    def prose(n):
        return [f"w{rng.randint(0, 4000)}" for _ in range(n)]

    items = [prose(40) for _ in range(25)] + [prose(5), prose(4)]
    docs, want = [], set()
    for k in range(60):
        body = prose(300)
        if k < 20:
            leaked = list(items[k])
            if k % 2:
                leaked[20] = "changed"  # one word of 40: 31 of 41 shingles are shared
            body[100:100] = leaked
        elif k < 25:
            body = items[k][: 38]
        docs.append(" ".join(body))
    docs += [" ".join(items[3]).upper().replace(" ", ",  "), "", None, " ".join(items[26])]

    def shingles(t):
        ws = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
        return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]

    parts = [shingles(" ".join(i)) for i in items]
    for d, t in enumerate(docs):
        own = shingles(t)
        for i, p in enumerate(parts):
            for k in range(max(1, len(own) - len(p) + 1)):
                a, b = Counter(own[k : k + len(p)]), Counter(p)
                if p and own and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(table(spark, docs), bench).collect()}
    assert found == want and {(60, 3), (0, 0)} <= found
    left = {r["doc_id"] for r in decontam.without_benchmark(table(spark, docs), bench).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in want}


def test_decontamination_ignores_order(spark):
    rng = random.Random(7)
    items = [[f"w{rng.randint(0, 4000)}" for _ in range(60)] for _ in range(8)]
    around = [[f"v{rng.randint(0, 4000)}" for _ in range(50)] for _ in range(16)]
    swapped = [" ".join([*around[k], *t[30:], *t[:30], *around[k + 8]]) for k, t in enumerate(items)]
    ends = [" ".join([*around[0], *items[0][30:], *items[0][:30]]), " ".join([*items[1][30:], *items[1][:30], *around[1]])]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(table(spark, swapped + ends), bench).collect()}
    assert found == pytest.approx({(k, k): 52 / 60 for k in range(8)} | {(8, 0): 52 / 60, (9, 1): 52 / 60})


def test_phrases_that_many_items_share(spark):
    rng = random.Random(14)
    phrase = [f"shared{k}" for k in range(12)]
    items = [phrase + [f"w{rng.randint(0, 4000)}" for _ in range(20)] for _ in range(30)] + [phrase]
    texts = [" ".join(i) for i in items[:5]] + [" ".join(phrase * 3), " ".join(phrase[:6]), " ".join(phrase) + " and some other words"]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([*items, items[2], items[2]])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(table(spark, texts * 2), bench).collect()}
    want = {(k, k) for k in range(5)} | {(2, 31), (2, 32), (5, 30), (7, 30)} | {(k, 30) for k in range(5)}
    assert found == want | {(d + 8, i) for d, i in want}


def test_recall_at_the_threshold(spark):
    rng = random.Random(15)
    items = [[f"w{rng.randint(0, 9000)}" for _ in range(n)] for n in (50, 96, 187) for _ in range(150)]
    texts = []
    for t in items:
        m, body = len(t) - 4, list(t)
        for at in rng.sample(range(4, len(body) - 4, 5), m // 45):  # a changed word costs five shingles of each side: similarity 0.80 to 0.82
            body[at] = f"x{rng.randint(0, 9000)}"
        texts.append(" ".join(body))

    def shingles(ws):
        return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))

    want = set()
    for k, (t, own) in enumerate(zip(items, texts, strict=True)):
        a, b = shingles(t), shingles(own.split())
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            want.add((k, k))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(table(spark, texts), bench).collect()}
    assert set(found) <= want and len(want) > 150 and min(found.values()) < 0.83
    assert len(found) >= 0.97 * len(want)


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 40)
    texts = [" ".join(f"t{k}x{j}" for j in range(30)) for k in range(6)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(table(spark, texts), bench).collect()} == {(k, k) for k in range(6)}


def test_simhash_by_columns(spark):
    rng = random.Random(5)
    for n in (1, 2, 37):
        hs = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)
        got = spark.createDataFrame([(hs,)], "hs array<bigint>").select(decontam._simhash(F.col("hs"))).first()[0]
        assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("op", ["quality", "licenses", "lines", "pii", "decontam"])
def test_odd_rows_and_empty_tables(spark, op):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "some words here for the test")], "item_id long, text string")
    run = {"quality": quality.quality, "licenses": licenses.scan, "lines": lines.strip_lines, "pii": pii.sanitise, "decontam": lambda d: decontam.without_benchmark(d, bench)}[op]
    assert run(odd(spark).limit(0)).count() == 0
    got = run(odd(spark)).collect()
    assert len(got) == (6 if op == "decontam" else 8)
    if op == "pii":
        assert got[0]["_spans"] is not None and hashlib.sha256(b"").hexdigest()
