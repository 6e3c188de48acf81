r"""Operator 6 (native): personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity c.
Terms t are the words, of any length, outside the spans of a document. Over all distinct texts, p(t) and p(c) are the
shares that have t and c, p(c, t) the share that has both; copies of a text are one, so they lend no support. Pointwise
mutual information log(p(c, t) / (p(c) p(t))) is what t tells of c; over c's own information, log(1 / p(c)), it is the
part of c that t discloses. From GENERALISE up the term is to be generalised, from REMOVE up removed, wherever it stands,
in documents without the entity too.

By that measure alone any word of few texts discloses any entity beside it: if c is in one text of a billion, a word of
a thousand texts tells most of c's thirty bits, and still leaves a thousand texts to choose from. So a term is only
weighed if it leaves at most LEFT bits of c open: log2(1 / p(c | t)), with one further text that has t and not c, as few
texts prove little. That asks for no support and no least length, and doesn't depend on the corpus's size: of the texts
that have a marked term, one in four at least has the entity. A term that also stands in texts without c may have met c
by chance: if q is the share of texts that hold any entity, chance alone sets n(t) q of its texts beside one, and the
term is weighed if that is at most CHANCE of those that it shares with c. So where entities are common a rare word's one
meeting with one of them marks no other text.

Entities that the same texts have can't be told apart and are one class, so a list of many addresses costs its document
one entity's pairs. Words are written once, by document, and counted with partial sums. All joins are equi-joins, and all
steps are DataFrame functions.

sanitise() returns the text made safe: each base span gives way to its kind in brackets, a term to be generalised to
its shape (number, name, code or word), and one to be removed to nothing.

Patterns are written so that no text makes them slow: runs are matched possessively and start where a run starts.
They give the same matches as the plain forms
    [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    [0-9]([\x20-]?[0-9])+                                  \+[0-9][\x20().0-9-]+[0-9]
with parts up to 255; 12 to 19 digits and the Luhn sum; 9 to 15 digits.

Defined cases: a null text is empty and has no spans; a null doc_id is kept; rows of equal text get the same spans; no
entity or no disclosing term leaves the base spans; base spans that overlap are covered by one run of kinds; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, small, written

GENERALISE, REMOVE, LEFT, CHANCE = 0.6, 0.85, 2.0, 0.05
_TEXT = ["_h1", "_h2"]
#: Spans and terms, some 50 bytes each, of texts that have any: up to this many are broadcast; beyond it texts meet them by a shuffle.
BROADCAST_SPANS = 500_000
_WORD = r"[\p{L}\p{N}]+"
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, what a text must hold for the pattern to be tried)
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = list(PATTERNS)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CUT = "array<struct<at:bigint,start:bigint,k:int,found:string>>"
_SPAN = "array<struct<start:bigint,k:int,end:bigint,found:string>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(a: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), value) % 10 == 0


def _right(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = _digits(found)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _placed(pieces: Column, found: Column, k: int) -> Column:
    """Spans of matches, from what lies between them. Places are code points, ends exclusive."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["found"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end"), x["found"].alias("found")))).alias("spans"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found"))
    return F.aggregate(zipped, zero, add, lambda a: a["spans"])


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds _spans: the base spans in order of start and kind."""
    kinds = []
    for k, (kind, (pattern, needs)) in enumerate(PATTERNS.items()):
        found, pieces = f"_f{k}", f"_p{k}"
        worth = F.contains(F.col(text), F.lit(needs)) if needs else F.col(text).rlike("[0-9]")
        df = df.withColumn(found, F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
        spans = F.when(F.size(found) > 0, _placed(F.col(pieces), F.col(found), k)).otherwise(F.array().cast(_SPAN))
        df = df.withColumn(f"_s{k}", spans)
        kinds.append(_kept(F.col(f"_s{k}"), kind))
    df = df.withColumn("_spans", F.array_sort(F.concat(*kinds)))
    return df.drop(*(f"_{c}{k}" for c in "fps" for k in range(len(PATTERNS))))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _right(kind, s["found"]))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "generalise", "remove"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(s: Column) -> Column:
    value = F.when(s["k"] >= 2, _digits(s["found"])).otherwise(F.lower(s["found"]))
    return F.concat(s["k"].cast("string"), F.lit(":"), value)


def _outside(text: Column, spans: Column) -> Column:
    """The text with a line break for each span."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        piece = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece, F.lit("\n")).alias("out"))

    return F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))


def _marked(text: Column, terms: Column) -> Column:
    """Spans of a text's words that are in a map of terms to kinds."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(a: Column, w: Column) -> Column:
        end = a["at"] + F.char_length(w)
        k = F.element_at(terms, F.lower(w))
        span = F.struct(a["at"].alias("start"), k.alias("k"), end.alias("end"), w.alias("found"))
        return F.struct(end.alias("at"), F.when(k.isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(span))).alias("spans"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(rf"{_WORD}|[^\p{{L}}\p{{N}}]+"), F.lit(0)), start, add, lambda a: a["spans"])


def disclosing(based: DataFrame, folder: str) -> DataFrame:
    """term, k (the span kind that the term's greatest disclosure asks for). based: _row, _h1, _h2, _spans, _terms."""
    copies = written(based.groupBy(*_TEXT).agg(F.min("_row").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n"), folder, "copies")
    texts = based.join(small(copies), _TEXT, "left").where("_first IS NULL OR _first = _row").select(*_TEXT, "_spans", "_terms")
    held = texts.where(F.size("_spans") > 0).select(*_TEXT, F.array_distinct(F.transform("_spans", _entity)).alias("entities"), "_terms")
    n, n_held = texts.agg(F.count("*"), F.count_if(F.size("_spans") > 0)).first()

    named = held.select(*_TEXT, F.explode("entities").alias("entity"))
    alike = named.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor("_h1").alias("x1"), F.bit_xor(F.xxhash64(*_TEXT)).alias("x2"))
    classes = named.join(alike, "entity").select(*_TEXT, "n_entity", "x1", "x2").distinct()
    pairs = classes.join(held.select(*_TEXT, "_terms"), _TEXT).select("n_entity", "x1", "x2", F.explode("_terms").alias("term"))
    pairs = pairs.groupBy("n_entity", "x1", "x2", "term").agg(F.count("*").alias("both"))

    counts = texts.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    scored = pairs.join(counts, "term")
    open_bits = F.log2((F.col("n_term") + 1) / F.col("both"))
    told = F.log(F.col("both") * n / (F.col("n_entity") * F.col("n_term")))
    own = F.log(F.lit(float(n)) / F.col("n_entity"))
    met = (F.col("n_term") == F.col("both")) | (F.col("n_term") * (n_held / max(n, 1)) <= CHANCE * F.col("both"))
    scored = scored.withColumn("part", F.when(own > 0, told / own).otherwise(0.0)).where((F.col("part") >= GENERALISE) & (open_bits <= LEFT) & met)
    kind = F.when(F.max("part") >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS))
    return written(scored.groupBy("term").agg(kind.alias("k")), folder, "disclosing")


def _shape(found: Column) -> Column:
    """What a term is generalised to."""
    return (
        F.when(found.rlike(r"^\p{N}+$"), "[number]").when(found.rlike(r"\p{N}"), "[code]")
        .when(found.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    )


def _cut(spans: Column) -> Column:
    """Spans in order of start, each with where the text before it begins: the greatest end so far."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast(_CUT).alias("out"))

    def add(a: Column, s: Column) -> Column:
        one = F.struct(a["at"].alias("at"), s["start"].alias("start"), s["k"].alias("k"), s["found"].alias("found"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(spans, start, add)


def _safe(text: Column, cut: Column) -> Column:
    """The text with its spans replaced."""
    tags = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def piece(s: Column) -> Column:
        new = F.when(s["k"] < len(KINDS), F.get(tags, s["k"])).when(s["k"] == len(KINDS), _shape(s["found"])).otherwise("")
        return F.concat(F.substr(text, (s["at"] + 1).cast("int"), F.greatest(s["start"] - s["at"], F.lit(0)).cast("int")), new)

    return F.concat(F.array_join(F.transform(cut["out"], piece), ""), F.substr(text, (cut["at"] + 1).cast("int")))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text (the input's), sanitised, _spans (base) and _all (base and disclosing terms): arrays of (start, k, end, found)."""
    folder = scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"_h1": F.xxhash64("text"), "_h2": F.hash("text", F.lit(1))})
    based = base_spans(rows, "text").withColumn("_out", F.when(F.size("_spans") > 0, _outside(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
    terms = F.array_distinct(F.transform(F.regexp_extract_all("_out", F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))
    based = written(based.select(F.monotonically_increasing_id().alias("_row"), *_TEXT, "_spans", terms.alias("_terms")), folder, "spans")
    found = disclosing(based, folder)
    hits = based.select(*_TEXT, F.explode("_terms").alias("term")).join(small(found, 300_000), "term").distinct()
    hits = hits.groupBy(*_TEXT).agg(F.map_from_entries(F.collect_list(F.struct("term", "k"))).alias("_told"))
    # texts with a span or a term, once each; all other rows stay in their scan
    spans = based.where(F.size("_spans") > 0).groupBy(*_TEXT).agg(F.first("_spans").alias("_base"))
    touched = written(spans.join(hits, _TEXT, "full"), folder, "touched")
    none = F.array().cast(_SPAN)
    n_spans = touched.agg(F.sum(F.coalesce(F.size("_base"), F.lit(0)) + F.coalesce(F.size("_told"), F.lit(0)))).first()[0] or 0
    joined = rows.join(F.broadcast(touched) if n_spans <= BROADCAST_SPANS else touched, _TEXT, "left").withColumn("_base", F.coalesce("_base", none))
    extra = F.when(F.col("_told").isNotNull(), _marked(F.col("text"), F.col("_told"))).otherwise(none)
    apart = F.filter(extra, lambda t: ~F.exists("_base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    joined = joined.withColumn("_all", F.when(F.col("_told").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", apart))))
    joined = joined.withColumn("_cut", F.when(F.size("_all") > 0, _cut(F.col("_all"))))
    safe = F.when(F.col("_cut").isNotNull(), _safe(F.col("text"), F.col("_cut"))).otherwise(F.col("text"))
    return joined.select("doc_id", "text", safe.alias("sanitised"), F.col("_base").alias("_spans"), "_all")


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and sanitised_sha256; disclosing terms are spans of kind
    generalise or remove."""
    df = sanitise(documents(spark, sf_dir))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    told = [F.sha2(_told(F.col("_spans")), 256).alias("base_sha256"), _told(F.col("_all")).alias("spans"), F.sha2(F.col("sanitised"), 256).alias("sanitised_sha256")]
    return df.select("doc_id", *counts, *told)


def _count(k: int) -> Column:
    return F.size(F.filter("_spans", lambda s: s["k"] == k)).cast("long")
