"""Operator 1 (native): quality rules on distribution divergence.

Each language's reference is counted over the documents that carry the language: shares of character classes, and shares
of its most common words with one share for all others. A document is rejected if the Jensen-Shannon distance (base 2,
square root, 0 to 1) of its own shares to its language's is over a threshold. Texts shorter than the guards aren't judged
by that rule, as few counts lie far from any reference by chance alone.

A reference must not follow what it judges. So each distinct text of a language has the same weight, shared by its copies
and spread over its words and characters: neither copies nor long texts move a reference. Weights are whole parts of
WEIGHT, and sums of whole numbers are the same in any order. A language of fewer than MIN_DOCS distinct texts would be its
own measure and has no reference: its documents, like those without a language, are judged by characters alone, against
all documents, with letters of any script and case as one class.

The documents are scanned, never shuffled. Each task, and then each of SALTS parts of the vocabulary, names its most
common words of a language, so a language that most documents share gathers COMMON words a part in a task, not a row a
word. References are COMMON + 8 numbers a language; they are broadcast up to a number of languages, and beyond it
documents meet them by a shuffle. All steps are DataFrame functions.

Defined cases: a null or blank text has no words and fails the base rule; a null text is in no reference; a null or
empty language is none; repeated rows and ids are each judged; an empty table gives no rows; other columns, whatever
their names, are carried by judge() and ignored by quality().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, scratch, small, whole, words, written

COMMON, SALTS, SET_LANGUAGES = 24, 32, 256
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.30
MIN_TOKENS, MAX_WORD_DISTANCE = 80, 0.33
MIN_DOCS, WEIGHT = 20, 1_000_000_000
WINDOW, SYMBOLS = 8, "#*$%&|<>"
NONE = ""
#: Character classes that are counted by a pattern; what is left over is the class of lower-case and other letters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "space": "", "symbol": r"[#*$%&|<>^~=@\\_+]", "mark": r"[.,;:!?'\"()/\[\]{}`-]", "wide": r"[^\x00-\x7F]"}
#: The classes that any script has; all other characters count as letters where no language's reference is at hand.
GENERAL = ["digit", "space", "symbol", "mark"]


def _distance(p: Column, q: Column) -> Column:
    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def _with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds _c, the counts of CLASSES: what is left without lower-case letters, then without white space, is short and quickly searched."""
    df = df.withColumn("_r", F.regexp_replace(text, "[a-z]+", "")).withColumn("_r2", F.regexp_replace("_r", f"[{SPACE}]+", ""))
    spaces = F.char_length("_r") - F.char_length("_r2")
    return df.withColumn("_c", F.array(*((F.regexp_count("_r2", F.lit(p)) if p else spaces).cast("long") for p in CLASSES.values()))).drop("_r")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _weighted(rows: DataFrame, folder: str) -> DataFrame:
    """Adds _copies: how many rows have the language and the text."""
    same = ["lang", "_h1", "_h2"]
    rows = rows.withColumns({"_h1": F.xxhash64("text"), "_h2": F.hash("text", F.lit(1))})
    copies = written(rows.groupBy(*same).agg(F.count("*").alias("_copies")).where("_copies > 1"), folder, "copies")
    return rows.join(small(copies), same, "left").select("lang", "text", F.coalesce("_copies", F.lit(1)).alias("_copies"))


def references(docs: DataFrame, folder: str) -> tuple[DataFrame, list[float]]:
    """One row a language that has a reference: lang, ref_words, ref_word_shares, ref_char_shares; and the shares of all documents by
    GENERAL classes."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows, names = _weighted(rows, folder), [*CLASSES, "rest"]
    size, weight = F.greatest(F.char_length("text").cast("long"), F.lit(1)), F.lit(float(WEIGHT))
    counted = _with_classes(rows, "text").withColumn("_n", size)
    counts = [*(F.col("_c")[k] for k in range(len(CLASSES))), F.char_length("text").cast("long")]
    parts = [F.round(c * (weight / (F.col("_n") * F.col("_copies")))).cast("long").alias(n) for c, n in zip(counts, names, strict=True)]
    counted = counted.select("lang", *parts, F.round(weight / F.col("_copies")).cast("long").alias("n_texts"))
    counted = written(counted.groupBy("lang").agg(F.round(F.sum("n_texts") / WEIGHT).alias("n_texts"), *(F.sum(n).alias(n) for n in names)), folder, "characters")
    total = counted.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    everything = max(total["rest"], 1)
    told = [total[n] for n in GENERAL]
    general = [x / everything for x in (*told, total["rest"] - sum(told))]
    shares = F.array(*(F.col(n) / F.col("all") for n in CLASSES), (F.col("all") - reduce(Column.__add__, map(F.col, CLASSES))) / F.col("all"))
    chars = counted.where((F.col("lang") != NONE) & (F.col("n_texts") >= MIN_DOCS)).withColumn("all", F.greatest(F.col("rest"), F.lit(1))).select("lang", shares.alias("ref_char_shares"))

    # outer: else a filter on the array's size would split the text twice
    split = rows.where(F.col("lang") != NONE).select("lang", "_copies", _tokens(F.col("text")).alias("ws"))
    split = split.select("lang", F.round(weight / (F.greatest(F.size("ws"), F.lit(1)) * F.col("_copies"))).cast("long").alias("u"), F.explode_outer("ws").alias("w"))
    spelled = written(split.where("w IS NOT NULL").groupBy("lang", "w").agg(F.sum("u").alias("n")), folder, "words")
    ranked = spelled.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "w"))).where(F.col("k") <= COMMON)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("top"))
    sums = spelled.groupBy("lang").agg(F.sum("n").alias("all_n"))
    common = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    word_shares = F.concat(F.transform("top", lambda x: x["n"] / F.col("all_n")), F.array((F.col("all_n") - common) / F.col("all_n")))
    spoken = top.join(sums, "lang").select("lang", F.col("top.w").alias("ref_words"), word_shares.alias("ref_word_shares"))
    return written(chars.join(spoken, "lang", "left"), folder, "references"), general


def repeats_in_order(hashes: Column) -> Column:
    """The windows' hashes with their places, in order; null if no hash occurs twice."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered)


def repeated_words(ordered: Column) -> Column:
    """How many words lie in a window that the text has twice or more."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:bigint>"))
    rest = F.size(ordered) - 1
    beside = F.arrays_zip(ordered.alias("own"), F.concat(none, F.slice(ordered, 1, rest)).alias("before"), F.concat(F.slice(ordered, 2, rest), none).alias("after"))
    twice = F.filter(beside, lambda t: (t["own"]["h"].eqNullSafe(t["before"]["h"])) | (t["own"]["h"].eqNullSafe(t["after"]["h"])))
    places = F.sort_array(F.transform(twice, lambda t: t["own"]["i"]))
    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.coalesce(covered, F.lit(0).cast("long"))


def judge(docs: DataFrame, refs: DataFrame, general: list[float]) -> DataFrame:
    """`row`, the input's row as a struct, and `verdict`: n_words, the base counts, base_failed, kept and both distances, null where not judged."""
    df = docs.select(whole(docs).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"), F.col("lang").cast("string").alias("lang"))
    df = df.join(small(refs, 50_000), "lang", "left")
    text, ws = F.col("_t"), F.col("_w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    n = F.size(ws)
    df = _with_classes(df, "_t").withColumns({"_w": words(text), "_k": _tokens(text), "_l": lines, "_n": F.char_length(text)})
    # a literal set is looked up by hash, an array from end to end: with few languages only words that some reference has are compared
    told = {w for r in refs.select("ref_words").collect() for w in r[0] or []} if refs.count() <= SET_LANGUAGES else None
    common = F.col("_k") if told is None else F.filter("_k", lambda w: w.isin(sorted(told))) if told else F.array().cast("array<string>")
    df = df.withColumns({"_common": common, "_h1": F.transform(ws, lambda w: F.xxhash64(w))})
    # hashes of 2, 4 and 8 words, each of two halves; a text of fewer words has none
    for k, (short, long) in zip((1, 2, 4), (("_h1", "_h2"), ("_h2", "_h4"), ("_h4", "_h8")), strict=True):
        m = F.size(short) - k
        joined = F.zip_with(F.slice(short, 1, m), F.slice(short, 1 + k, m), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(long, F.when(m > 0, joined).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumns({"_s": repeats_in_order(F.col("_h8"))})
    size = F.size("_k")
    own = F.transform("ref_words", lambda w: (F.size("_common") - F.size(F.array_remove("_common", w))).cast("double"))
    df = df.withColumns({"_own": F.when((size >= MIN_TOKENS) & F.col("ref_words").isNotNull(), own), "_base": F.struct(
        n.cast("long").alias("n_words"), F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"), F.regexp_count("_r2", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_s")).alias("n_repeat_words"),
    )})
    in_common = F.aggregate("_own", F.lit(0.0), lambda a, x: a + x)
    word_distance = F.when(F.col("_own").isNotNull(), _distance(F.transform(F.concat("_own", F.array(size - in_common)), lambda x: x / size), F.col("ref_word_shares")))
    letters = F.col("_n") - F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = _distance(F.transform(F.concat("_c", F.array(letters)), lambda x: x / F.col("_n")), F.col("ref_char_shares"))
    told = [F.col("_c")[k] for k, c in enumerate(CLASSES) if c in GENERAL]
    by_general = _distance(F.transform(F.array(*told, F.col("_n") - reduce(Column.__add__, told)), lambda x: x / F.col("_n")), F.array(*map(F.lit, general)))
    char_distance = F.when(F.col("_n") >= MIN_CHARS, F.when(F.col("ref_char_shares").isNotNull(), by_class).otherwise(by_general))
    df = df.withColumns({"_wd": word_distance, "_cd": char_distance})
    failed = (F.col("_base.n_words") < 20) | (100 * F.col("_base.n_repeat_words") > 30 * F.col("_base.n_words"))
    kept = ~failed & F.coalesce(F.col("_wd") <= MAX_WORD_DISTANCE, F.lit(True)) & F.coalesce(F.col("_cd") <= MAX_CHAR_DISTANCE, F.lit(True))
    verdict = F.struct("_base.*", failed.alias("base_failed"), kept.alias("kept"), F.round("_cd", 9).alias("char_distance"), F.round("_wd", 9).alias("word_distance"))
    return df.select("row", verdict.alias("verdict"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance (to 9 digits)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return judge(rows, *references(rows, scratch(docs.sparkSession))).select("row.doc_id", "verdict.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    folder = scratch(docs.sparkSession)
    # written whole: a filter over the judgement would be pushed into it, and computes it again at every step
    judged = written(judge(docs, *references(docs, folder)), folder, "judged")
    return judged.where("verdict.kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def _sql_distance(p: str, q: str) -> str:
    def term(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"

    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({term(f'{p}[i]')} + {term(f'{q}[i]')}) / 2))))"


def _sql_count(pattern: str, text: str = "t") -> str:
    return "length({0}) - length(regexp_replace({0}, '{1}', '', 'g'))".format(text, pattern.replace("'", "''"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ks, text IS NOT NULL AS there FROM documents),
c AS MATERIALIZED (SELECT *, [{", ".join(_sql_count(p or "[ \\t-\\r]") for p in CLASSES.values())}] AS cs, length(t) AS n, count(*) OVER (PARTITION BY coalesce(lang, ''), t, there) AS copies FROM d),
sums AS MATERIALIZED (SELECT coalesce(lang, '') AS g, round(sum(round({WEIGHT}.0::DOUBLE / copies)::BIGINT) / {WEIGHT}.0::DOUBLE) AS n_texts,
  {", ".join(f"sum(round(cs[{i + 1}] * ({WEIGHT}.0::DOUBLE / (greatest(n, 1) * copies)))::BIGINT) AS c{i}" for i in range(len(CLASSES)))},
  sum(round(n * ({WEIGHT}.0::DOUBLE / (greatest(n, 1) * copies)))::BIGINT) AS total FROM c WHERE there GROUP BY 1),
everything AS (SELECT [{", ".join(f"sum(c{i}) / greatest(sum(total), 1)" for i, k in enumerate(CLASSES) if k in GENERAL)}, (sum(total) - {" - ".join(f"sum(c{i})" for i, k in enumerate(CLASSES) if k in GENERAL)}) / greatest(sum(total), 1)] AS gq FROM sums),
refc AS (SELECT g, [{", ".join(f"c{i} / greatest(total, 1)" for i in range(len(CLASSES)))}, (greatest(total, 1) - {" - ".join(f"c{i}" for i in range(len(CLASSES)))}) / greatest(total, 1)] AS q FROM sums WHERE g <> '' AND n_texts >= {MIN_DOCS}),
spoken AS (SELECT g, w, sum(u) AS m FROM (SELECT lang AS g, ks, round({WEIGHT}.0::DOUBLE / (greatest(len(ks), 1) * copies))::BIGINT AS u FROM c WHERE there AND lang <> '') x, unnest(x.ks) AS u(w) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, w) AS r, sum(m) OVER (PARTITION BY g) AS total FROM spoken),
refw AS (SELECT g, list(w ORDER BY r) AS words, list_append(list(m / total ORDER BY r), (any_value(total) - sum(m)) / any_value(total)) AS q FROM ranked WHERE r <= {COMMON} AND g IN (SELECT g FROM refc) GROUP BY g),
own AS (SELECT c.*, refc.q AS cq, refw.q AS wq, gq, list_transform(refw.words, lambda w: len(list_filter(ks, lambda x: x = w))) AS found FROM c CROSS JOIN everything LEFT JOIN refc ON refc.g = c.lang LEFT JOIN refw ON refw.g = c.lang),
p AS (SELECT *, list_transform(list_append(cs, n - list_sum(cs)), lambda x: x / n) AS cp, list_transform(list_append(found, len(ks) - list_sum(found)), lambda x: x / len(ks)) AS wp,
  list_transform([{", ".join(f"cs[{i + 1}]" for i, k in enumerate(CLASSES) if k in GENERAL)}, n - {" - ".join(f"cs[{i + 1}]" for i, k in enumerate(CLASSES) if k in GENERAL)}], lambda x: x / n) AS gp FROM own),
far AS MATERIALIZED (SELECT *, CASE WHEN n >= {MIN_CHARS} THEN CASE WHEN cq IS NOT NULL THEN {_sql_distance("cp", "cq")} ELSE {_sql_distance("gp", "gq")} END END AS cd,
  CASE WHEN len(ks) >= {MIN_TOKENS} AND wq IS NOT NULL THEN {_sql_distance("wp", "wq")} END AS wd FROM p),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS p FROM d WHERE len(ws) >= {WINDOW}),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[p:p + {WINDOW - 1}], ' ')) AS n FROM s),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS k FROM twice WHERE n > 1) GROUP BY 1),
base AS (SELECT far.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, {_sql_count("[#*$%&|<>]")} AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, cd, wd FROM far LEFT JOIN rep ON rep.doc_id = far.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(wd <= {MAX_WORD_DISTANCE}, true) AND coalesce(cd <= {MAX_CHAR_DISTANCE}, true) AS kept,
  round(cd, 9) AS char_distance, round(wd, 9) AS word_distance FROM base
"""
