"""Source documents to staged tables: the shaping that frameworks' published files need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import kebab, slugify, snake_names, squish, squished
from ..sources.tables import blocks


def elements_of_type(elements: DataFrame, kind: str) -> DataFrame:
    """element_id, element_type, title, text, doc_id of one type, squished."""
    found = elements.where(F.col("element_type") == kind)
    return squished(found.selectExpr("element_identifier AS element_id", "element_type", "title", "text", "doc_identifier AS doc_id"))


def role_statements(elements: DataFrame, relations: DataFrame, role: str = "work_role", statements: tuple[str, ...] = ("task", "knowledge", "skill")) -> DataFrame:
    """Edges from roles to statements with both ends' attributes; edges of other types drop out."""
    roles = elements_of_type(elements, role).selectExpr("element_id AS work_role_id", "title AS work_role_title")
    said = reduce(DataFrame.unionByName, [elements_of_type(elements, s) for s in statements]).selectExpr("element_id AS statement_id", "element_type AS statement_type", "text AS statement_text")
    edges = relations.selectExpr("source_element_identifier AS work_role_id", "dest_element_identifier AS statement_id").distinct()
    return edges.join(roles, "work_role_id").join(said, "statement_id").select("work_role_id", "work_role_title", "statement_id", "statement_type", "statement_text").orderBy("work_role_id", "statement_type", "statement_id")


def role_categories(elements: DataFrame, relations: DataFrame, role: str = "work_role", category: str = "category") -> DataFrame:
    """work_role_id, category_id, whichever way the relation points."""
    roles, groups = (elements_of_type(elements, k).select("element_id") for k in (role, category))
    ends = relations.selectExpr("source_element_identifier AS a", "dest_element_identifier AS b")
    both = ends.unionByName(ends.selectExpr("b AS a", "a AS b"))
    found = both.join(roles.withColumnRenamed("element_id", "a"), "a", "left_semi").join(groups.withColumnRenamed("element_id", "b"), "b", "left_semi")
    return found.selectExpr("a AS work_role_id", "b AS category_id").distinct()


def profile_catalog(profiles: DataFrame) -> DataFrame:
    """profile_id (a slug of the title), title, alternative_titles, summary_statement, mission."""
    return profiles.select(slugify(F.col("title")).alias("profile_id"), "title", F.array_join("alternative_titles", " | ").alias("alternative_titles"), "summary_statement", "mission")


def profile_elements(profiles: DataFrame) -> DataFrame:
    """profile_id, element_type, element_index (from 1), element_text."""
    fields = {"main_tasks": "task", "key_skills": "skill", "key_knowledge": "knowledge", "deliverables": "deliverable"}
    parts = [profiles.select(slugify(F.col("title")).alias("profile_id"), F.lit(kind).alias("element_type"), F.posexplode(column).alias("at", "element_text")) for column, kind in fields.items()]
    return reduce(DataFrame.unionByName, parts).select("profile_id", "element_type", (F.col("at") + 1).alias("element_index"), squish(F.col("element_text")).alias("element_text"))


def profile_competences(profiles: DataFrame) -> DataFrame:
    """profile_id, ecf_code, ecf_competence_name, proficiency_level; a level that is no number is null."""
    rows = profiles.select(slugify(F.col("title")).alias("profile_id"), F.explode("ecompetences").alias("c"))
    return rows.select("profile_id", F.get("c", F.lit(0)).alias("ecf_code"), F.get("c", F.lit(1)).alias("ecf_competence_name"), F.get("c", F.lit(2)).try_cast("int").alias("proficiency_level"))


def named_rows(sheet: DataFrame, key: str) -> DataFrame:
    """A sheet with normalised column names, squished, without rows that have no key."""
    df = squished(sheet.toDF(*snake_names(sheet.columns)))
    return df.where(F.length(F.trim(key)) > 0)


def rows_with(sheet: DataFrame, pattern: str) -> DataFrame:
    """Rows with any cell that matches."""
    return sheet.where(F.exists(F.array(*(F.col(f"`{c}`").cast("string") for c in sheet.columns)), lambda x: F.coalesce(x.rlike(pattern), F.lit(False))))


#: Columns that number the elements of a master list, as their names are normalised here or elsewhere.
MASTER_KEYS = ("dcwf_number", "dcwf_num", "dcwf")


def master_list(sheet: DataFrame) -> DataFrame:
    """A master list of tasks and skills, squished, with normalised names; rows without a number are headings and drop out."""
    key = next((c for c in snake_names(sheet.columns) if c in MASTER_KEYS), None)
    if key is None:
        raise ValueError(f"no column of {', '.join(MASTER_KEYS)}")
    return named_rows(sheet, key)


def table_file(name: str) -> str:
    """A staged file's name for a source table's: CamelCase to kebab-case."""
    import re

    return re.sub("([a-z])([A-Z])", r"\1-\2", name).lower()


def kebab_names(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, kebab(F.col(column)))


#: A standard's id: grade band, theme, sub-concept, sequence.
STANDARD = r"\b((?:K-2|3-5|6-8|9-12))\.([A-Z]+)\.([A-Z]+)(?:\.(\d+))?\b"
#: What page furniture looks like inside a block.
FURNITURE = r"(?i)page \d+( of \d+)?|©.*$|\bcc by[- a-z0-9.]*\b|www\.\S+|Ver\.\s*1\.0"
#: The themes and sub-concepts of the K-12 standards, by code, as the published document names them.
SUB_CONCEPTS = {
    "CS": {
        "COMM": "Communication and Networking", "HARD": "Hardware", "SOFT": "Software", "APPS": "Applications", "CC": "Cloud Computing", "COMP": "Components",
        "IOT": "Internet of Things", "LOSS": "Loss", "OS": "Operating Systems", "PROG": "Programming", "PROT": "Protocols",
    },
    "DC": {
        "AUP": "Acceptable Use Policy", "CYBL": "Cyberbullying", "ETH": "Ethics", "FOOT": "Digital Footprint", "IP": "Intellectual Property", "LAW": "Law",
        "PPI": "Personally Identifiable Information", "THRT": "Threats and Scams",
    },
    "SEC": {
        "ACC": "Access Control", "AUTH": "Authentication", "CIA": "Confidentiality, Integrity, Availability", "COMP": "Compromise", "CRYP": "Cryptography",
        "CTRL": "Controls", "DATA": "Data", "INFO": "Information Security", "NET": "Network Security", "PHYS": "Physical Security",
    },
}
#: Where a statement ends although its block goes on: the head of the next sub-concept, that of the next
#: grade band, the glossary, a page number.
CUTS = [
    r"\s+(?:" + "|".join(code for codes in SUB_CONCEPTS.values() for code in codes) + r")\s*\)[^.]*$",
    r"(?i)\s*(?:Kindergarten|\d+(?:st|nd|rd|th))[\s–—-]*(?:Grade)?[\s–—-]*\d*(?:st|nd|rd|th)?\s*Grade.*$",
    r"(?i)\s*Glossary\s+of\s+Terms.*$",
    r"\s+\d{1,3}\s*$",
]


def sub_concepts(spark: SparkSession) -> DataFrame:
    """theme, sub_concept, sub_concept_name: the catalog that names groups of standards."""
    return spark.createDataFrame([(t, c, n) for t, codes in SUB_CONCEPTS.items() for c, n in codes.items()], "theme string, sub_concept string, sub_concept_name string")


def statement(block: Column) -> Column:
    """A standard's statement from its block of lines: without the id, furniture and bullets, up to the first cut."""
    out = squish(F.regexp_replace(F.regexp_replace(F.regexp_replace(block, "^.*?" + STANDARD, ""), FURNITURE, " "), "[•‣◦*]", " "))
    for pattern in CUTS:
        out = F.regexp_replace(out, pattern, "")
    return squish(out)


def standards(lines: DataFrame, key: str = "file", longest_joined: int = 60, joined: int = 3) -> DataFrame:
    """standard_id, grade_band, theme, sub_concept, sequence, statement_text, source_line: each id opens a block up to the next id.

    An id whose next lines together stay short is a table-of-contents entry and is left out. Of an id that occurs more than
    once the longest statement stays, the first of equal ones."""
    heads = blocks(lines, key, STANDARD).select(F.col(key).alias("_k"), F.col("line").alias("head"), "next_line")
    # a block's lines: each line belongs to the last head at or before it
    marked = lines.join(heads.select(F.col("_k").alias(key), F.col("head").alias("line"), F.lit(1).alias("_new"), "next_line"), [key, "line"], "left")
    order = Window.partitionBy(key).orderBy("line")
    owned = marked.withColumn("head", F.last(F.when(F.col("_new") == 1, F.col("line")), ignorenulls=True).over(order)).where("head IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    first = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", "text"))), 1, joined), lambda x: x["text"]), " ")
    body = owned.groupBy(key, "head").agg(text.alias("raw"), first.alias("begin")).where(F.length("begin") > longest_joined)
    ids = body.select("*", *(F.regexp_extract("raw", STANDARD, k).alias(n) for k, n in enumerate(("standard_id", "grade_band", "theme", "sub_concept", "seq"))))
    clean = statement(F.col("raw"))
    found = ids.select("standard_id", "grade_band", "theme", "sub_concept", F.col("seq").try_cast("int").alias("sequence"), clean.alias("statement_text"), F.col("head").alias("source_line"), key)
    best = Window.partitionBy("standard_id").orderBy(F.desc(F.length("statement_text")), key, "source_line")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", key)


def levels_and_clusters(standards_sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level, grades) and (level, concept, cluster_id) of a standards sheet."""
    levels = standards_sheet.select("level", "grades").distinct().orderBy("level", "grades")
    clusters = standards_sheet.select("level", "concept").distinct().withColumn("cluster_id", F.concat_ws("-", "level", F.regexp_replace("concept", "[^A-Za-z0-9]+", "-")))
    return levels, clusters.orderBy("level", "concept")


def section_bullets(lines: DataFrame, areas: DataFrame, key: str = "file", after: int = 500, start: str = "essentials", end: str = "learning outcomes", bullet: str = "•", shortest: int = 10) -> DataFrame:
    """element_id, ka_id, ka_section, ka_name, element_type, element_text: bullets between a section's start and end marker.

    areas: ka_id, section, name. Sections are found by their number after line `after`; ids count within an area, as ka_id-E01."""
    area = areas.select("ka_id", "section", F.col("name").alias("ka_name"))
    number = F.regexp_extract("text", r"^\s*(\d+\.\d+)\b", 1)
    order = Window.partitionBy(key).orderBy("line")
    rows = lines.where(F.col("line") > after).withColumn("section", F.nullif(number, F.lit("")))
    rows = rows.join(area.select("section", F.lit(1).alias("_known")), "section", "left")
    rows = rows.withColumn("ka_section", F.last(F.when(F.col("_known") == 1, F.col("section")), ignorenulls=True).over(order))
    within = Window.partitionBy(key, "ka_section").orderBy("line")
    state = F.last(F.when(F.lower("text").contains(start), 1).when(F.lower("text").contains(end), 0), ignorenulls=True).over(within)
    rows = rows.withColumn("_in", state).where((F.col("_in") == 1) & F.startswith(F.ltrim("text"), F.lit(bullet)))
    rows = rows.withColumn("element_text", F.regexp_replace(F.trim(F.regexp_replace(F.trim("text"), rf"^{bullet}\s*", "")), ",$", "")).where(F.length("element_text") > shortest)
    numbered = rows.withColumn("n", F.row_number().over(within)).drop("section", "_known").join(area, F.col("ka_section") == F.col("section"))
    return numbered.select(F.format_string("%s-E%02d", "ka_id", "n").alias("element_id"), "ka_id", "ka_section", "ka_name", F.lit("essential").alias("element_type"), "element_text")


def described_headings(lines: DataFrame, headings: DataFrame, key: str = "file", after: int = 400, within: int = 30, longer: int = 30) -> DataFrame:
    """heading_id, description: the first line of more than `longer` characters within `within` lines of a heading after line `after`.

    headings: heading_id (a number without spaces), heading. Lines meet headings on the number that they begin with, and must hold the heading."""
    numbered = lines.where(F.col("line") > after).withColumn("heading_id", F.regexp_extract(F.ltrim("text"), r"^(\S+) ", 1))
    found = numbered.join(headings, "heading_id").where(F.contains(F.lower("text"), F.lower("heading")))
    at = found.groupBy("heading_id", key).agg(F.min("line").alias("at"))
    near = lines.join(at, key).where(F.col("line").between(F.col("at") + 1, F.col("at") + within) & (F.length(F.trim("text")) > longer))
    return near.groupBy("heading_id").agg(F.min_by(F.trim("text"), "line").alias("description"))
