"""Corpus pipeline: STAGES run in order over documents, each stage's rows written as Parquet and read again by the next.

All stages but the last return the columns of their input, in order; other columns than those of documents are carried
along, whatever their names. An empty table passes through each stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontam, lines, packing, quality, simhash
from latticework.llm.common import KEY, SPACE, documents, keyed, scratch, small, whole, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 1). Null and blank texts fail them; repeated rows and ids are each
    judged; documents without a language, or of a language with few texts, are judged by characters alone."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go (operator 9). A document goes if they were all it had: the first document that has them stays
    whole. Null texts stay null; a null source is a site of its own; a null id comes after all others; rows of equal id and
    text are treated alike; n_chars is that of the text that is left."""
    left = lines.stripped(docs).where((F.col("n_removed") == 0) | F.col("left").rlike(f"[^{SPACE}]"))
    new = {"text": F.col("left"), "n_chars": F.char_length("left").cast("long")}
    return left.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id (operator 8); of repeated rows one
    stays, and of different texts of one id and group that with the least hashes. Texts without words are one group.
    Documents without an id stay, as no id tells them apart."""
    folder = scratch(spark)
    near = written(simhash.grouped(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "_h1", "_h2", "component_id"), folder, "near")
    gone = near.where("_id <> component_id").select(*KEY)
    twice = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()
    if twice:
        least = near.where("_id = component_id").groupBy("_id").agg(F.min(F.struct("_h1", "_h2")).alias("first"))
        gone = gone.unionByName(near.where("_id = component_id").join(least, "_id").where(F.struct("_h1", "_h2") != F.col("first")).select(*KEY))
    rows = keyed(docs.select(whole(docs).alias("row"), "doc_id", "text"))
    left = rows.where("doc_id IS NOT NULL").join(small(written(gone.distinct(), folder, "gone")), KEY, "left_anti")
    left = left.dropDuplicates(KEY) if twice else left
    return left.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go (operator 10). Null texts and texts of fewer than five words stay;
    rows of equal id and text go together; an empty benchmark leaves all."""
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens (operator 7): a row a piece. A null or empty text is its end id alone; null and
    repeated ids are kept as they are; an empty table gives no rows."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Fingerprints and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
