"""What the corpus operators share: word rules, row keys, scratch tables and session settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words; every other code point belongs to a word.
SPACE = "\\x20\\x09-\\x0D"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


#: Key columns of a row: equal only for rows of equal id and text, null ids included, and the same in every attempt of a task.
KEY = ["_id", "_h1", "_h2"]
#: Stands for a null id, and so comes after all others.
LAST = 2**63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with KEY; needs doc_id and text."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_h1": F.xxhash64("text"), "_h2": F.hash("text", F.lit(1))})


def small(keys: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of keys, with a broadcast hint if it has few enough rows; beyond that rows meet by a shuffle."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir; only where that is unset (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended: then whoever owns the folder clears it
        return


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage and outlives a lost executor."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Spark's own bounds of an Arrow batch, and those that texts need.
_BATCH = {"maxRecordsPerBatch": ("10000", "2000"), "maxBytesPerBatch": ("67108864b", "16m")}


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python operators get, in rows and in bytes, as texts can be long. Bounds that a session
    has set itself stay."""
    for name, (default, bound) in _BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def whole(docs: DataFrame) -> Column:
    """The whole input row as one struct: an operator carries it under a name of its own, so no column of the input, whatever
    its name, meets a column that the operator makes."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def sql_string(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
