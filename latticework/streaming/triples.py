"""N-Triples arriving as files, appended to a stored graph once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TRIPLE_KEY
from ..sources.ntriples import parse


def triple_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of the N-Triples files that arrive in a folder."""
    lines = spark.readStream.schema("value string").text(folder)
    return parse(lines, F.input_file_name())[0]


def append(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to the stored graph, then stop. Each file is read once; a triple that the store has, or that
    comes twice, is stored once. Of the store only the partitions of the batch's predicates are read. A batch that is run again after a failure finds its triples there and adds none."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.withColumns({c: F.coalesce(c, F.lit("")) for c in ("o_datatype", "o_lang")}).dropDuplicates(TRIPLE_KEY)
        try:
            predicates = [r[0] for r in new.select("p").distinct().collect()]  # the vocabulary's, tens
            known = spark.read.schema(batch.schema).parquet(store).where(F.col("p").isin(predicates)).withColumns({c: F.coalesce(c, F.lit("")) for c in ("o_datatype", "o_lang")})
            new = new.join(known.select(*TRIPLE_KEY), TRIPLE_KEY, "left_anti")
        except Exception as error:  # noqa: BLE001  the store isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("o_datatype", "o_lang")}).select(*batch.columns).write.mode("append").partitionBy("p").parquet(store)

    return triple_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
