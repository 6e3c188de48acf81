"""Operator 3: token counts as rollups that deltas maintain.

The store holds, for each committed batch, signed sums by source, language and tokenizer version; totals are the sum
over committed batches, so a batch costs its own size and never a recount. A batch is a table of changes: an insert
counts +1 document and +n tokens, a delete -1 and -old, a revision 0 and n - old (or, if it moves a document to another
source, language or version, a delete there and an insert here).

A commit needs no lock and no file system that refuses a taken name. A call writes a batch's sums and then a marker, each
under a name that no other call has; a reader takes one marker of each batch. A batch's name stands for its content, so
whichever marker is taken the sums are the same, and a batch that is sent again, after a failure or twice at once, counts
once. A compaction's marker names the batches that its sums hold, exactly those that were read when it began: a batch
that is committed meanwhile stays live. Of compactions that overlap, as two that ran at once, a reader takes one, the
larger first; the others' batches stay live as they were, so no choice counts a batch twice.

vacuum() deletes what no reader takes any more: sums and markers of folded batches, and sums without a marker that
are older than a given age. It must not run beside compact(). Markers are read by the driver: a line a batch since the
last vacuum(), and one list of names, which later calls need in order to know a batch again.

Defined cases: null sources, languages and versions are groups of their own; null token counts count as 0; an empty
batch commits and changes nothing; groups whose documents are all gone drop out; documents with null text have 0
tokens; repeated rows each count, and a label holds for every row of its id; rows without an id have no label; extra
columns are ignored.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, scratch, words, written
from .encoding import default_tokenizer, encoder

GROUP = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class RollupStore:
    """Totals in a folder that all executors share. Files are reached through Hadoop's file systems only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("commits", "sums"):
            self._fs.mkdirs(self._path(f"{self.folder}/{name}"))

    def _listed(self, name: str) -> list[tuple[str, int]]:
        """Names and times of change, in order of name."""
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path(f"{self.folder}/{name}")))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{name}"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def markers(self) -> dict[str, dict]:
        """All whole markers by file name."""
        return {name: self._read(name) for name, _ in self._listed("commits") if name.endswith(".json")}

    def _mark(self, marker: dict) -> None:
        """Written aside and renamed, so it is there whole or not at all; the name is this call's own."""
        name = uuid.uuid4().hex
        aside, at = (self._path(f"{self.folder}/commits/{x}") for x in (f".{name}", f"{name}.json"))
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(marker).encode()))
        stream.close()
        if not self._fs.rename(aside, at):
            raise OSError(f"could not commit {at}")

    @staticmethod
    def live(markers: dict[str, dict]) -> dict[str, dict]:
        """What counts: by name, one marker of each batch that no taken compaction holds, and the taken compactions."""
        batches: dict[str, dict] = {}
        folded: set[str] = set()
        taken: dict[str, dict] = {}
        for _, m in sorted(markers.items()):
            if "holds" not in m:
                batches.setdefault(m["batch"], m)
        for name, m in sorted((x for x in markers.items() if "holds" in x[1]), key=lambda x: (-len(x[1]["holds"]), x[0])):
            if folded.isdisjoint(m["holds"]):
                folded.update(m["holds"])
                taken[name] = m
        return {b: m for b, m in batches.items() if b not in folded} | taken

    def batches(self) -> set[str]:
        """Names of all committed batches."""
        markers = self.markers()
        return {m["batch"] for m in markers.values() if "holds" not in m} | {b for m in markers.values() for b in m.get("holds", [])}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes: op (insert, delete, revise), GROUP, n_tokens, and for deletes and revisions old_tokens
        (a revision may have old_source, old_lang, old_tokenizer). False if the batch is committed already."""
        if not batch or "/" in batch or batch.startswith("."):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        data = uuid.uuid4().hex
        _summed(signed(changes)).write.parquet(f"{self.folder}/sums/{data}")
        self._mark({"batch": batch, "data": data})
        return True

    def _sums(self, live: dict[str, dict]) -> DataFrame:
        data = [f"{self.folder}/sums/{m['data']}" for _, m in sorted(live.items())]
        return _summed(self.spark.read.schema(SUMS).parquet(*data) if data else self.spark.createDataFrame([], SUMS)).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._sums(self.live(self.markers()))

    def compact(self) -> bool:
        """Fold the batches committed so far into one table of sums."""
        live = self.live(self.markers())
        if len(live) < 2:
            return False
        data = uuid.uuid4().hex
        self._sums(live).write.parquet(f"{self.folder}/sums/{data}")
        self._mark({"data": data, "holds": sorted({b for m in live.values() for b in m.get("holds", [m.get("batch")])})})
        return True

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Delete what is folded, and sums without a marker that are older than so many seconds, as a running call's are
        younger. Returns the number of files and folders deleted."""
        markers = self.markers()
        live = self.live(markers)
        used = {m["data"] for m in live.values()}
        marked = {m["data"] for m in markers.values()}
        kept = {name for name, m in markers.items() if any(m is x for x in live.values())}
        gone = [f"commits/{name}" for name in markers if name not in kept]
        edge = (time.time() - older_than) * 1000
        gone += [f"sums/{name}" for name, at in self._listed("sums") if name not in used and (name in marked or at < edge)]
        return sum(bool(self._fs.delete(self._path(f"{self.folder}/{x}"), True)) for x in gone)


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """GROUP, n_docs, n_tokens: what each change adds."""
    for c in ("n_tokens", "old_tokens", "old_source", "old_lang", "old_tokenizer"):
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast("long" if c.endswith("tokens") else "string"))
    new = [F.col(c).cast("string").alias(c) for c in GROUP]
    n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("n_tokens", "old_tokens"))
    one = F.lit(1).cast("long")
    parts = [
        changes.where("op IN ('insert', 'revise')").select(*new, one.alias("n_docs"), n.alias("n_tokens")),
        changes.where("op = 'delete'").select(*new, (-one).alias("n_docs"), (-old).alias("n_tokens")),
        changes.where("op = 'revise'").select(*(F.coalesce(F.col(f"old_{c}").cast("string"), F.col(c).cast("string")).alias(c) for c in GROUP), (-one).alias("n_docs"), (-old).alias("n_tokens")),
    ]
    return reduce(DataFrame.unionByName, parts)


def counted(docs: DataFrame, tokenizer: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens and n_spaced (words between white space) of every row, in one pass."""
    arrow_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(x) for x in enc.ids(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "n_spaced")), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_spaced", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    rows = rows.withColumn("n_spaced", F.size(words(F.col("text"))).cast("long"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_spaced long, n_tokens long").withColumn("tokenizer", F.lit(version))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens after three batches, one of them sent twice: all documents come in; those
    labelled toxic go; those labelled of low quality are revised to another tokenizer version, counted by white space."""
    folder = scratch(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    labels = labels.agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = written(counted(documents(spark, sf_dir)), folder, "counts")
    # one label an id, so no row is multiplied; every row of an id is changed alike
    labelled = written(counts.join(labels, "doc_id").where("toxic = 1 OR quality = 0"), folder, "labelled")
    store = RollupStore(spark, f"{folder}/rollups")
    store.apply("load", counts.withColumn("op", F.lit("insert")))
    toxic = labelled.where("toxic = 1").withColumn("op", F.lit("delete")).withColumnRenamed("n_tokens", "old_tokens")
    store.apply("toxic", toxic)
    poor = labelled.where("quality = 0 AND (toxic IS NULL OR toxic <> 1)")
    store.apply("poor", poor.select(F.lit("revise").alias("op"), "source", "lang", F.lit("white_space").alias("tokenizer"), F.col("tokenizer").alias("old_tokenizer"), F.col("n_spaced").alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))
    store.apply("toxic", toxic)
    store.compact()
    return store.totals()
