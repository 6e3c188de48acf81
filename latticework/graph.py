"""TripleGraph: a set of triples in one DataFrame, and the triple patterns that read it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .namespaces import expand
from .schemas import TRIPLE, TRIPLE_KEY

Pattern = tuple[str, str, str]


class TripleGraph:
    """Set semantics hold from construction on: patterns and bindings never remove duplicates themselves.

    Stored graphs are Parquet partitioned by predicate, so a pattern with a fixed predicate prunes to its partition and
    reads two columns.
    """

    def __init__(self, triples: DataFrame):
        self.triples = triples

    @classmethod
    def of(cls, triples: DataFrame) -> TripleGraph:
        """From rows with s, p, o and any of the other columns; duplicates collapse, missing columns are null."""
        have = set(triples.columns)
        wanted = [c.split()[0] for c in TRIPLE.split(", ")]
        default = {"o_kind": F.lit("iri")}
        full = triples.select(*(F.col(c) if c in have else default.get(c, F.lit(None).cast("string")).alias(c) for c in wanted))
        return cls(full.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").dropDuplicates(TRIPLE_KEY))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> TripleGraph:
        """From (s, p, o, kind) with compact names allowed for s, p and IRIs in o."""
        full = [(expand(s), expand(p), expand(o) if kind == "iri" else o, kind) for s, p, o, kind in rows]
        return cls.of(spark.createDataFrame(full, "s string, p string, o string, o_kind string"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TripleGraph:
        return cls(spark.read.parquet(path).select(*(c.split()[0] for c in TRIPLE.split(", "))))

    def write(self, path: str) -> None:
        """Ranges of predicate and subject, so a predicate that most triples have is written by many tasks, and no file holds small parts of many."""
        self.triples.repartitionByRange("p", "s").write.partitionBy("p").mode("overwrite").parquet(path)

    def cache(self) -> TripleGraph:
        return TripleGraph(self.triples.cache())

    def union(self, *others: TripleGraph) -> TripleGraph:
        """Blank nodes keep to their source: labels are prefixed with it where the graphs are read."""
        return TripleGraph.of(reduce(DataFrame.unionByName, [g.triples for g in (self, *others)]))

    def _scan(self, predicate: str, obj: str = "?o") -> DataFrame:
        """The triples that a pattern can match; variables start with a question mark."""
        return self.triples

    def pairs(self, predicate: str) -> DataFrame:
        """(s, o) of a fixed predicate; no match gives no rows of the same columns."""
        return self._scan(predicate).where(F.col("p") == expand(predicate)).select("s", "o")

    def subjects(self, predicate: str, obj: str) -> DataFrame:
        """(s) of a fixed predicate and object."""
        return self._scan(predicate, obj).where((F.col("p") == expand(predicate)) & (F.col("o") == expand(obj))).select("s")

    def _matched(self, pattern: Pattern) -> DataFrame:
        df, names, seen = self._scan(pattern[1], pattern[2]), [], {}
        for column, term in zip("spo", pattern, strict=True):
            if not term.startswith("?"):
                value = term[1:-1] if column == "o" and term[:1] == '"' else expand(term)
                df = df.where(F.col(column) == value)
            elif term in seen:
                df = df.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
                names.append(F.col(column).alias(term[1:]))
        return df.select(*names) if names else df.select(F.lit(True).alias("_found")).limit(1)

    def match(self, patterns: list[Pattern], optional: list[Pattern] = ()) -> DataFrame:
        """A conjunction of patterns as equi-joins on shared variables; optional ones are left joins. Terms are
        ?variables, compact names, IRIs or "literals". A pattern must share a variable with those before it."""
        found = None
        for k, pattern in enumerate([*patterns, *optional]):
            part = self._matched(pattern)
            if found is None:
                found = part
                continue
            shared = [c for c in part.columns if c in found.columns]
            if not shared:
                raise ValueError(f"pattern {pattern} shares no variable with those before it")
            found = found.join(part, shared, "left" if k >= len(patterns) else "inner")
        if found is None:
            raise ValueError("no pattern")
        return found


class PartitionedGraph(TripleGraph):
    """A graph made of disjoint parts, each of one predicate and perhaps of one object: patterns plan over the parts that can match only."""

    def __init__(self, parts: list[tuple[str, str | None, DataFrame]]):
        super().__init__(reduce(DataFrame.unionByName, [df for _, _, df in parts]))
        self.parts = parts

    def _scan(self, predicate: str, obj: str = "?o") -> DataFrame:
        if predicate.startswith("?"):
            return self.triples
        fits = [df for p, o, df in self.parts if p == expand(predicate) and (o is None or obj[:1] in '?"' or o == expand(obj))]
        return reduce(DataFrame.unionByName, fits) if fits else self.triples.limit(0)
