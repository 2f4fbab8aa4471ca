"""A stored inverted index with facets and a date.

Every add or delete is a segment: postings dealt into folders by a hash of the
token, a table of documents, and the ids that older segments lose by it. Nothing
is rewritten, so an add costs what it adds; a segment counts once its commit is
written. A search reads only the folders of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kronograph.operators.search import bm25, postings

#: Folders of postings in a segment.
BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Documents of (id, text fields, labels, date) under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def segments(self) -> list[int]:
        """Committed segments in order."""
        if not self._exists("commits"):
            return []
        return sorted(r["segment"] for r in self.spark.read.schema("segment int").parquet(f"{self.path}/commits").collect())

    def _commit(self, segment: int) -> None:
        self.spark.createDataFrame([(segment,)], "segment int").write.mode("append").parquet(f"{self.path}/commits")

    def _next(self) -> int:
        return max(self.segments(), default=-1) + 1

    def _gone(self, ids: DataFrame, segment: int) -> None:
        """ids leave the segments before this one."""
        ids.select("id").distinct().write.parquet(f"{self.path}/gone/segment={segment}", mode="overwrite")

    def add(self, docs: DataFrame, id_col: str, fields: dict[str, str], labels: str | None = None, date: str | None = None) -> int:
        """Index rows by id; a row of the same id that is indexed already is replaced. Gives the segment."""
        segment = self._next()
        named = docs.select(
            F.col(id_col).alias("id"), *(F.col(c).alias(f"f_{f}") for f, c in fields.items()),
            (F.col(labels) if labels else F.lit(None)).cast("array<string>").alias("labels"), (F.col(date) if date else F.lit(None)).cast("date").alias("date"),
        ).filter("id is not null")
        index = postings(named, "id", {f: f"f_{f}" for f in fields})
        index.withColumn("bucket", _bucket(F.col("token"))).write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}", mode="overwrite")
        named.select("id", "labels", "date").write.parquet(f"{self.path}/docs/segment={segment}", mode="overwrite")
        self._gone(named, segment)
        self._commit(segment)
        return segment

    def delete(self, ids: DataFrame) -> int:
        """Documents whose id is in the first column go."""
        segment = self._next()
        self._gone(ids.toDF("id"), segment)
        self._commit(segment)
        return segment

    def clear(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").filter(F.col("segment").isin(self.segments()))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of (id, segment) that no later segment has replaced or deleted."""
        gone = self._table("gone").groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(gone, "id", "left").filter("until is null or segment >= until").drop("until")

    def documents(self) -> DataFrame:
        """(id, labels, date) of the indexed documents."""
        return self._live(self._table("docs")).select("id", "labels", "date")

    def sizes(self) -> DataFrame:
        """(field, n, avgdl) over the indexed documents."""
        total = self.documents().agg(F.count("*").alias("n"))
        # a field without tokens has no postings and counts as length 0
        lengths = self._live(self._table("postings").select("field", "id", "segment", "dl").distinct())
        return lengths.groupBy("field").agg(F.sum("dl").alias("length")).crossJoin(F.broadcast(total)).select("field", "n", (F.col("length") / F.col("n")).alias("avgdl"))  # one row

    def search(self, query: str, boosts: dict[str, float], labels: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """(id, score) of documents with any of the labels and a date in the range, by BM25 over all indexed documents."""
        words = query.lower().split()
        wanted = self.spark.createDataFrame([(w,) for w in words], "token string").select(_bucket(F.col("token")).alias("b"))
        buckets = [r["b"] for r in wanted.collect()]  # one for each word of the query
        hits = self._table("postings").filter(F.col("bucket").isin(buckets) & F.col("token").isin(words) & F.col("field").isin(*boosts))
        scored = bm25(self._live(hits), self.sizes(), query, boosts)
        chosen = self.documents()
        if labels is not None:
            chosen = chosen.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
        for limit, holds in ((since, lambda x: F.col("date") >= x), (until, lambda x: F.col("date") < x)):
            if limit is not None:
                chosen = chosen.filter(holds(F.lit(limit).cast("date")))
        return scored.join(chosen.select("id"), "id", "left_semi") if labels is not None or since or until else scored

    def facets(self) -> DataFrame:
        """(label, n) over the indexed documents."""
        return self.documents().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
