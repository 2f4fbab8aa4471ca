"""A partitioned vector index (S20, V3, V5): lists around centroids, searched nearest first, exact by bounds.

Centroids are fitted on a sample of at most SAMPLE rows; every row is indexed.
A list holds the unit vectors nearest to its centroid, in blocks of BLOCK, and the
largest angle to it. A search looks into each query's PROBES nearest lists, which
gives a k-th score; then into every list whose angle and radius leave room for a
better one, so the result is that of a scan. Without the second step (exact=False)
it is approximate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronograph.sources.shared import Written

#: Rows of the sample that centroids are fitted on; rounds of fitting; vectors of a block; lists that a query looks into first.
SAMPLE, ROUNDS, BLOCK, PROBES = 20_000, 8, 2048, 8
SLACK = 1e-9


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(rows: DataFrame, dimension: int) -> DataFrame:
    """Vectors of that length that a cosine is defined for."""
    v = F.transform("vector", lambda x: x.cast("double"))
    fine = (F.size("vector") == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select("id", v.alias("vector")).filter(fine)


class VectorIndex:
    """Unit vectors of a table under their nearest centroids; null, zero and not finite vectors and other lengths are left out."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, dimension: int, lists: int = 0, sample: int = SAMPLE):
        self.spark, self.dimension = rows.sparkSession, dimension
        usable = _usable(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")), dimension)
        # at most sample rows, chosen by a hash of their ids
        seen = usable.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        self.centroids = _fit(_units(seen["vector"]), lists or max(1, int(len(seen) ** 0.5))) if len(seen) else np.eye(1, dimension)
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def assign(batches):
            for pdf in batches:
                if len(pdf):
                    x = _units(pdf["vector"])
                    near = x @ shared.value.T
                    at = near.argmax(1)
                    yield pd.DataFrame({"id": pdf["id"], "list": at, "angle": np.arccos(np.clip(near[np.arange(len(x)), at], -1, 1)), "vector": list(x)})

        placed = usable.mapInPandas(assign, "id bigint, list int, angle double, vector array<double>")

        def blocks(batches):
            """Rows come sorted by list."""
            at, ids, held, angle = None, [], [], 0.0
            for pdf in batches:
                for name, i, a, v in zip(pdf["list"], pdf["id"], pdf["angle"], pdf["vector"]):
                    if name != at or len(ids) == BLOCK:
                        if ids:
                            yield _block(at, ids, held, angle)
                        at, ids, held, angle = name, [], [], 0.0
                    ids.append(i)
                    held.append(v)
                    angle = max(angle, a)
            if ids:
                yield _block(at, ids, held, angle)

        # a list with many rows is dealt to several tasks
        n = max(1, usable.count() // BLOCK)
        dealt = placed.repartition(n, "list", F.pmod(F.xxhash64("id"), F.lit(max(1, n // len(self.centroids))))).sortWithinPartitions("list", "id")
        self.blocks = Written(dealt.mapInPandas(blocks, "list int, radius double, ids binary, vectors binary"), "vector-index")

    def drop(self) -> None:
        self.blocks.drop()

    def radii(self) -> np.ndarray:
        """Of each list; -1 for empty ones."""
        out = np.full(len(self.centroids), -1.0)
        for r in self.blocks.read().groupBy("list").agg(F.max("radius").alias("radius")).collect():  # one row for each list
            out[r["list"]] = r["radius"]
        return out

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(query, id, score, rank): the k rows with the largest cosines for each query, ties by id."""
        q = _usable(queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")), self.dimension)
        first = Written(self._best(self._dealt(q, probes), k), "nearest")
        if not exact:
            return first.read()
        least = first.read().groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("least"))
        rest = self._dealt(q.join(least, "id", "left").select("id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least")), probes, further=True)
        both = first.read().select("query", "id", "score").unionByName(self._best(rest, k).select("query", "id", "score"))
        return _ranked(both, k)

    def _dealt(self, q: DataFrame, probes: int, further: bool = False) -> DataFrame:
        """(list, query, vector) of the nearest lists, or of all others with room for a score over least."""
        centroids, radii = self.centroids, self.radii()

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _units(pdf["vector"])
                angle = np.arccos(np.clip(x @ centroids.T, -1, 1))
                angle[:, radii < 0] = np.inf
                order = np.argsort(angle, axis=1, kind="stable")
                for row, (i, lists) in enumerate(zip(pdf["id"], order)):
                    chosen = lists[:probes]
                    if further:
                        chosen = lists[probes:]
                        bound = np.cos(np.maximum(0, np.minimum(np.pi, angle[row, chosen]) - radii[chosen]))
                        chosen = chosen[(bound >= pdf["least"].iloc[row] - SLACK) & (radii[chosen] >= 0)]
                    chosen = chosen[radii[chosen] >= 0]
                    if len(chosen):
                        yield pd.DataFrame({"list": chosen.astype(np.int32), "query": i, "vector": [x[row]] * len(chosen)})

        return q.mapInPandas(run, "list int, query bigint, vector array<double>")

    def _best(self, dealt: DataFrame, k: int) -> DataFrame:
        """The k best of each query over the blocks of its lists: k of each block first."""
        # the queries of a list come in parts, so a row holds a share of them
        part = F.pmod(F.xxhash64("query"), F.lit(64)).alias("part")
        asked = dealt.groupBy("list", part).agg(F.collect_list(F.struct("query", "vector")).alias("asked"))
        joined = self.blocks.read().join(asked, "list").select("ids", "vectors", "asked")
        dimension = self.dimension

        def run(batches):
            for pdf in batches:
                for ids, vectors, some in zip(pdf["ids"], pdf["vectors"], pdf["asked"]):
                    ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dimension)
                    scores = np.stack([r["vector"] for r in some]) @ x.T
                    for r, s in zip(some, scores):
                        best = np.lexsort((ids, -s))[:k]
                        yield pd.DataFrame({"query": r["query"], "id": ids[best], "score": s[best]})

        return _ranked(joined.mapInPandas(run, "query bigint, id bigint, score double"), k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _block(name: int, ids: list, held: list, angle: float) -> pd.DataFrame:
    return pd.DataFrame({"list": [name], "radius": [angle], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [np.stack(held).tobytes()]})


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of spherical k-means from evenly spaced rows."""
    centers = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        at = (x @ centers.T).argmax(1)
        for c in range(lists):
            mean = x[at == c].sum(0)
            if (size := np.linalg.norm(mean)) > 0:
                centers[c] = mean / size
    return centers
