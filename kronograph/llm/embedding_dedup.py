"""Embedding near-dedup (5): epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the join is one of
distance eps. Vectors are turned to the principal axes of the table (the turn
keeps distances), put into grid cells of width eps on the leading axes, sorted
by cells and cut into blocks of BLOCK. Two blocks meet unless their bounding
boxes are provably more than eps apart. A pair of blocks is joined recursively:
both sequences are halved, halves whose boxes are too far apart are skipped, and
intervals of LEAF vectors are compared by their double-precision cosines.

Blocks that follow each other form a strip. Two strips with blocks that meet are a
tile, which one task joins, so a block is sent once for each tile, not for each
pair; strips get wider with the table, up to STRIP_BYTES.

Equal vectors are joined once and counted by their number, whatever share of the
rows they have. A tile yields the number of links of each vector and a spanning
set of links, never all pairs.

Only vectors of one length can link; each length has axes and blocks of its own.
Vectors that are null, zero or hold null or non-finite components have no links
and are components of their own.
Repeated ids are rows of their own. Empty tables stay empty; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm.common import Written, clean_names, ship, shuffle_partitions, table
from kronograph.operators.components import connected_components

LEAST_COSINE = 0.9
#: Vectors of a block, of an interval that isn't halved, and leading axes with grid cells.
BLOCK, LEAF, AXES = 2048, 256, 4
#: Bytes of a strip at most, and tiles for each shuffle partition that strips are kept narrow for.
STRIP_BYTES, TILES = 32 << 20, 4
#: Slack of the boxes and of what is looked at closely, against rounding.
SLACK = 1e-6


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


class Pair:
    """Join of two blocks: links of each vector, and a spanning set of links."""

    def __init__(self, least: float):
        self.least, self.eps = least, math.sqrt(max(0.0, 2 - 2 * least)) + SLACK

    def boxes(self, turned: np.ndarray) -> dict:
        out = {}
        stack = [(0, len(turned))]
        while stack:
            a, b = stack.pop()
            out[a, b] = turned[a:b].min(0), turned[a:b].max(0)
            if b - a > LEAF:
                m = (a + b) // 2
                stack += [(a, m), (m, b)]
        return out

    def apart(self, p, q) -> bool:
        gap = np.maximum(0, np.maximum(p[0] - q[1], q[0] - p[1]))
        return float(gap @ gap) > self.eps * self.eps

    def join(self, a, b, same: bool):
        """a, b: (unit vectors, turned vectors, numbers of copies). Yields (links of a, links of b, edges)."""
        boxes_a, boxes_b = self.boxes(a[1]), self.boxes(b[1])
        links_a, links_b, edges = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64), []
        up = list(range(len(a[0]) + (0 if same else len(b[0]))))
        shift = 0 if same else len(a[0])

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        stack = [((0, len(a[0])), (0, len(b[0])))]
        while stack:
            x, y = stack.pop()
            if same and x[0] > y[0] or self.apart(boxes_a[x], boxes_b[y]):
                continue
            if x[1] - x[0] > LEAF or y[1] - y[0] > LEAF:
                halves = lambda z: [(z[0], (z[0] + z[1]) // 2), ((z[0] + z[1]) // 2, z[1])] if z[1] - z[0] > LEAF else [z]
                stack += [(p, q) for p in halves(x) for q in halves(y)]
                continue
            hit = cosines(a[0][x[0] : x[1]], b[0][y[0] : y[1]]) >= self.least
            if same and x == y:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links_a[x[0] : x[1]] += hit @ b[2][y[0] : y[1]]
            if not (same and x == y):
                links_b[y[0] : y[1]] += a[2][x[0] : x[1]] @ hit
            # each vector's first hit and each first hit's others connect all that is linked
            for i, j in self.spanning(hit):
                p, q = root(x[0] + i), root(shift + y[0] + j)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    edges.append((x[0] + i, y[0] + j))
        if same:
            links_a = links_a + links_b
            links_b = np.zeros(0, np.int64)
        return links_a, links_b, edges

    @staticmethod
    def spanning(hit: np.ndarray):
        """Links that connect whatever the matrix connects: breadth first over its rows and columns."""
        rows_left, cols_left = np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool)
        for start in np.flatnonzero(hit.any(1)).tolist():
            if not rows_left[start]:
                continue
            rows_left[start] = False
            todo = [start]
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(hit[i] & cols_left).tolist():
                    cols_left[j] = False
                    yield i, j
                    for r in np.flatnonzero(hit[:, j] & rows_left).tolist():
                        rows_left[r] = False
                        todo.append(r)
                        yield r, j


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = clean_names(embeddings, vec_id=id_col, embedding=vector_col)
    spark = rows.sparkSession
    ship(spark)
    partitions = shuffle_partitions(spark)
    doubled = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(doubled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubled, lambda x: x != 0)
    kind = "float" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = rows.withColumn("vector", F.when(good, F.transform("embedding", lambda x: x.cast(kind)))).select("vec_id", "vector")
    distinct = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    vectors = Written(distinct.withColumn("vid", F.xxhash64("vector")).withColumn("n", F.size("vector")), "vectors")
    # lengths with more vectors than a block has: fewer than the table has blocks
    large = {r["n"]: r["count"] for r in vectors.read().groupBy("n").count().filter(F.col("count") > block).collect()}
    axes = spark.sparkContext.broadcast({n: _axes(vectors.read().filter(F.col("n") == n), n) for n in large})
    eps = math.sqrt(max(1e-12, 2 - 2 * least))
    order = [f"g{k}" for k in range(AXES)]
    cells_schema = f"vid bigint, n int, vector array<{kind}>, copies bigint, " + ", ".join(f"{g} bigint" for g in order)

    def cells(batches):
        for batch in batches:
            for n, part in _by_length(batch, 1):
                g = np.zeros((part.num_rows, AXES), np.int64)
                if n in axes.value:
                    lead = axes.value[n][:, :AXES]
                    g[:, : lead.shape[1]] = np.floor(_units(part.column(2), n) @ lead / eps).astype(np.int64)
                yield table(cells_schema, {f: part.column(k) for k, f in enumerate(("vid", "n", "vector", "copies"))} | {f: np.ascontiguousarray(g[:, k]) for k, f in enumerate(order)})

    total = max(1, vectors.read().count())
    widest = max(large, key=lambda n: n * large[n], default=1)
    blocks_in_all = -(-total // block)
    strip = max(1, min(STRIP_BYTES // (8 * widest * block), int(blocks_in_all / math.sqrt(2 * TILES * partitions))))
    ranges = max(1, min(partitions, -(-blocks_in_all // strip)))
    ordered = vectors.read().select("vid", "n", "vector", "copies").mapInArrow(cells, cells_schema).repartitionByRange(ranges, "n", *order, "vid").sortWithinPartitions("n", *order, "vid")
    block_schema = "blk bigint, strip bigint, n int, vids binary, vectors binary, copies binary, low array<double>, high array<double>"

    def blocks(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        serial, held, count = 0, [], 0

        def full():
            t = pa.Table.from_batches(held)
            n = t["n"][0].as_py()
            v = t["vector"].combine_chunks()
            turned = _turned(_units(v, n), axes.value.get(n))
            return table(block_schema, {"blk": [first + serial], "strip": [first + serial // strip], "n": [n], "vids": [t["vid"].to_numpy().tobytes()], "vectors": [np.asarray(v.flatten()).tobytes()], "copies": [t["copies"].to_numpy().tobytes()], "low": [turned.min(0).tolist()], "high": [turned.max(0).tolist()]})

        for batch in batches:
            for n, part in _by_length(batch, 1):
                if held and held[0].column(1)[0].as_py() != n:
                    yield full()
                    serial, held, count = serial + 1, [], 0
                at = 0
                while at < part.num_rows:
                    some = part.slice(at, block - count)
                    at, count = at + some.num_rows, count + some.num_rows
                    held.append(some)
                    if count == block:
                        yield full()
                        serial, held, count = serial + 1, [], 0
        if count:
            yield full()

    stored = Written(ordered.mapInArrow(blocks, block_schema), "blocks")
    # boxes that may be near share a cell of the first axis, or lie in neighbouring ones
    box = stored.read().select("blk", "strip", "n", "low", "high")
    cell = lambda c: F.floor(F.element_at(c, 1) / F.lit(eps + SLACK)).cast("bigint")
    spread = box.withColumn("cell", F.explode(F.sequence(cell("low") - 1, cell("high") + 1)))
    exact = box.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    a, b = (side.select(*(F.col(c).alias(f"{name}_{c}") for c in ("blk", "strip", "low", "high")), "n", "cell") for name, side in (("a", spread), ("b", exact)))
    gap = F.aggregate(
        F.sequence(F.lit(1), F.col("n")),
        F.lit(0.0),
        lambda s, k: s + F.pow(F.greatest(F.lit(0.0), F.element_at("a_low", k) - F.element_at("b_high", k), F.element_at("b_low", k) - F.element_at("a_high", k)), F.lit(2)),
    )
    near = a.join(b, ["n", "cell"]).filter("a_blk <= b_blk").filter(gap <= (eps + SLACK) ** 2)
    tiles = Written(near.select("n", F.col("a_strip").alias("a"), F.col("b_strip").alias("b")).distinct(), "tiles")
    sides = tiles.read().select("n", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))
    payload = stored.read().select("n", "strip", "blk", "vids", "vectors", "copies")
    dealt = payload.join(sides, ["n", "strip"]).select("n", "a", "b", "blk", "strip", "vids", "vectors", "copies").repartition(partitions, "n", "a", "b").sortWithinPartitions("n", "a", "b", "blk")
    out_schema = "vid bigint, links bigint, other bigint"

    def compare(batches):
        pair, at, held = Pair(least), None, []
        for batch in batches:
            for row in range(batch.num_rows):
                n, one, two, _, name, vids, values, copies = (batch.column(k)[row].as_py() for k in range(8))
                if at != (n, one, two):
                    yield from tile(pair, at, held)
                    at, held = (n, one, two), []
                x = _normed(np.frombuffer(values, np.float32 if kind == "float" else np.float64).astype(np.float64).reshape(-1, n))
                held.append((name, np.frombuffer(vids, np.int64), (x, _turned(x, axes.value.get(n)), np.frombuffer(copies, np.int64))))
        yield from tile(pair, at, held)

    def tile(pair, at, held):
        """Links of a tile: held has the blocks of both strips in order."""
        if not held:
            return
        links = [np.zeros(len(v), np.int64) for _, v, _ in held]
        src, dst = [], []
        for i, (name, va, side) in enumerate(held):
            for j in range(i, len(held)):
                if name != at[1] or held[j][0] != at[2]:
                    continue  # pairs inside one strip are the business of its own tile
                links_a, links_b, edges = pair.join(side, held[j][2], i == j)
                links[i] += links_a
                if i != j:
                    links[j] += links_b
                src += (int(va[e[0]]) for e in edges)
                dst += (int(held[j][1][e[1]]) for e in edges)
        vids, links = np.concatenate([v for _, v, _ in held]), np.concatenate(links)
        hit = links > 0
        yield table(out_schema, {"vid": vids[hit], "links": links[hit], "other": pa.nulls(int(hit.sum()), pa.int64())})
        yield table(out_schema, {"vid": np.array(src, np.int64), "links": np.zeros(len(src), np.int64), "other": np.array(dst, np.int64)})

    found = Written(dealt.mapInArrow(compare, out_schema), "links")
    stored.drop()
    tiles.drop()
    counts = found.read().filter("other is null").groupBy("vid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.read().filter("other is not null").select(F.col("vid").alias("src"), F.col("other").alias("dst")))
    known = vectors.read().select("vid", "least", "copies").join(parts, F.col("vid") == F.col("node"), "left").select("vid", "least", "copies", F.coalesce("component", "vid").alias("component")).join(counts, "vid", "left")
    known = Written(known, "known")
    names = Written(known.read().groupBy("component").agg(F.min("least").alias("component_id")), "names")
    label = Written(known.read().join(names.read(), "component").select("vid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    keyed = rows.select("vec_id", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("vid"))
    out = keyed.join(label.read(), "vid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _axes(vectors: DataFrame, n: int) -> np.ndarray:
    """Principal axes of vectors of length n, leading ones first; collects n + n x n sums."""
    schema = "sums array<double>, count bigint"

    def moments(batches):
        total, outer, count = np.zeros(n), np.zeros((n, n)), 0
        for batch in batches:
            x = _units(batch.column(0), n)
            total, outer, count = total + x.sum(0), outer + x.T @ x, count + len(x)
        yield table(schema, {"sums": [np.concatenate([total, outer.ravel()]).tolist()], "count": [count]})

    parts = vectors.select("vector").mapInArrow(moments, schema).select(F.posexplode("sums").alias("k", "x"), "count").groupBy("k").agg(F.sum("x").alias("x"), F.sum("count").alias("count")).collect()
    sums, count = np.zeros(n + n * n), parts[0]["count"]
    for r in parts:
        sums[r["k"]] = r["x"]
    mean = sums[:n] / count
    _, axes = np.linalg.eigh(sums[n:].reshape(n, n) / count - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _by_length(batch: pa.RecordBatch, column: int):
    """(length, rows) of each run of rows with one length."""
    n = batch.column(column).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(n[a]), batch.slice(a, b - a)


def _turned(units: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return units if axes is None else units @ axes


def _normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(vectors: pa.Array, n: int) -> np.ndarray:
    """Unit vectors of a list column whose lists all have n finite components."""
    return _normed(np.asarray(vectors.flatten(), np.float64).reshape(-1, n))
