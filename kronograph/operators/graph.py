"""Graph traversal, communities and centrality (G1-G18, A2-A5) as joins over edge tables.

Loops write each round to the shared folder, so plans stay short and a lost
executor costs one round at most. Every choice among equals takes the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kronograph.functions.text import place
from kronograph.sources.shared import Written, written


def adjacency(edges: DataFrame, direction: str = "both", relationships: list[str] | None = None) -> DataFrame:
    """(node, next, via): the steps that a direction and relationships allow."""
    if relationships:
        edges = edges.filter(F.col("relationship").isin(relationships))
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), F.col("id").alias("via"))
    into = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("next"), F.col("id").alias("via"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def bfs(steps: DataFrame, seeds: DataFrame, depth: int, target: str | None = None) -> DataFrame:
    """(id, depth, via, path): every node within depth of the seeds (column id), by a least path.

    One join for each level. The frontier is left to Spark to broadcast while it
    is small. Of several shortest paths the least is kept. Stops early when
    nothing new is found, or target is.
    """
    start = seeds.select("id").distinct().select("id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("via"), F.array("id").alias("path"))
    known = frontier = written(start, "level")
    for level in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("node"), "path").join(steps, "node")
        fresh = reached.join(known.select(F.col("id").alias("next")), "next", "left_anti")
        best = fresh.groupBy("next").agg(F.min(F.struct(F.concat("path", F.array("next")).alias("path"), "via")).alias("best"))
        frontier = written(best.select(F.col("next").alias("id"), F.lit(level).cast("bigint").alias("depth"), F.col("best.via").alias("via"), F.col("best.path").alias("path")), "level")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if target is not None and not frontier.filter(F.col("id") == target).isEmpty():
            break
    return known


def shortest_path(steps: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """(position, id) of the least shortest path; no rows beyond depth."""
    spark = steps.sparkSession
    found = bfs(steps, spark.createDataFrame([(source,)], "id string"), depth, target).filter(F.col("id") == target)
    return found.select(F.posexplode("path").alias("position", "id")).select(F.col("position").cast("bigint").alias("position"), "id")


def depth_first_set(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes that a depth-first walk of max depth emits: those nearer than depth (G2); its order is not defined here."""
    return bfs(steps, seeds, depth - 1).select("id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, strength): edges and weight at each end (A2)."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def community_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, internal and external edges and density of each label (A4)."""
    sized = labels.groupBy("label").agg(F.count("*").alias("members"))
    a = labels.select(F.col("id").alias("source_id"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("target_id"), F.col("label").alias("lb"))
    both = edges.join(a, "source_id").join(b, "target_id").groupBy("la", "lb").agg(F.count("*").alias("n"))
    ends = both.select(F.explode(F.array_distinct(F.array("la", "lb"))).alias("label"), (F.col("la") == F.col("lb")).alias("inside"), "n")
    counts = ends.groupBy("label").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("internal"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("external"))
    out = sized.join(counts, "label", "left").na.fill(0, ["internal", "external"])
    pairs = F.col("members") * (F.col("members") - 1)
    return out.withColumn("density", F.when(pairs > 0, 2.0 * F.col("internal") / pairs).otherwise(0.0))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(q): the closed form of modularity, from sums by label (A5, G7); edges have no loops."""
    a = labels.select(F.col("id").alias("source_id"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("target_id"), F.col("label").alias("lb"))
    by = edges.join(a, "source_id").join(b, "target_id").groupBy("la", "lb").agg(F.sum("weight").alias("w"))
    parts = by.select(F.explode(F.array(F.struct(F.col("la").alias("label"), "w", F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0).alias("inside")), F.struct(F.col("lb").alias("label"), "w", F.lit(0.0).alias("inside")))).alias("p")).select("p.*")
    sums = parts.groupBy("label").agg(F.sum("w").alias("strength"), F.sum("inside").alias("inside"))
    total = by.agg(F.sum("w").alias("m"))
    return sums.crossJoin(F.broadcast(total)).agg((F.sum(F.col("inside") / F.col("m") - F.pow(F.col("strength") / (2 * F.col("m")), 2)) * resolution).alias("q"))  # one row of totals


def supergraph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(c_src, c_dst, weight): edges between communities, unordered."""
    a = labels.select(F.col("id").alias("source_id"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("target_id"), F.col("label").alias("lb"))
    joined = edges.join(a, "source_id").join(b, "target_id")
    return joined.groupBy(F.least("la", "lb").alias("c_src"), F.greatest("la", "lb").alias("c_dst")).agg(F.sum("weight").alias("weight"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, label): synchronous label propagation, parallel edges counted, ties to the least label."""
    both = Written(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).groupBy("id", "other").agg(F.count("*").alias("n")), "adjacency").read()
    labels = Written(both.select("id").distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.read().withColumnRenamed("id", "other"), "other").groupBy("id", "label").agg(F.sum("n").alias("n"))
        after = Written(votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")), "labels")
        changed = not after.read().exceptAll(labels.read()).isEmpty()
        labels.drop()
        labels = after
        if not changed:
            break
    return labels.read()


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank): rounds of rank <- (1 - d) / n + d * sum(rank of sources / their out-degree)."""
    links = written(edges.groupBy("source_id", "target_id").agg(F.count("*").alias("n")), "links")
    share = links.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source_id"))).select("source_id", "target_id", "share")
    share = written(share, "share")
    nodes = written(share.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), "nodes")
    n = nodes.count()
    ranks = Written(nodes.withColumn("rank", F.lit(1.0 / n)), "ranks")
    for _ in range(rounds):
        sent = share.join(ranks.read().withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        after = Written(nodes.join(sent, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "ranks")
        ranks.drop()
        ranks = after
    return ranks.read()


def louvain(edges: DataFrame, rounds: int = 20, levels: int = 3) -> DataFrame:
    """(id, label): multi-level modularity communities.

    Moves are synchronous; in each round only one hashed half of the nodes may
    move, so neighbours don't swap for ever. A round is kept only if modularity
    grows. Communities then become nodes of the next level.
    """
    pairs = edges.filter("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id")).agg(F.sum("weight").alias("weight"))
    first = Written(pairs, "pairs")
    base = graph = first.read()
    final = Written(graph.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("label", F.col("id")), "final")
    loops, done = None, [first]  # tables that the next level still reads
    for level in range(levels):
        both = graph.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "weight").unionByName(graph.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "weight"))
        strength = both.groupBy("id").agg(F.sum("weight").alias("k"))
        if loops is not None:
            strength = strength.join(loops, "id", "full").select("id", (F.coalesce("k", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("k"))
        strengths = Written(strength, "strength")
        done.append(strengths)
        strength = strengths.read()
        two_m = strength.agg(F.sum("k")).first()[0]
        held = Written(strength.select("id", F.col("id").alias("label")), "labels")
        labels = held.read()
        best = _quality(base, _through(final.read(), labels))
        moved = False
        still = 0
        for r in range(rounds):
            own = labels.join(strength, "id")
            sums = own.groupBy("label").agg(F.sum("k").alias("total"))
            links = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id", "label").agg(F.sum("weight").alias("w"))
            options = links.join(sums, "label").join(own.select("id", "k", F.col("label").alias("old")), "id")
            gain = F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("label") == F.col("old"), F.col("k")).otherwise(0.0)) / two_m
            scored = options.withColumn("gain", gain)
            stay = own.select("id", F.col("label").alias("old"), "k").join(sums.withColumnRenamed("label", "old"), "old").select("id", F.col("old").alias("label"), "old", (-F.col("k") * (F.col("total") - F.col("k")) / two_m).alias("gain"))
            every = scored.select("id", "label", "old", "gain").unionByName(stay).groupBy("id", "label", "old").agg(F.max("gain").alias("gain"))
            choice = every.groupBy("id").agg(F.min_by("label", F.struct(-F.round("gain", 9), F.col("label") != F.col("old"), "label")).alias("to"), F.first("old").alias("old"))
            turn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == r % 2
            new = Written(choice.select("id", F.when(turn, F.col("to")).otherwise(F.col("old")).alias("label")), "labels")
            q = _quality(base, _through(final.read(), new.read()))
            if q > best + 1e-9:
                held.drop()
                held, labels, best, moved, still = new, new.read(), q, True, 0
            else:
                new.drop()
                still += 1
                if still == 2:
                    break
        after = Written(_through(final.read(), labels), "final")
        final.drop()
        final = after
        done.append(held)
        if not moved:
            break
        up = supergraph(graph, labels)
        inside = up.filter("c_src = c_dst").select(F.col("c_src").alias("id"), F.col("weight").alias("loop"))
        if loops is not None:
            inside = inside.unionByName(labels.join(loops, "id").select(F.col("label").alias("id"), "loop"))
        looped = Written(inside.groupBy("id").agg(F.sum("loop").alias("loop")), "loops")
        folded = Written(up.filter("c_src <> c_dst").select(F.col("c_src").alias("source_id"), F.col("c_dst").alias("target_id"), "weight"), "pairs")
        for table in done[1:]:  # the first one is what modularity is counted on
            table.drop()
        done[1:] = looped, folded
        loops, graph = looped.read(), folded.read()
        if graph.isEmpty():
            break
    for table in done:
        table.drop()
    return final.read()


def _through(final: DataFrame, labels: DataFrame) -> DataFrame:
    return final.select(F.col("id").alias("node"), F.col("label").alias("id")).join(labels, "id").select(F.col("node").alias("id"), "label")


def _quality(edges: DataFrame, labels: DataFrame) -> float:
    return modularity(edges, labels).first()["q"]


def community_nodes(labels: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(id, name, summary, size) of communities of at least that size."""
    sized = labels.join(names.select("id", "name"), "id").groupBy("label").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("name")).alias("names")).filter(F.col("size") >= least)
    return sized.select(
        F.concat(F.lit("community:"), "label").alias("id"), F.concat(F.lit("Community of "), F.col("size").cast("string")).alias("name"),
        F.array_join(F.slice("names", 1, 3), ", ").alias("summary"), "size",
    )


def random_walk(steps: DataFrame, seeds: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """(start, position, id): walks that take the step with the least hash."""
    now = seeds.select(F.col("id").alias("start"), F.lit(0).cast("bigint").alias("position"), "id")
    out = now = written(now, "walk")
    for k in range(1, length + 1):
        choice = now.join(steps, now["id"] == steps["node"]).groupBy("start").agg(F.min_by("next", F.struct(place(F.concat_ws(":", "start", "next", "via", F.lit(seed + k))), "next")).alias("id"))
        now = written(choice.select("start", F.lit(k).cast("bigint").alias("position"), "id"), "walk")
        out = out.unionByName(now)
    return out


def shuffled(nodes: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """Nodes in an order that a seed decides, the same at every run."""
    return nodes.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
