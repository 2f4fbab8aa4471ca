"""Queries of traversal, components, communities and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from kronograph.operators import graph
from kronograph.operators.components import connected_components
from kronograph.plans.registry import query
from kronograph.sources.model import edges, entities, table


def places(spark, d):
    return edges(spark, d, "IN_REGION", "IN_NATION")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


PLACES = "steps AS (SELECT source_id AS node, target_id AS next FROM edges WHERE relationship IN ('IN_REGION','IN_NATION') UNION SELECT target_id, source_id FROM edges WHERE relationship IN ('IN_REGION','IN_NATION'))"


def reach(start: str, depth: int) -> str:
    return f"""WITH {PLACES}, walk AS (SELECT unnest([{start}]) AS id, 0 AS depth UNION SELECT next, depth + 1 FROM walk JOIN steps ON walk.id = steps.node WHERE depth < {depth}),
 found AS (SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY id)"""


@query("bfs", reach("'S:3'", 3) + " SELECT id, depth FROM found", "edges", recursive=True)
def _(spark, d):
    return graph.bfs(graph.adjacency(places(spark, d)), seeds(spark, "S:3"), 3).select("id", "depth")


@query("neighbours", reach("'N:4'", 1) + " SELECT id FROM found WHERE depth > 0", "edges", recursive=True)
def _(spark, d):
    return graph.bfs(graph.adjacency(places(spark, d)), seeds(spark, "N:4"), 1).filter("depth > 0").select("id")


@query("multi_seed_expand", reach("'S:3','C:5','R:2'", 2) + " SELECT id, depth FROM found", "edges", recursive=True)
def _(spark, d):
    return graph.bfs(graph.adjacency(places(spark, d)), seeds(spark, "S:3", "C:5", "R:2"), 2).select("id", "depth")


@query("dfs_set", reach("'S:3'", 2) + " SELECT id FROM found", "edges", recursive=True)
def _(spark, d):
    return graph.depth_first_set(graph.adjacency(places(spark, d)), seeds(spark, "S:3"), 3)


def path_sql(a: str, b: str) -> str:
    return f"""WITH {PLACES}, walk AS (SELECT '{a}' AS id, ['{a}'] AS path UNION ALL SELECT next, list_append(path, next) FROM walk JOIN steps ON walk.id = steps.node
 WHERE len(path) <= 4 AND NOT list_contains(path, next) AND (next LIKE 'N:%' OR next LIKE 'R:%' OR next = '{b}')),
 best AS (SELECT path FROM walk WHERE id = '{b}' ORDER BY len(path), path LIMIT 1)
 SELECT CAST(i - 1 AS BIGINT) AS position, path[i] AS id FROM best, range(1, len(path) + 1) t(i)"""


@query("shortest_path", path_sql("S:3", "C:1"), "edges", recursive=True)
def _(spark, d):
    return graph.shortest_path(graph.adjacency(places(spark, d)), "S:3", "C:1", 6)


@query("path_between", path_sql("N:1", "N:6"), "edges", recursive=True)
def _(spark, d):
    return graph.shortest_path(graph.adjacency(places(spark, d)), "N:1", "N:6", 4)


@query("components", "SELECT 'N:'||n_nationkey AS node, min('N:'||n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation UNION ALL SELECT 'R:'||n_regionkey, min('N:'||n_nationkey) FROM nation GROUP BY n_regionkey")
def _(spark, d):
    return connected_components(edges(spark, d, "IN_REGION"), "source_id", "target_id")


@query("degree", "SELECT id, count(*) AS degree, sum(weight) AS strength FROM (SELECT source_id AS id, weight FROM edges WHERE relationship = 'ORDERED' UNION ALL SELECT target_id, weight FROM edges WHERE relationship = 'ORDERED') GROUP BY id", "edges")
def _(spark, d):
    return graph.degrees(edges(spark, d, "ORDERED"))


@query("edge_weight_total", "SELECT relationship, sum(weight) AS weight FROM edges GROUP BY relationship", "edges")
def _(spark, d):
    return edges(spark, d).groupBy("relationship").agg(F.sum("weight").alias("weight"))


def trade(spark, d):
    """Nation to nation: quantity that customers of one bought from suppliers of the other, without loops."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    out = joined.filter("c_nationkey <> s_nationkey").groupBy(F.concat(F.lit("N:"), "c_nationkey").alias("source_id"), F.concat(F.lit("N:"), "s_nationkey").alias("target_id")).agg(F.sum("l_quantity").alias("weight"))
    return out.withColumn("id", F.concat_ws(">", "source_id", "target_id"))


TRADE = "trade AS (SELECT 'N:'||c_nationkey AS source_id, 'N:'||s_nationkey AS target_id, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL), labels AS (SELECT 'N:'||n_nationkey AS id, 'R:'||n_regionkey AS label FROM nation)"


def regions(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.concat(F.lit("R:"), "n_regionkey").alias("label"))


@query(
    "community_stats",
    f"""WITH {TRADE}, e AS (SELECT a.label AS la, b.label AS lb FROM trade JOIN labels a ON a.id = source_id JOIN labels b ON b.id = target_id),
 s AS (SELECT label, count(*) AS members FROM labels GROUP BY label)
 SELECT label, members, (SELECT count(*) FROM e WHERE la = label AND lb = label) AS internal, (SELECT count(*) FROM e WHERE (la = label) <> (lb = label)) AS external,
 CASE WHEN members > 1 THEN 2.0::DOUBLE * (SELECT count(*) FROM e WHERE la = label AND lb = label) / (members * (members - 1)) ELSE 0 END::DOUBLE AS density FROM s""",
)
def _(spark, d):
    return graph.community_stats(trade(spark, d), regions(spark, d))


@query(
    "modularity_of_region_partition",
    f"""WITH {TRADE}, e AS (SELECT a.label AS la, b.label AS lb, weight AS w FROM trade JOIN labels a ON a.id = source_id JOIN labels b ON b.id = target_id),
 m AS (SELECT sum(w) AS m FROM e), s AS (SELECT label, sum(w) AS k FROM (SELECT la AS label, w FROM e UNION ALL SELECT lb, w FROM e) GROUP BY label)
 SELECT round(sum(coalesce((SELECT sum(w) FROM e WHERE la = label AND lb = label), 0) / m - (k / (2 * m)) * (k / (2 * m))), 6) AS q FROM s, m""",
)
def _(spark, d):
    return graph.modularity(trade(spark, d), regions(spark, d)).select(F.round("q", 6).alias("q"))


@query("supergraph", f"WITH {TRADE} SELECT least(a.label, b.label) AS c_src, greatest(a.label, b.label) AS c_dst, sum(weight) AS weight FROM trade JOIN labels a ON a.id = source_id JOIN labels b ON b.id = target_id GROUP BY ALL")
def _(spark, d):
    return graph.supergraph(trade(spark, d), regions(spark, d))


@query("community_nodes", "SELECT 'community:R:'||r_regionkey AS id, 'Community of '||count(*) AS name, array_to_string(list_sort(list(n_name))[1:3], ', ') AS summary, count(*) AS size FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey HAVING count(*) >= 3")
def _(spark, d):
    return graph.community_nodes(regions(spark, d), entities(spark, d))


def propagation_sql(rounds: int) -> str:
    out = ["lives AS (SELECT 'S:'||s_suppkey AS id, 'N:'||s_nationkey AS other FROM supplier UNION ALL SELECT 'C:'||c_custkey, 'N:'||c_nationkey FROM customer)", "both_ends AS (SELECT * FROM lives UNION ALL SELECT other, id FROM lives)", "l0 AS (SELECT DISTINCT id, id AS label FROM both_ends)"]
    for k in range(rounds):
        out.append(f"l{k + 1} AS (SELECT id, label FROM (SELECT b.id, l.label, row_number() OVER (PARTITION BY b.id ORDER BY count(*) DESC, l.label) AS r FROM both_ends b JOIN l{k} l ON b.other = l.id GROUP BY b.id, l.label) WHERE r = 1)")
    return "WITH " + ",\n".join(out) + f" SELECT id, label FROM l{rounds}"


@query("label_propagation", propagation_sql(5))
def _(spark, d):
    return graph.label_propagation(edges(spark, d, "IN_NATION"), 5)


def pagerank_sql(rounds: int) -> str:
    out = ["links AS (SELECT source_id, target_id, count(*) AS n FROM edges WHERE relationship IN ('IN_NATION','IN_REGION') GROUP BY ALL)", "share AS (SELECT source_id, target_id, n / sum(n) OVER (PARTITION BY source_id) AS share FROM links)", "nodes AS (SELECT source_id AS id FROM links UNION SELECT target_id FROM links)", "size AS (SELECT count(*) AS n FROM nodes)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, size)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS (SELECT nodes.id, 0.15::DOUBLE / size.n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM size, nodes LEFT JOIN (SELECT target_id AS id, sum(share * rank) AS got FROM share JOIN r{k} ON source_id = r{k}.id GROUP BY target_id) g ON g.id = nodes.id)")
    return "WITH " + ",\n".join(out) + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query("pagerank", pagerank_sql(5), "edges")
def _(spark, d):
    return graph.pagerank(places(spark, d), 5).select("id", F.round("rank", 6).alias("rank"))


@query("louvain")
def _(spark, d):
    return graph.louvain(trade(spark, d), rounds=6, levels=2)


_TURN = "CAST('0x'||substr(md5(start||':'||target_id||':'||e.id||':'||(position + 1)), 1, 15) AS BIGINT)"


@query(
    "random_walk",
    f"""steps AS (SELECT * FROM edges WHERE relationship IN ('IN_REGION', 'IN_NATION')),
 w0 AS (SELECT id AS start, 0::BIGINT AS position, id FROM entities WHERE entity_type = 'Supplier'),
 w1 AS (SELECT start, 1::BIGINT AS position, arg_min(target_id, ({_TURN}, target_id)) AS id FROM w0 JOIN steps e ON e.source_id = w0.id GROUP BY start),
 w2 AS (SELECT start, 2::BIGINT AS position, arg_min(target_id, ({_TURN}, target_id)) AS id FROM w1 JOIN steps e ON e.source_id = w1.id GROUP BY start)
 SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2""".replace("steps AS", "WITH steps AS", 1),
    "entities edges",
)
def _(spark, d):
    return graph.random_walk(graph.adjacency(places(spark, d), "out"), entities(spark, d).filter("entity_type = 'Supplier'"), 2)


@query("relation_mode", "SELECT source_id, arg_min(properties, (-n, properties)) AS mode FROM (SELECT source_id, properties, count(*) AS n FROM edges WHERE relationship = 'ORDERED' GROUP BY ALL) GROUP BY source_id", "edges")
def _(spark, d):
    counted = edges(spark, d, "ORDERED").groupBy("source_id", "properties").agg(F.count("*").alias("n"))
    return counted.groupBy("source_id").agg(F.min_by("properties", F.struct(-F.col("n"), "properties")).alias("mode"))


@query("graph_summary", "SELECT (SELECT count(*) FROM entities) + (SELECT count(*) FROM episodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM episodes WHERE episode_type = 'document') AS files, (SELECT count(*) FROM entities) AS entities", "entities episodes edges")
def _(spark, d):
    from kronograph.sources.model import episodes

    n = entities(spark, d).agg(F.count("*").alias("entities"))
    p = episodes(spark, d).agg(F.count("*").alias("episodes"), F.count_if(F.col("episode_type") == "document").alias("files"))
    e = edges(spark, d).agg(F.count("*").alias("edges"))
    return n.crossJoin(p).crossJoin(e).select((F.col("entities") + F.col("episodes")).alias("nodes"), "edges", "files", "entities")  # single rows


@query("repeated_relations", "SELECT source_id, target_id, count(*) AS n FROM edges WHERE relationship = 'ORDERED' GROUP BY ALL HAVING count(*) > 1", "edges")
def _(spark, d):
    return edges(spark, d, "ORDERED").groupBy("source_id", "target_id").agg(F.count("*").alias("n")).filter("n > 1")
