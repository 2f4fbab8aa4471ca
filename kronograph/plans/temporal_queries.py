"""Queries of the bi-temporal core: scans, predicates, snapshots, conflicts, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kronograph.operators import store, temporal
from kronograph.plans.registry import query
from kronograph.sources.model import edges, entities, episodes, table, ts

AT, START, END = "1998-06-01", "1997-01-01", "1997-03-31"
SHOWN = ("id", "source_id", "target_id", "relationship")


@query("node_by_id", "SELECT id, name, entity_type FROM entities WHERE id IN ('C:7', 'P:11', 'R:1')", "entities")
def _(spark, d):
    return entities(spark, d).filter(F.col("id").isin("C:7", "P:11", "R:1")).select("id", "name", "entity_type")


@query("union_nodes", "SELECT id, name, entity_type AS kind FROM entities UNION ALL SELECT id, name, episode_type FROM episodes", "entities episodes")
def _(spark, d):
    a = entities(spark, d).select("id", "name", F.col("entity_type").alias("kind"))
    return a.unionByName(episodes(spark, d).select("id", "name", F.col("episode_type").alias("kind")))


@query("node_filter", "SELECT id, name FROM entities WHERE entity_type = 'Supplier'", "entities")
def _(spark, d):
    return entities(spark, d).filter(F.array_contains("labels", "Supplier")).select("id", "name")


@query("property_filter", "SELECT 'C:'||c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return entities(spark, d).filter((F.col("entity_type") == "Customer") & (F.get_json_object("properties", "$.segment") == "BUILDING")).select("id", "name")


@query("numeric_range", "SELECT 'P:'||p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size BETWEEN 10 AND 20")
def _(spark, d):
    size = F.expr("try_variant_get(parse_json(properties), '$.size', 'bigint')")
    return entities(spark, d).filter(F.col("entity_type") == "Part").withColumn("size", size).filter(F.col("size").between(10, 20)).select("id", "size")


@query("text_contains", "SELECT 'P:'||p_partkey AS id FROM part WHERE contains(lower(p_type), 'promo') OR contains(lower(p_brand), 'promo')")
def _(spark, d):
    return entities(spark, d).filter((F.col("entity_type") == "Part") & F.lower("properties").contains("promo")).select("id")


@query("date_range", f"SELECT id, valid_from FROM episodes WHERE episode_type = 'event' AND valid_from BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'", "episodes")
def _(spark, d):
    return episodes(spark, d).filter((F.col("episode_type") == "event") & F.col("valid_from").between(ts(START), ts(END))).select("id", "valid_from")


@query("edges_of_node", "SELECT id, source_id, target_id, relationship FROM edges WHERE source_id = 'P:5' OR target_id = 'P:5'", "edges")
def _(spark, d):
    return store.adjacent(edges(spark, d), "P:5", "both").select(*SHOWN)


@query("recent_edges", "SELECT id, created_at FROM edges WHERE relationship = 'ORDERED' ORDER BY created_at DESC, id LIMIT 50", "edges")
def _(spark, d):
    return store.recent(edges(spark, d, "ORDERED"), "ORDERED", 50).select("id", "created_at")


@query("newest_edges", "SELECT id, created_at FROM edges ORDER BY created_at DESC, id LIMIT 2000", "edges")
def _(spark, d):
    return edges(spark, d).orderBy(F.desc("created_at"), "id").limit(2000).select("id", "created_at")


@query("prune_edges", "SELECT id FROM edges WHERE relationship IN ('ORDERED','SUPPLIED_BY') ORDER BY created_at DESC, id LIMIT 5000", "edges")
def _(spark, d):
    return store.prune_to(edges(spark, d, "ORDERED", "SUPPLIED_BY"), 5000).select("id")


@query("snapshot_at", f"SELECT id, source_id, target_id, relationship FROM edges WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR TIMESTAMP '{AT}' < valid_to)", "edges")
def _(spark, d):
    return temporal.snapshot(edges(spark, d), ts(AT)).select(*SHOWN)


@query("range_overlap", f"SELECT id, valid_from, valid_to FROM edges WHERE relationship = 'SUPPLIED_BY' AND valid_from <= TIMESTAMP '{END}' AND coalesce(valid_to, TIMESTAMP '{END}') >= TIMESTAMP '{START}'", "edges")
def _(spark, d):
    return temporal.overlapping(edges(spark, d, "SUPPLIED_BY"), ts(START), ts(END)).select("id", "valid_from", "valid_to")


FAR = "TIMESTAMP '9999-12-31'"


@query(
    "conflicts",
    f"""SELECT a.source_id, a.target_id, a.relationship, a.id AS edge1, b.id AS edge2, b.valid_from AS overlap_start,
 nullif(least(coalesce(a.valid_to, {FAR}), coalesce(b.valid_to, {FAR})), {FAR}) AS overlap_end
 FROM edges a JOIN edges b ON a.source_id = b.source_id AND a.target_id = b.target_id AND a.relationship = b.relationship
 AND (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.id < b.id)) AND b.valid_from <= coalesce(a.valid_to, {FAR})
 WHERE a.relationship = 'SUPPLIED_BY'""",
    "edges",
)
def _(spark, d):
    return temporal.conflicts(edges(spark, d, "SUPPLIED_BY"))


@query("resolve_conflicts", "SELECT id, valid_from, least(valid_to, lead(valid_from) OVER (PARTITION BY source_id, target_id, relationship ORDER BY valid_from, created_at, id)) AS valid_to FROM edges WHERE relationship = 'SUPPLIED_BY'", "edges")
def _(spark, d):
    return temporal.resolve(edges(spark, d, "SUPPLIED_BY")).select("id", "valid_from", "valid_to")


@query(
    "version_history",
    """SELECT id, version, superseded_at, coalesce(superseded_at <= coalesce(valid_to, superseded_at), false) AS conflicting FROM (
 SELECT id, valid_to, row_number() OVER w AS version, lead(valid_from) OVER w AS superseded_at FROM edges WHERE relationship = 'SUPPLIED_BY'
 WINDOW w AS (PARTITION BY source_id, target_id, relationship ORDER BY valid_from, id))""",
    "edges",
)
def _(spark, d):
    return temporal.versions(edges(spark, d, "SUPPLIED_BY")).select("id", "version", "superseded_at", "conflicting")


@query("expired_edges", f"SELECT id FROM edges WHERE valid_to < TIMESTAMP '{AT}'", "edges")
def _(spark, d):
    return temporal.expired(edges(spark, d, "SUPPLIED_BY"), ts(AT)).select("id")


@query("invalidations", "SELECT 'SUPPLIED_BY:'||l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey||':'||strftime(l_shipdate,'%Y%m%d') AS id, TIMESTAMP '2000-01-01' AS expired_at, 'returned' AS reason FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    e = edges(spark, d, "SUPPLIED_BY")
    ids = e.filter(F.get_json_object("properties", "$.flag") == "R").select("id", F.lit("returned").alias("reason"))
    return temporal.invalidate(e, ids, ts("2000-01-01")).filter("reason is not null").select("id", "expired_at", "reason")


@query("interval_recency_weight", f"SELECT id, CASE WHEN valid_from BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM episodes WHERE episode_type = 'event'", "episodes")
def _(spark, d):
    return episodes(spark, d).filter("episode_type = 'event'").select("id", temporal.recency_weight(F.lit(1.0), F.col("valid_from"), ts(START), ts(END)).alias("score"))


@query("upsert_nodes", "SELECT 'C:'||c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name)||'!' ELSE c_name END AS name FROM customer UNION ALL SELECT 'X:'||r_regionkey, 'new '||r_name FROM region")
def _(spark, d):
    base = entities(spark, d).filter("entity_type = 'Customer'").select("id", "name", "created_at")
    c = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("C:"), "c_custkey").alias("id"), F.concat(F.upper("c_name"), F.lit("!")).alias("name"), ts("1999-01-01").alias("created_at"))
    r = table(spark, d, "region").select(F.concat(F.lit("X:"), "r_regionkey").alias("id"), F.concat(F.lit("new "), "r_name").alias("name"), ts("1999-01-01").alias("created_at"))
    return store.latest(base.unionByName(c).unionByName(r), ["id"], "created_at").select("id", "name")


@query("delete_edges", "SELECT id FROM edges WHERE relationship = 'IN_NATION' AND source_id NOT LIKE 'S:%'", "edges")
def _(spark, d):
    e = edges(spark, d, "IN_NATION")
    return store.without(e, e.filter(F.col("source_id").startswith("S:")).select("id")).select("id")


@query(
    "signature_dedup",
    """SELECT min(id) AS id, source_id, target_id, count(*) AS signatures FROM (
 SELECT source_id, target_id, relationship, json_extract_string(properties, '$.flag') AS flag, min(id) AS id FROM edges WHERE relationship = 'SUPPLIED_BY' GROUP BY ALL) GROUP BY source_id, target_id""",
    "edges",
)
def _(spark, d):
    flag = F.get_json_object("properties", "$.flag").alias("flag")
    e = edges(spark, d, "SUPPLIED_BY").select("id", "source_id", "target_id", "relationship", flag)
    e = store.first_per_signature(e, [F.col(c) for c in ("source_id", "target_id", "relationship", "flag")])
    return e.groupBy("source_id", "target_id").agg(F.min("id").alias("id"), F.count("*").alias("signatures"))


@query("kv_latest", "SELECT event_type AS ns, CAST(user_id AS VARCHAR) AS k, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY event_type, user_id")
def _(spark, d):
    puts = table(spark, d, "events").select(F.col("event_type").alias("ns"), F.col("user_id").cast("string").alias("k"), F.col("value").alias("v"), "ts", "event_id")
    return store.kv_view(puts, ["ns", "k"], "v", ["ts", "event_id"])


@query("set_difference", "SELECT id FROM entities WHERE entity_type = 'Customer' AND id NOT IN (SELECT source_id FROM edges WHERE relationship = 'ORDERED')", "entities edges")
def _(spark, d):
    return store.without(entities(spark, d).filter("entity_type = 'Customer'").select("id"), edges(spark, d, "ORDERED").select(F.col("source_id").alias("id")))


@query("union_distinct", "SELECT source_id AS id FROM edges WHERE relationship = 'ORDERED' UNION SELECT target_id FROM edges WHERE relationship = 'ORDERED'", "edges")
def _(spark, d):
    e = edges(spark, d, "ORDERED")
    return e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).distinct()


@query(
    "graph_transformation",
    """SELECT id, CASE WHEN entity_type = 'Supplier' THEN lower(name) ELSE name END AS name FROM entities WHERE entity_type <> 'Part' UNION ALL SELECT 'T:1', 'added'""",
    "entities",
)
def _(spark, d):
    base = entities(spark, d).select("id", "name", "entity_type")
    deletes = base.filter("entity_type = 'Part'").select("id")
    updates = base.filter("entity_type = 'Supplier'").select("id", F.lower("name").alias("name"))
    adds = spark.createDataFrame([("T:1", "added")], "id string, name string")
    return store.transform(base.select("id", "name"), deletes, updates, adds)


@query("batch_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) > 0 THEN round((count(*) - count(*) FILTER (event_type = 'error')) * 100.0 / count(*), 6) ELSE 0 END::DOUBLE AS success_rate FROM events GROUP BY event_type")
def _(spark, d):
    return store.batch_result(table(spark, d, "events"), ["event_type"], F.col("event_type") == "error")


@query("chunk_files_removed", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def _(spark, d):
    return store.remove_paths(table(spark, d, "documents"), "source", ["src1", "src2"]).groupBy("source").agg(F.count("*").alias("n"))
