"""Queries of the stored indexes, of merges, as-of joins, grouping sets and frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kronograph.functions import text as T
from kronograph.functions import vectors
from kronograph.operators import extract, providers, search, store, temporal
from kronograph.operators.index import TextIndex
from kronograph.operators.vector_index import VectorIndex
from kronograph.plans.registry import query
from kronograph.sources import files as sources
from kronograph.sources.model import edges, entities, table, ts
from kronograph.sources.shared import shared_folder

TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def text_index(spark, d) -> TextIndex:
    """All documents; German ones indexed a second time, French ones deleted."""
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").withColumns({"labels": F.array("lang", "source"), "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_chars").cast("int") % 365)})
    for part in (docs, docs.filter("lang = 'de'")):
        index.add(part, "doc_id", {"content": "text"}, "labels", "day")
    index.delete(docs.filter("lang = 'fr'").select("doc_id"))
    return index


@query(
    "text_index_search",
    f"""WITH t AS (SELECT doc_id, lang, DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) AS day, {TOKENS} AS w FROM documents WHERE lang <> 'fr'), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
 p AS (SELECT doc_id, lang, day, len(w) AS dl, token, count(*) AS tf FROM (SELECT doc_id, lang, day, w, unnest(w) AS token FROM t) WHERE token IN ('the', 'erst', 'que') GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM p GROUP BY token)
 SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM p JOIN f USING (token), s
 WHERE lang IN ('de', 'es') AND day >= DATE '2024-03-01' GROUP BY doc_id""",
)
def _(spark, d):
    return text_index(spark, d).search("the erst que", {"content": 1.0}, labels=["de", "es"], since="2024-03-01").withColumn("score", F.round("score", 6))


@query("text_index_facets", "SELECT label, count(*) AS n FROM (SELECT unnest([lang, source]) AS label FROM documents WHERE lang <> 'fr') GROUP BY label")
def _(spark, d):
    return text_index(spark, d).facets()


@query(
    "vector_index_topk",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 100 = 0)
 SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r <= 10""",
)
def _(spark, d):
    """The ten nearest rows of all for each row whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    found = VectorIndex(e, "vec_id", "embedding", 64).search(e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return found.select("query", "id", F.round("score", 6).alias("score"))


@query("merge_edges", "SELECT source_id, target_id, relationship, min(id) AS id, count(*) AS merged, sum(weight) AS weight, min(valid_from) AS valid_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to FROM edges WHERE relationship = 'SUPPLIED_BY' GROUP BY ALL", "edges")
def _(spark, d):
    return temporal.merge_edges(edges(spark, d, "SUPPLIED_BY"))


@query("asof_join", "SELECT e.event_id, arg_max(o.event_id, (o.ts, o.event_id)) AS before FROM events e JOIN events o ON o.user_id = e.user_id AND o.event_type <> 'error' AND o.ts <= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return temporal.as_of(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'").withColumnRenamed("event_id", "before"), ["user_id"], "ts", ["before"]).select("event_id", "before")


@query("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, grouping(l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    rows = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.grouping("l_linestatus").cast("bigint").alias("level"))


@query("cube_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("window_frames", "SELECT event_id, ntile(4) OVER w AS quarter, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 1, -1) OVER w AS after, round(sum(value) OVER w, 6) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.ntile(4).over(w).cast("bigint").alias("quarter"), F.lag("event_id", 1, -1).over(w).alias("before"), F.lead("event_id", 1, -1).over(w).alias("after"), F.round(F.sum("value").over(w), 6).alias("running"))


@query("entity_type_names", "SELECT p_partkey, coalesce(name, 'Entity') AS entity_type FROM part LEFT JOIN (VALUES (1, 'Person'), (2, 'Place'), (3, 'Thing')) t(id, name) ON p_size = id")
def _(spark, d):
    """Names of type ids, Entity where unknown."""
    names = F.create_map(*(F.lit(x) for pair in ((1, "Person"), (2, "Place"), (3, "Thing")) for x in pair))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(names, F.col("p_size")), F.lit("Entity")).alias("entity_type"))


_SAME = "CASE WHEN x.name = n.name THEN 1.0::DOUBLE ELSE 1 - levenshtein(x.name, n.name) / CAST(greatest(strlen(x.name), strlen(n.name)) AS DOUBLE) END"
_SCORE = f"0.5::DOUBLE * ({_SAME}) + 0.2::DOUBLE * (CASE WHEN x.type = n.type THEN 1 ELSE 0 END) + 0.3::DOUBLE * ({_SAME})"


@query(
    "merged_entities",
    f"""WITH RECURSIVE f AS (SELECT lower(p_name) AS name, p_type AS type, min('P:'||p_partkey) AS id FROM part GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM f),
 r AS (SELECT 0::BIGINT AS k, CAST([] AS STRUCT(id VARCHAR, name VARCHAR, type VARCHAR)[]) AS lead, '' AS id, '' AS leader
 UNION ALL SELECT k, CASE WHEN len(hit) = 0 THEN list_append(lead, {{'id': id, 'name': name, 'type': type}}) ELSE lead END, id, CASE WHEN len(hit) = 0 THEN id ELSE hit[1].id END FROM (SELECT n.k, n.id, n.name, n.type, r.lead, list_filter(r.lead, lambda x: {_SCORE} > 0.75::DOUBLE) AS hit FROM r JOIN n ON n.k = r.k + 1)),
 own AS (SELECT 'P:'||p_partkey AS id, r.leader, p_size / 50.0::DOUBLE AS c FROM part JOIN f ON lower(p_name) = f.name AND p_type = f.type JOIN r ON r.id = f.id)
 SELECT own.id, own.leader, t.type AS entity_type, round(least(1, avg(c) OVER (PARTITION BY own.leader)), 6) AS confidence FROM own JOIN f t ON t.id = own.leader""",
)
def _(spark, d):
    """Parts under the full score of names and types; the confidence is made of the size."""
    p = table(spark, d, "part").select(F.concat(F.lit("P:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), (F.col("p_size") / 50).alias("confidence"))
    return extract.merged_entities(p, "id", "name", "type", "confidence").withColumn("confidence", F.round("confidence", 6))


@query("span_dedup")
def _(spark, d):
    return extract.spans(table(spark, d, "documents"), "doc_id", "text")


@query("entity_candidates")
def _(spark, d):
    return extract.candidates(table(spark, d, "documents"), "doc_id", "text")


@query("graph_rerank", "WITH hits AS (SELECT id, 1.0::DOUBLE AS score FROM entities WHERE contains(lower(name), 'nation_1')), steps AS (SELECT source_id AS id, target_id AS other FROM edges WHERE relationship IN ('IN_REGION','IN_NATION') UNION ALL SELECT target_id, source_id FROM edges WHERE relationship IN ('IN_REGION','IN_NATION')), near AS (SELECT s.id, count(h.id) / CAST(count(*) AS DOUBLE) AS share FROM steps s LEFT JOIN hits h ON h.id = s.other GROUP BY s.id) SELECT h.id, round(h.score + 0.1::DOUBLE * coalesce(share, 0), 6) AS score FROM hits h LEFT JOIN near USING (id)", "entities edges")
def _(spark, d):
    """Hits with a tenth of the share of their neighbours that are hits as well."""
    hits = entities(spark, d).filter(F.lower("name").contains("nation_1")).select("id", F.lit(1.0).alias("score"))
    return search.graph_rerank(hits, edges(spark, d, "IN_REGION", "IN_NATION"), 0.1).withColumn("score", F.round("score", 6))


@query("content_conflicts", "SELECT source_id, target_id, relationship, valid_from, count(DISTINCT (properties, weight)) AS contents, min(id) AS first FROM edges WHERE relationship = 'ORDERED' GROUP BY ALL HAVING count(DISTINCT (properties, weight)) > 1", "edges")
def _(spark, d):
    return temporal.contradictions(edges(spark, d, "ORDERED"))


@query("task_levels", "SELECT 'R:'||r_regionkey AS id, 0::BIGINT AS level FROM region UNION ALL SELECT 'N:'||n_nationkey, 1 FROM nation UNION ALL SELECT 'C:'||c_custkey, 2 FROM customer")
def _(spark, d):
    """Customers need their nation, nations their region."""
    tasks = entities(spark, d).filter(F.col("entity_type").isin("Region", "Nation", "Customer")).select("id")
    needs = edges(spark, d, "IN_REGION", "IN_NATION").select(F.col("source_id").alias("id"), F.col("target_id").alias("needed"))
    return providers.task_levels(tasks, needs)


@query("degraded_values", "SELECT user_id, coalesce(f.v, o.v) AS value, f.v IS NULL AS stale FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1) f FULL JOIN (SELECT user_id, min(value) AS v FROM events GROUP BY 1) o USING (user_id)")
def _(spark, d):
    e = table(spark, d, "events")
    fresh = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("value").alias("value"))
    return providers.degraded(fresh, e.groupBy("user_id").agg(F.min("value").alias("value")), "user_id", "value")


@query("provider_fallback", "SELECT conv_id, turn, length(text) AS answer, 'second' AS provider, 3 AS tries FROM conversations WHERE text IS NOT NULL")
def _(spark, d):
    """The first provider always fails, so the second one answers at the third try."""

    def first(texts):
        raise ConnectionError

    told = providers.answered(table(spark, d, "conversations").filter("text is not null"), "text", {"first": first, "second": lambda texts: [len(t) for t in texts]}, attempts=2, kind="bigint")
    return told.select("conv_id", "turn", "answer", "provider", "tries")


@query("embedding_cache", "SELECT count(*) AS rows, count(DISTINCT text) AS texts, count(text) AS embedded FROM documents")
def _(spark, d):
    """Rows, distinct vectors of distinct texts, and rows with a vector."""
    docs = providers.embedded(table(spark, d, "documents"), "text", lambda t: F.array(F.xxhash64(t).cast("double"), F.octet_length(t).cast("double")))
    return docs.agg(F.count("*").alias("rows"), F.count_distinct("embedding").alias("texts"), F.count("embedding").alias("embedded"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("line_edits", "SELECT doc_id, md5(array_to_string(list_concat(list_concat(l[1:1], ['new line']), l[4:]), chr(10))) AS hash FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(spark, d):
    """The second and third line of each text replaced by one."""
    return table(spark, d, "documents").select("doc_id", F.md5(store.line_edit(F.col("text"), 2, 3, ["new line"])).alias("hash"))


@query("chunk_ids", "SELECT doc_id, 'chunk_'||md5(text)[1:16] AS chunk, md5(source)[1:8] AS collection FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("text")).alias("chunk"), T.collection_name(F.col("source")).alias("collection"))


@query("retry_delays", "SELECT event_id, least(100 * pow(2.0::DOUBLE, event_id % 12), 30000) AS delay FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.retry_delay(F.col("event_id") % 12).alias("delay"))


@query("fitted_vectors", "SELECT vec_id, len(v) AS n, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) || [0.0::DOUBLE, 0.0::DOUBLE] AS v FROM embeddings)")
def _(spark, d):
    """Unit vectors, padded by two zeros."""
    v = vectors.fitted(vectors.normalised(F.col("embedding")), 66)
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("square"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("compacted", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, d):
    many, few = _folder(spark, "orders"), _folder(spark, "compact")
    table(spark, d, "orders").repartition(16).write.parquet(many)
    store.compact(spark, many, few, 2, ["o_orderdate"])
    return spark.read.parquet(few).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("stored_chunks", "SELECT md5(source)[1:8] AS collection, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY source")
def _(spark, d):
    """Chunks by collection; one collection is dropped by its folder."""
    at = _folder(spark, "chunks")
    sources.append_chunks(table(spark, d, "documents").select(T.collection_name(F.col("source")).alias("collection"), T.chunk_id(F.col("text")).alias("id"), "text"), at)
    gone = table(spark, d, "documents").filter("source = 'src1'").select(T.collection_name(F.col("source")).alias("collection")).distinct()
    return spark.read.schema("id string, text string, collection string").parquet(at).join(gone, "collection", "left_anti").groupBy("collection").agg(F.count("*").alias("n"))


@query("chunk_lines", "SELECT 'chunk_'||md5(text)[1:16] AS id, 1::BIGINT AS start_line FROM documents")
def _(spark, d):
    """Chunks through a folder of JSON lines."""
    at = _folder(spark, "lines")
    table(spark, d, "documents").select(T.chunk_id(F.col("text")).alias("id"), F.col("text").alias("content"), F.lit(1).alias("start_line")).write.json(at)
    return sources.chunk_lines(spark, at).select("id", "start_line")


@query("vector_store", "SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY label")
def _(spark, d):
    """Vectors added in two appends, then one label's deleted."""
    at = _folder(spark, "vectors")
    e = table(spark, d, "embeddings")
    for part in (e.filter("label < 5"), e.filter("label >= 5")):
        sources.append_vectors(part, at, 64)
    kept = store.without(spark.read.schema(e.schema).parquet(at), e.filter("label = 3"), "vec_id")
    return kept.groupBy("label").agg(F.count("*").alias("n"))


@query("edge_lookup", "SELECT id, source_id, target_id FROM edges WHERE id = 'IN_NATION:C:7'", "edges")
def _(spark, d):
    return edges(spark, d, "IN_NATION").filter("id = 'IN_NATION:C:7'").select("id", "source_id", "target_id")


@query("nodes_as_of", "SELECT entity_type, count(*) AS n FROM entities WHERE valid_from <= TIMESTAMP '1995-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-01-01') GROUP BY 1", "entities")
def _(spark, d):
    return temporal.snapshot(entities(spark, d), ts("1995-01-01")).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("edge_type_filter", "SELECT relationship, count(*) AS n FROM edges WHERE relationship IN ('IN_REGION', 'ORDERED') GROUP BY 1", "edges")
def _(spark, d):
    return edges(spark, d, "IN_REGION", "ORDERED").groupBy("relationship").agg(F.count("*").alias("n"))
