"""Queries of search and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from kronograph.functions import text as T
from kronograph.operators import graph, search
from kronograph.plans.registry import query
from kronograph.sources.model import edges, entities, episodes, table

Q = "the that"


@query(
    "search_memory",
    """SELECT id, name, substring(content, 1, 200) AS preview, round(CASE WHEN contains(lower(content), 'urgent') THEN 6 / greatest(CAST(strlen(content) AS DOUBLE), 1) ELSE 0.5 END, 6) AS score FROM episodes
 WHERE contains(lower(content), 'urgent') OR contains(lower(name), 'urgent') ORDER BY score DESC, valid_from DESC, id LIMIT 20""",
    "episodes",
)
def search_memory(spark, d):
    e = episodes(spark, d).withColumn("score", F.round(search.service_score("urgent", F.col("content"), F.col("name")), 6)).filter("score is not null")
    return search.top(e, 20, F.desc("score"), F.desc("valid_from"), "id").select("id", "name", F.substring("content", 1, 200).alias("preview"), "score")


@query(
    "related_memories",
    """WITH w AS (SELECT DISTINCT conv_id, unnest(string_split(lower(text), ' ')) AS w FROM conversations), mine AS (SELECT w FROM w WHERE conv_id = 3 AND length(w) > 6)
 SELECT conv_id AS id, count(*) AS shared FROM w WHERE conv_id <> 3 AND w IN (SELECT w FROM mine) GROUP BY conv_id""",
)
def _(spark, d):
    w = table(spark, d, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    mine = w.filter((F.col("conv_id") == 3) & (F.length("w") > 6)).select("w")
    return w.filter("conv_id <> 3").join(mine, "w", "left_semi").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("shared"))


def vec0(d):
    import pyarrow.dataset as ds  # noqa: F401

    return [round(((k * 37) % 11 - 5) / 5, 3) for k in range(64)]


QV = "[" + ",".join(f"{x}::DOUBLE" for x in vec0(None)) + "]"
E64 = "list_transform(embedding, lambda x: x::DOUBLE)"
FORMS = {
    "cosine": f"list_cosine_similarity({E64}, {QV})",
    "dot": f"list_dot_product({E64}, {QV})",
    "euclidean": f"-list_distance({E64}, {QV})",
}


def _vector(name, metric):
    @query(name, f"SELECT vec_id AS id, round({FORMS[metric]}, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 25")
    def _(spark, d):
        s = search.vector_scores(table(spark, d, "embeddings"), vec0(d), metric).withColumn("score", F.round("score", 6))
        return search.top(s, 25, F.desc("score"), "id")


for _name, _metric in (("vector_topk_cosine", "cosine"), ("vector_topk_dot", "dot"), ("vector_topk_euclid", "euclidean")):
    _vector(_name, _metric)


@query("vector_threshold", f"SELECT vec_id AS id FROM embeddings WHERE {FORMS['cosine']} > 0.1")
def _(spark, d):
    return search.vector_scores(table(spark, d, "embeddings"), vec0(d)).filter("score > 0.1").select("id")


TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
BM25 = f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
 p AS (SELECT doc_id, len(w) AS dl, token, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS token FROM t) WHERE token IN ('the', 'that', 'erst') GROUP BY ALL),
 f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
 b AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM p JOIN f USING (token), s GROUP BY doc_id)"""


def bm25_scores(spark, d, words="the that erst"):
    docs = table(spark, d, "documents")
    return search.bm25(search.postings(docs, "doc_id", {"content": "text"}, words.split()), search.index_sizes(docs, {"content": "text"}), words, {"content": 1.0})


@query("bm25", BM25 + " SELECT id, round(score, 6) AS score FROM b ORDER BY score DESC, id LIMIT 50")
def _(spark, d):
    return search.top(bm25_scores(spark, d).withColumn("score", F.round("score", 6)), 50, F.desc("score"), "id")


@query("min_score", BM25 + " SELECT id FROM b WHERE score >= 1.5")
def _(spark, d):
    return bm25_scores(spark, d).filter("score >= 1.5").select("id")


# DuckDB counts bytes: a letter beyond ASCII becomes one byte, which the term doesn't hold either
@query("fuzzy_terms", f"WITH v AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM documents) SELECT token, 'thing' AS term FROM v WHERE levenshtein(regexp_replace(token, '[^\\x00-\\x7F]', '#', 'g')[1:5], 'thing') <= 1")
def _(spark, d):
    v = search.postings(table(spark, d, "documents"), "doc_id", {"content": "text"}).select("token").distinct()
    return search.fuzzy_terms(v, "thing", 1)


@query("hybrid_search", BM25 + f", h AS (SELECT id, score * 0.6::DOUBLE AS score FROM b UNION ALL SELECT vec_id, 0.4::DOUBLE * {FORMS['cosine']} FROM embeddings) SELECT id, round(sum(score), 6) AS score FROM h GROUP BY id ORDER BY score DESC, id LIMIT 30")
def _(spark, d):
    h = search.hybrid(bm25_scores(spark, d), search.vector_scores(table(spark, d, "embeddings"), vec0(d)), 0.6, 0.4)
    return search.top(h.withColumn("score", F.round("score", 6)), 30, F.desc("score"), "id")


LEX = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((CASE WHEN contains(lower(text), 'the that') THEN 0.8::DOUBLE ELSE 0 END) + 0.5::DOUBLE * ((CASE WHEN list_contains(regexp_split_to_array(lower(text), '\\s+'), 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(regexp_split_to_array(lower(text), '\\s+'), 'that') THEN 1 ELSE 0 END) / 2.0::DOUBLE)) / (1 + strlen(text) / 1000.0::DOUBLE)))"


@query("rerank", f"SELECT doc_id AS id, round({LEX}, 6) AS score FROM documents ORDER BY score DESC, id LIMIT 40")
def _(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.round(search.lexical_score(Q, F.col("text")), 6).alias("score"))
    return search.top(s, 40, F.desc("score"), "id")


@query("keyword_count", "SELECT doc_id AS id, CAST((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), search.keyword_count("the que the", F.col("text")).alias("score"))


@query(
    "six_factor",
    f"""WITH deg AS (SELECT s_suppkey AS k, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), m AS (SELECT max(n) AS m FROM deg)
 SELECT 'S:'||s_suppkey AS id, round(0.30::DOUBLE * (CASE WHEN contains(lower(s_name), '1') THEN 1 ELSE 0 END) + 0.25::DOUBLE * 0.5 + 0.15::DOUBLE * n / m + 0.10::DOUBLE * exp(-s_nationkey / 10.0::DOUBLE) + 0.10::DOUBLE * n / m + 0.10::DOUBLE * 0.5, 6) AS score FROM supplier JOIN deg ON k = s_suppkey, m""",
)
def _(spark, d):
    s = table(spark, d, "supplier")
    deg = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    m = F.broadcast(deg.agg(F.max("n").alias("m")))  # one row
    j = s.join(deg, F.col("l_suppkey") == F.col("s_suppkey")).crossJoin(m)
    c = F.col("n") / F.col("m")
    score = search.six_factor(F.when(F.lower("s_name").contains("1"), 1.0).otherwise(0.0), F.lit(0.5), c, F.exp(-F.col("s_nationkey") / 10), c, F.lit(0.5))
    return j.select(F.concat(F.lit("S:"), "s_suppkey").alias("id"), F.round(score, 6).alias("score"))


GRAPH_SEARCH = """WITH hits AS (SELECT id, name, CASE WHEN lower(name) = 'nation_7' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM entities WHERE contains(lower(name), 'nation_7')),
 best AS (SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 1),
 steps AS (SELECT source_id AS node, target_id AS next FROM edges WHERE relationship IN ('IN_REGION','IN_NATION') UNION SELECT target_id, source_id FROM edges WHERE relationship IN ('IN_REGION','IN_NATION')),
 near AS (SELECT next AS id, score * 0.7::DOUBLE AS score FROM best JOIN steps ON node = id ORDER BY next LIMIT 3),
 every AS (SELECT id, score FROM hits UNION ALL SELECT id, score FROM near)
 SELECT id, round(max(score), 6) AS score FROM every GROUP BY id ORDER BY score DESC, id LIMIT 10"""


@query("graph_hybrid_search", GRAPH_SEARCH, "entities edges")
def graph_hybrid_search(spark, d):
    """Exact and partial name hits, and up to three neighbours of the best of them at 0.8 - 0.1 x depth."""
    term = "nation_7"
    name = F.lower("name")
    hits = entities(spark, d).filter(name.contains(term)).select("id", F.when(name == term, 1.0).otherwise(0.5).alias("score"))
    best = search.top(hits, 1, F.desc("score"), "id")
    steps = graph.adjacency(edges(spark, d, "IN_REGION", "IN_NATION")).select("node", "next").distinct()
    near = best.join(steps, F.col("id") == F.col("node")).select(F.col("next").alias("id"), (F.col("score") * 0.7).alias("score")).orderBy("id").limit(3)
    every = hits.unionByName(near).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))
    return search.top(every, 10, F.desc("score"), "id")


@query("any_term_search", "SELECT doc_id AS id FROM documents WHERE contains(text, 'erst') OR contains(text, 'queque') OR contains(text, 'schz')")
def _(spark, d):
    return table(spark, d, "documents").filter(T.any_of(F.col("text"), ["erst", "queque", "schz"])).select(F.col("doc_id").alias("id"))


@query("fact_search", "SELECT id, round(7 / CAST(strlen(fact) AS DOUBLE), 6) AS score FROM (SELECT id, lower(relationship)||' '||source_id||' '||target_id AS fact FROM edges WHERE relationship IN ('IN_REGION','IN_NATION')) WHERE contains(fact, 'in_regi')", "edges")
def _(spark, d):
    fact = F.concat_ws(" ", F.lower("relationship"), "source_id", "target_id")
    e = edges(spark, d, "IN_REGION", "IN_NATION").select("id", fact.alias("fact"))
    return e.select("id", F.round(search.service_score("in_regi", F.col("fact"), F.lit("")), 6).alias("score")).filter("score is not null")


@query("advanced_search", "SELECT doc_id AS id, round(" + LEX + " * CASE WHEN lang = 'en' THEN 1.5::DOUBLE ELSE 1 END, 6) AS score FROM documents WHERE source <> 'src3' ORDER BY score DESC, id LIMIT 10 OFFSET 10")
def _(spark, d):
    s = table(spark, d, "documents").filter("source <> 'src3'")
    score = F.round(search.lexical_score(Q, F.col("text")) * F.when(F.col("lang") == "en", 1.5).otherwise(1.0), 6)
    return search.top(s.select(F.col("doc_id").alias("id"), score.alias("score")), 10, F.desc("score"), "id", offset=10)


@query("chunk_vector_topk", f"SELECT label, vec_id AS id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round({FORMS['cosine']}, 6) DESC, vec_id) AS r FROM embeddings) WHERE r <= 3")
def _(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    s = search.vector_scores(e, vec0(d)).withColumn("score", F.round("score", 6)).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return s.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).filter("r <= 3").select("label", "id")


@query("pagination", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15 OFFSET 30")
def _(spark, d):
    return search.top(table(spark, d, "documents"), 15, F.desc("n_chars"), "doc_id", offset=30).select("doc_id")


@query("ordering_modes", "SELECT id FROM (SELECT source_id AS id, count(*) AS n FROM edges WHERE relationship = 'ORDERED' GROUP BY 1) ORDER BY n DESC, id LIMIT 20", "edges")
def _(spark, d):
    e = edges(spark, d, "ORDERED").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return search.top(e, 20, F.desc("n"), "id").select("id")
