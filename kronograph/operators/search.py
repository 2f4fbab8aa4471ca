"""Search and ranking (X1-X17, V1-V5, K1-K7): lexical, vector and graph candidates, merged and ranked by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronograph.functions import vectors
from kronograph.functions.text import words


def bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("double")


def service_score(query: str, content: Column, name: Column) -> Column:
    """Bytes of the query over bytes of the content on a content hit, 0.5 on a name hit, else null."""
    q = query.lower()
    return F.when(F.lower(content).contains(q), len(q.encode()) / F.greatest(bytes_of(content), F.lit(1.0))).when(F.lower(name).contains(q), 0.5)


def lexical_score(query: str, content: Column) -> Column:
    """0.8 for the phrase, 0.5 x share of query words among the content's, damped by length, within 0..1."""
    q, text = query.lower(), F.lower(content)
    terms = q.split()
    own = words(text)
    phrase = F.when(text.contains(q), 0.8).otherwise(0.0)
    share = sum(F.when(F.array_contains(own, t), 1.0).otherwise(0.0) for t in terms) / max(1, len(terms)) if terms else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (phrase + 0.5 * share) / (1 + bytes_of(content) / 1000)))


def top(df: DataFrame, limit: int, *order: Column | str, offset: int = 0) -> DataFrame:
    """A page of the best rows (K1-K5): a distributed top-k."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def postings(docs: DataFrame, id_col: str, fields: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """(field, token, id, tf, dl): the inverted index of some text columns (X1), of some tokens only if a query needs no others."""
    out = None
    for field, column in fields.items():
        token = F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        # counted within each document first, so its tokens are never shuffled one by one
        counted = docs.select(F.col(id_col).alias("id"), F.explode(F.array(token if only else F.array_sort(token))).alias("tokens"))
        kept = F.filter("tokens", lambda w: w.isin(*only)) if only else F.col("tokens")
        rows = counted.select(F.lit(field).alias("field"), "id", F.size("tokens").alias("dl"), F.explode(kept).alias("token")).groupBy("field", "token", "id", "dl").agg(F.count("*").alias("tf"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bm25(index: DataFrame, sizes: DataFrame, query: str, boosts: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25 with field boosts (X2). sizes: (field, n, avgdl). The token filter reaches the index scan."""
    hits = index.filter(F.col("token").isin(query.lower().split()))
    df = hits.groupBy("field", "token").agg(F.count("*").alias("df"))
    boost = F.lit(1.0)
    for field, x in boosts.items():
        boost = F.when(F.col("field") == field, x).otherwise(boost)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.join(df, ["field", "token"]).join(sizes, "field").groupBy("id").agg(F.sum(weight * boost).alias("score"))


def index_sizes(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, n, avgdl): number and mean length of each field's texts."""
    out = None
    for field, column in fields.items():
        token = words(F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", " "))
        row = docs.agg(F.count("*").alias("n"), F.avg(F.size(token)).alias("avgdl")).select(F.lit(field).alias("field"), "n", "avgdl")
        out = row if out is None else out.unionByName(row)
    return out


def fuzzy_terms(vocabulary: DataFrame, query: str, distance: int) -> DataFrame:
    """(token, term): vocabulary whose prefix is within an edit distance of a query term."""
    out = None
    for term in query.lower().split():
        rows = vocabulary.filter(F.levenshtein(F.substring("token", 1, len(term)), F.lit(term), distance) >= 0).select("token", F.lit(term).alias("term"))
        out = rows if out is None else out.unionByName(rows)
    return out


def keyword_count(query: str, content: Column) -> Column:
    """How many of the query's words a text contains."""
    text = F.lower(content)
    return sum((F.when(text.contains(t), 1).otherwise(0) for t in query.lower().split()), F.lit(0)).cast("bigint")


def vector_scores(table: DataFrame, query: list[float], metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of all vectors against one query (V1, V2); the query is a literal, so nothing is shuffled."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vector_col)
    score = {"cosine": vectors.cosine, "dot": vectors.dot, "euclidean": lambda a, b: -vectors.euclidean(a, b)}[metric](v, q)
    return table.filter(F.size(v) == len(query)).select(F.col(id_col).alias("id"), score.alias("score"))


def hybrid(text: DataFrame, vector: DataFrame, text_weight: float, vector_weight: float) -> DataFrame:
    """(id, score): weighted sum of two candidate lists (X6, J8): a union and one aggregation, not an outer join."""
    both = text.select("id", (F.col("score") * text_weight).alias("score")).unionByName(vector.select("id", (F.col("score") * vector_weight).alias("score")))
    return both.groupBy("id").agg(F.sum("score").alias("score"))


def six_factor(text: Column, semantic: Column, centrality: Column, recency: Column, degree: Column, community: Column) -> Column:
    """0.30 text + 0.25 semantic + 0.15 centrality + 0.10 each of recency, degree and community (X11)."""
    return 0.30 * text + 0.25 * semantic + 0.15 * centrality + 0.10 * recency + 0.10 * degree + 0.10 * community


def graph_rerank(hits: DataFrame, edges: DataFrame, boost: float) -> DataFrame:
    """(id, score) of hits, higher by the share of their neighbours that are hits."""
    steps = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    own = steps.join(hits.select("id"), "id", "left_semi").join(hits.select(F.col("id").alias("other"), F.lit(1).alias("hit")), "other", "left")
    share = own.groupBy("id").agg((F.count("hit") / F.count("*")).alias("share"))
    return hits.join(share, "id", "left").select("id", (F.col("score") + boost * F.coalesce("share", F.lit(0.0))).alias("score"))
