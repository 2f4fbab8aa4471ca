"""Queries of code knowledge, over source files that are made of the parts table: one file for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from kronograph.functions import code as C
from kronograph.operators import code, parser, search
from kronograph.plans.registry import query
from kronograph.sources import files as sources
from kronograph.sources.model import table

BODY = ["class Cat", ":\n    def purr(self, times):\n        if times:\n            return ", "\n        return 0\n\ndef main():\n    for k in range(", "):\n        Cat().purr(k)\n"]
_PARTS = ["p_partkey", "p_size", "p_size"]
FILES = "files AS (SELECT p_partkey, p_size, p_type, p_name, 'src/m'||p_partkey||'.py' AS path, " + "||".join(x for text, c in zip(BODY, [*_PARTS, None]) for x in ("'" + text.replace("\n", "'||chr(10)||'") + "'", c) if x) + " AS content FROM part)"


def files(spark, d):
    pieces = [x for text, c in zip(BODY, [*_PARTS, None]) for x in ((F.lit(text), F.col(c).cast("string")) if c else (F.lit(text),))]
    return table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_name", F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), F.concat(*pieces).alias("content"))


@query(
    "code_definitions",
    f"""WITH {FILES} SELECT path, 'class' AS kind, 'Cat'||p_partkey AS name, NULL AS parent, 1::BIGINT AS start, 5::BIGINT AS "end", 'class Cat'||p_partkey||':' AS signature, 5::BIGINT AS complexity FROM files
 UNION ALL SELECT path, 'method', 'purr', 'Cat'||p_partkey, 2, 5, 'def purr(self, times):', 2 FROM files UNION ALL SELECT path, 'function', 'main', NULL, 7, 9, 'def main():', 3 FROM files""",
)
def _(spark, d):
    return parser.parsed(files(spark, d)).select("path", "kind", "name", "parent", "start", "end", "signature", "complexity")


@query("line_rule_entities", f"WITH {FILES} SELECT path, 1::BIGINT AS line, 'class' AS kind, 'Cat'||p_partkey AS name FROM files UNION ALL SELECT path, 2, 'function', 'purr' FROM files UNION ALL SELECT path, 7, 'function', 'main' FROM files")
def _(spark, d):
    return code.symbols(files(spark, d))


@query("search_code", f"WITH {FILES} SELECT path, 'Cat'||p_partkey AS name FROM files WHERE contains('cat'||p_partkey, 'cat1')")
def _(spark, d):
    return code.symbols(files(spark, d)).filter(F.lower("name").contains("cat1")).select("path", "name")


@query("symbol_body_replaced", f"WITH {FILES} SELECT path, md5(split_part(content, 'def main', 1)||'def main():'||chr(10)||'    pass'||chr(10)) AS hash, true AS replaced FROM files")
def _(spark, d):
    return parser.replace_body(files(spark, d), "main", "def main():\n    pass").select("path", F.md5("content").alias("hash"), "replaced")


@query("dry_run_counts", "SELECT count(*) AS files, 3 * count(*) AS symbols FROM part")
def _(spark, d):
    return parser.dry_run(files(spark, d))


@query("incremental_files", f"WITH {FILES} SELECT path FROM files WHERE p_size > 25 OR p_type = 'ECONOMY'")
def _(spark, d):
    day = F.lit("2024-01-01").cast("date")
    now = files(spark, d).withColumn("modified", F.date_add(day, "p_size"))
    scanned = now.filter("p_type <> 'ECONOMY'").select("path", F.date_add(day, 25).alias("modified"))
    return sources.changed_since(now, scanned).select("path")


@query("code_chunks", f"WITH {FILES} SELECT path, 1::BIGINT AS start_line, 10::BIGINT AS end_line, md5(content) AS hash FROM files")
def _(spark, d):
    return code.chunks(files(spark, d), "path", "content", 200, 170).select("path", "start_line", "end_line", F.md5("content").alias("hash"))


_SPOKEN = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in C.INDICATORS)
_SIGNS = " OR ".join(f"contains(lower(text), '{w}')" for w in C.SYNTAX["python"])
RELEVANCE = f"least(2.0::DOUBLE, (CASE WHEN contains(lower(text), 'python') THEN 1.5::DOUBLE ELSE 1 END) * (CASE WHEN {_SIGNS} THEN 1.3::DOUBLE ELSE 1 END) * (CASE WHEN contains(lower(text), 'spark') THEN 1.4::DOUBLE ELSE 1 END) * (1 + ({_SPOKEN}) * 0.1::DOUBLE))"


@query("code_relevance", f"SELECT doc_id, round({RELEVANCE}, 6) AS relevance FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(C.relevance(F.col("text"), "python", "spark"), 6).alias("relevance"))


@query("code_knowledge_search", f"SELECT doc_id AS id, round({RELEVANCE} * 3 / greatest(CAST(strlen(text) AS DOUBLE), 1), 9) AS score FROM documents WHERE contains(lower(text), 'the') ORDER BY score DESC, id LIMIT 20")
def _(spark, d):
    """Hits of the service search times their relevance to code."""
    hits = table(spark, d, "documents").withColumn("score", search.service_score("the", F.col("text"), F.lit(""))).filter("score is not null")
    scored = hits.select(F.col("doc_id").alias("id"), F.round(F.col("score") * C.relevance(F.col("text"), "python", "spark"), 9).alias("score"))
    return search.top(scored, 20, F.desc("score"), "id")


_KIND = "CASE p_size % 4 WHEN 0 THEN 'Class' WHEN 1 THEN 'Api' WHEN 2 THEN 'Module' ELSE 'DataModel' END"


@query(
    "code_priors",
    f"""SELECT p_partkey, least(10, 5 + CASE kind WHEN 'Class' THEN 2 WHEN 'Module' THEN 1 WHEN 'Api' THEN 1 ELSE 0 END + CASE WHEN 3 * p_size > 100 THEN 2 WHEN 3 * p_size > 50 THEN 1 ELSE 0 END) AS complexity,
 least(10, 5 + CASE WHEN kind = 'Api' THEN 3 WHEN kind = 'Class' AND contains(p_brand||'Service', 'Service') THEN 2 WHEN kind = 'Module' THEN 1 ELSE 0 END + CASE WHEN p_size > 3 THEN 1 ELSE 0 END) AS importance FROM (SELECT *, {_KIND} AS kind FROM part)""",
)
def _(spark, d):
    p = table(spark, d, "part").withColumn("kind", F.expr(_KIND))
    return p.select("p_partkey", C.complexity_prior(F.col("kind"), 3 * F.col("p_size")).alias("complexity"), C.importance_prior(F.col("kind"), F.concat("p_brand", F.lit("Service")), F.col("p_size")).alias("importance"))


@query(
    "bug_fix_edits",
    """WITH e AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS a, lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS b FROM conversations)
 SELECT conv_id, turn, contains(a, 'bug') OR contains(b, 'fix') OR (contains(a, 'error') AND NOT contains(b, 'error')) OR (contains(b, 'handle') AND NOT contains(a, 'handle')) AS by_edit,
 (contains(a, 'null') AND NOT contains(b, 'null')) OR (contains(a, 'undefined') AND NOT contains(b, 'undefined')) OR contains(b, 'fix') OR (contains(b, 'handle') AND NOT contains(a, 'handle')) OR (contains(b, 'check') AND NOT contains(a, 'check')) AS by_code FROM e""",
)
def _(spark, d):
    from pyspark.sql import Window

    empty = F.lit("")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    e = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", empty).alias("a"), F.coalesce(after, empty).alias("b"))
    return e.select("conv_id", "turn", C.edit_fixes_bug(F.col("a"), F.col("b")).alias("by_edit"), C.code_fixes_bug(F.col("a"), F.col("b")).alias("by_code"))


@query(
    "code_patterns",
    "WITH c AS (SELECT p_partkey, p_size % 3 AS k FROM part) SELECT p_partkey, 'Observer Pattern' AS pattern, 0.8::DOUBLE AS confidence FROM c WHERE k = 0 UNION ALL SELECT p_partkey, 'Python Class Pattern', 0.7 FROM c WHERE k = 1 UNION ALL SELECT p_partkey, 'Factory Pattern', 0.7 FROM c WHERE k = 1",
)
def _(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, "Observer: notify() api endpoint").when(F.col("p_size") % 3 == 1, "def __init__(self): Factory().create()").otherwise("controller service")
    p = table(spark, d, "part").select("p_partkey", F.explode(C.patterns(text, F.lit("Python"))).alias("x"))
    return p.select("p_partkey", "x.*")


@query(
    "architecture_patterns",
    f"""WITH k AS (SELECT p_size // 3 AS unit, {_KIND} AS kind FROM part), u AS (SELECT unit, bool_or(kind = 'Api') AND bool_or(kind = 'DataModel') AS api, count(*) FILTER (kind = 'Class') >= 3 AS classes FROM k GROUP BY unit)
 SELECT unit, 'API-Data Pattern' AS pattern FROM u WHERE api UNION ALL SELECT unit, 'Multi-Class Design' FROM u WHERE classes""",
)
def _(spark, d):
    k = table(spark, d, "part").select(F.expr("p_size div 3").alias("unit"), F.expr(_KIND).alias("kind"))
    return k.groupBy("unit").agg(C.architecture(F.col("kind")).alias("p")).select("unit", F.explode("p").alias("pattern"))


@query("code_entity_types", "SELECT CASE WHEN p_type = 'ECONOMY' THEN 'DataModel' WHEN p_size % 2 = 0 THEN 'Class' ELSE 'Function' END AS entity_type, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    word = F.when(F.col("p_type") == "ECONOMY", "Model").when(F.col("p_size") % 2 == 0, "STRUCT").otherwise("anything")
    return table(spark, d, "part").groupBy(C.code_type(word).alias("entity_type")).agg(F.count("*").alias("n"))
