"""Queries of extraction, entity resolution, code intelligence and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kronograph.functions import text as T
from kronograph.operators import code, extract
from kronograph.plans.registry import query
from kronograph.sources.model import entities, table

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
STOP = ",".join(f"'{w}'" for w in extract.STOP)
CAPS = f"""list_sort(list_distinct(list_filter(list_transform({WORDS}, lambda w: regexp_replace(w, '[.,!?;:"'']+$', '')), lambda w: regexp_matches(w, '^[A-Z]') AND strlen(w) > 2 AND w NOT IN ({STOP}))))"""


def messages(spark, d):
    return table(spark, d, "conversations")


def named(spark, d):
    """Messages with their names, in a column of its own: the pairs' lambdas would extract them again for each name."""
    return messages(spark, d).select("conv_id", "turn", "text", F.explode(F.array(extract.capitalised(F.col("text")))).alias("names"))


@query("extract_entities", f"SELECT conv_id, turn, unnest({CAPS}) AS entity, 0.6::DOUBLE AS confidence FROM conversations")
def _(spark, d):
    return messages(spark, d).select("conv_id", "turn", F.explode(extract.capitalised(F.col("text"))).alias("entity"), F.lit(0.6).alias("confidence"))


RELATION = "CASE WHEN contains(lower(text), 'met') THEN 'MEETS' WHEN contains(lower(text), 'work') THEN 'WORKS_WITH' WHEN contains(lower(text), 'friend') OR contains(lower(text), 'know') THEN 'KNOWS' WHEN contains(lower(text), 'manage') OR contains(lower(text), 'lead') THEN 'MANAGES' ELSE 'RELATED_TO' END"
PAIRS = f"WITH e AS (SELECT conv_id, turn, text, {CAPS} AS names FROM conversations), p AS (SELECT conv_id, turn, text, i, j, names[i] AS source, names[j] AS target FROM e, range(1, len(names) + 1) a(i), range(i + 1, len(names) + 1) b(j))"


@query("extract_relations", PAIRS + f" SELECT conv_id, turn, source, target, {RELATION} AS relation, 0.5::DOUBLE AS confidence FROM p")
def _(spark, d):
    pairs = named(spark, d).select("conv_id", "turn", extract.relation_of(F.col("text")).alias("relation"), F.explode(extract.mention_pairs(F.col("names"))).alias("p"))
    return pairs.select("conv_id", "turn", F.col("p.a").alias("source"), F.col("p.b").alias("target"), "relation", F.lit(0.5).alias("confidence"))


@query("mention_pairs", PAIRS + " SELECT source, target, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    pairs = named(spark, d).select(F.explode(extract.mention_pairs(F.col("names"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("source"), F.col("p.b").alias("target")).agg(F.count("*").alias("n")).filter("n > 1")


@query("episode_summary", f"SELECT conv_id, turn, array_to_string({CAPS}[1:3], ', ') AS summary FROM conversations")
def _(spark, d):
    return messages(spark, d).select("conv_id", "turn", F.array_join(F.slice(extract.capitalised(F.col("text")), 1, 3), ", ").alias("summary"))


# DuckDB ends words by ASCII alone: letters and digits beyond it become _, other characters a dot; no rule matches either
_NER = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{N}\p{Pc}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"


@query("ner_rules", " UNION ALL ".join(f"SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all({_NER}, '{rule}', 1)) AS text, '{label}' AS label, 0.8::DOUBLE AS score FROM documents" for label, rule in extract.NER.items()))
def _(spark, d):
    return extract.ner(table(spark, d, "documents"), "doc_id", "text")


@query("message_relations", "SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.-]+\\.[a-z]+')) AS target FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+"), 0)).alias("target"))


@query("conversation_patterns", "SELECT conv_id, count(*) AS n, max(length(text))::BIGINT AS longest, count(*) FILTER (role = 'user') / CAST(count(*) AS DOUBLE) > 0.5 AS dominated, count(*) > 20 AS long FROM conversations GROUP BY conv_id")
def _(spark, d):
    return messages(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("bigint").alias("longest"), (F.count_if(F.col("role") == "user") / F.count("*") > 0.5).alias("dominated"), (F.count("*") > 20).alias("long"))


@query("proximity_relations", "WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS s FROM conversations) SELECT conv_id, turn, count(*) AS n FROM s WHERE contains(lower(s), 'the') AND contains(lower(s), 'that') GROUP BY ALL")
def _(spark, d):
    s = messages(spark, d).select("conv_id", "turn", F.explode(F.split("text", r"\.")).alias("s")).select("conv_id", "turn", F.lower("s").alias("s"))
    return s.filter(F.col("s").contains("the") & F.col("s").contains("that")).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


SIM = "CASE WHEN lower(a.name) = lower(b.name) THEN 1.0 ELSE 1 - levenshtein(lower(a.name), lower(b.name)) / CAST(greatest(strlen(a.name), strlen(b.name)) AS DOUBLE) END"
NAMES = "n AS (SELECT lower(p_name) AS name, min('P:'||p_partkey) AS id FROM part GROUP BY 1)"


@query("dedup_entities_pairs", f"WITH {NAMES} SELECT a.id AS a, b.id AS b, round({SIM}, 6) AS similarity FROM n a JOIN n b ON a.id < b.id WHERE {SIM} >= 0.5")
def _(spark, d):
    return extract.similar_pairs(entities(spark, d).filter("entity_type = 'Part'"), "id", "name", 0.5).withColumn("similarity", F.round("similarity", 6))


# names in the order of their ids; each looks for the first leader that is similar
_ALIKE = "CASE WHEN x.name = n.name THEN 1.0 ELSE 1 - levenshtein(x.name, n.name) / CAST(greatest(strlen(x.name), strlen(n.name)) AS DOUBLE) END >= 0.75"


@query(
    "dedup_entities_greedy",
    f"""WITH RECURSIVE m AS (SELECT lower(p_name) AS name, min('P:'||p_partkey) AS id FROM part GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM m),
 r AS (SELECT 0::BIGINT AS k, CAST([] AS STRUCT(id VARCHAR, name VARCHAR)[]) AS lead, '' AS id, '' AS leader
 UNION ALL SELECT k, CASE WHEN len(hit) = 0 THEN list_append(lead, {{'id': id, 'name': name}}) ELSE lead END, id, CASE WHEN len(hit) = 0 THEN id ELSE hit[1].id END FROM (SELECT n.k, n.id, n.name, r.lead, list_filter(r.lead, lambda x: {_ALIKE}) AS hit FROM r JOIN n ON n.k = r.k + 1))
 SELECT id, leader FROM r WHERE k > 0""",
)
def _(spark, d):
    return extract.leaders(entities(spark, d).filter("entity_type = 'Part'"), "id", "name", 0.75)


@query("similar_entity", f"WITH {NAMES}, b AS (SELECT 'red anvi' AS name) SELECT a.id, round({SIM}, 6) AS similarity FROM n a, b ORDER BY similarity DESC, id LIMIT 5")
def _(spark, d):
    n = entities(spark, d).filter("entity_type = 'Part'").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    return n.select("id", F.round(T.similarity(F.col("name"), F.lit("red anvi")), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(5)


@query("dedup_edges_exact", "SELECT arg_min(c_name, c_custkey) AS source, arg_min(c_mktsegment, c_custkey) AS target, 'IN' AS relation, max(c_acctbal) AS confidence, arg_min(c_mktsegment, c_custkey) AS description FROM customer GROUP BY c_custkey % 100, c_mktsegment")
def _(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("ord"), "c_name", F.concat(F.lit(" k"), F.col("c_custkey") % 100).alias("source"), F.lower("c_mktsegment").alias("target"), F.lit("IN").alias("relation"), F.col("c_acctbal").alias("confidence"), F.col("c_mktsegment").alias("description"))
    merged = extract.merge_relations(rows.select("ord", "source", F.upper("target").alias("target"), "relation", "confidence", "description"))
    first = rows.groupBy("source", F.upper("target").alias("t")).agg(F.min_by("c_name", "ord").alias("name"))
    return merged.join(first, (F.upper(merged["target"]) == F.col("t")) & (merged["source"] == first["source"])).select(F.col("name").alias("source"), merged["target"], "relation", "confidence", "description")


@query("dedup_edges_semantic", "SELECT least('N:'||n_nationkey, 'R:'||n_regionkey) AS a, greatest('N:'||n_nationkey, 'R:'||n_regionkey) AS b, 'location' AS grp, 2 AS n FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("s"), F.concat(F.lit("R:"), "n_regionkey").alias("t"))
    both = n.withColumn("relation", F.lit("located_in")).unionByName(n.select(F.col("t").alias("s"), F.col("s").alias("t"), F.lit("based_in").alias("relation")))
    return both.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), extract.relation_group(F.col("relation")).alias("grp")).agg(F.count("*").cast("int").alias("n"))


@query("relation_synonyms", "SELECT * FROM (VALUES ('works_at', 'employment'), ('has', 'ownership'), ('paints', 'paints')) t(relation, grp)")
def _(spark, d):
    r = spark.createDataFrame([("works_at",), ("has",), ("paints",)], "relation string")
    return r.select("relation", extract.relation_group(F.col("relation")).alias("grp"))


@query("resolve_edge_endpoints", "SELECT 'N:'||n_nationkey AS source_id, 'R:'||n_regionkey AS target_id FROM nation")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("source"), F.concat(F.lit(" "), F.lower("r_name")).alias("target"))
    return extract.resolve_endpoints(named, entities(spark, d).filter(F.col("entity_type").isin("Nation", "Region"))).select("source_id", "target_id")


@query("entity_conflict_groups", "SELECT lower(p_name) AS key, arg_min('P:'||p_partkey, (-p_retailprice, p_partkey)) AS kept, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.lower("p_name").alias("key")).agg(F.min_by(F.concat(F.lit("P:"), "p_partkey"), F.struct(-F.col("p_retailprice"), "p_partkey")).alias("kept"), F.count("*").alias("n")).filter("n > 1")


@query("merge_confidence", "SELECT lower(p_name) AS name, round(least(avg(CASE WHEN p_size > 25 THEN p_size / 50.0::DOUBLE ELSE 0.5 END), 1), 6) AS confidence FROM part GROUP BY 1")
def _(spark, d):
    c = F.when(F.col("p_size") > 25, F.col("p_size") / 50.0)
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.round(F.least(F.avg(F.coalesce(c, F.lit(0.5))), F.lit(1.0)), 6).alias("confidence"))


@query("dedup_actions", "SELECT CASE WHEN r = 1 THEN 'Keep' ELSE 'Merge' END AS action, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part) GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "part").groupBy(F.lower("p_name")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("m")).select(F.explode(F.array(F.struct(F.lit("Keep").alias("action"), F.col("k").alias("n")), F.struct(F.lit("Merge").alias("action"), F.col("m").alias("n")))).alias("r")).select("r.*")


@query("jaccard_words", "WITH q AS (SELECT list_distinct(['the','that','and','que']) AS q) SELECT doc_id, round(len(list_intersect(w, q)) / CAST(len(list_distinct(list_concat(w, q))) AS DOUBLE), 6) AS score FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents), q")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.jaccard(F.col("text"), F.lit("the that and que")), 6).alias("score"))


@query("content_hash_dups", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("sorted_dedup", "SELECT DISTINCT source, lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("quality_filter", "SELECT doc_id FROM documents WHERE strlen(text) > 500 AND NOT contains(lower(text), 'test')")
def _(spark, d):
    return table(spark, d, "documents").filter((F.octet_length("text") > 500) & ~F.lower("text").contains("test")).select("doc_id")


@query("entity_type_filter", "SELECT entity_type, count(*) AS n FROM entities WHERE entity_type IN ('Customer','Supplier') GROUP BY entity_type", "entities")
def _(spark, d):
    return entities(spark, d).filter(F.col("entity_type").isin("Customer", "Supplier")).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("score_filter", "SELECT doc_id FROM documents WHERE n_chars / 1000.0 >= 2.5")
def _(spark, d):
    return table(spark, d, "documents").filter(F.col("n_chars") / 1000.0 >= 2.5).select("doc_id")


@query("memory_types", "SELECT turn, CASE WHEN regexp_matches(lower(text), 'bug|fix|error') THEN 'bug_fix' WHEN regexp_matches(lower(text), 'decid|decision|choose') THEN 'decision' WHEN regexp_matches(lower(text), 'learn|discover') THEN 'learning' WHEN regexp_matches(lower(text), 'plan|todo|task') THEN 'planning' ELSE 'general' END AS kind, count(*) AS n FROM conversations GROUP BY ALL")
def _(spark, d):
    return messages(spark, d).groupBy("turn", T.memory_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("workflow_stages", "SELECT doc_id, CASE WHEN contains(t, 'test') THEN 'Testing' WHEN contains(t, 'review') THEN 'CodeReview' WHEN contains(t, 'deploy') THEN 'Deployment' WHEN contains(t, 'bug') OR contains(t, 'fix') THEN 'BugFix' WHEN contains(t, 'refactor') THEN 'Refactoring' WHEN contains(t, 'implement') THEN 'Implementation' ELSE 'Planning' END AS stage FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.workflow_stage(F.col("text")).alias("stage"))


def _chunks(name, size, stride, blank):
    where = "WHERE trim(content) <> ''" if blank else ""

    @query(name, f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id AS path, CAST(s + 1 AS BIGINT) AS start_line, CAST(least(s + {size}, len(l)) AS BIGINT) AS end_line, array_to_string(l[s + 1 : s + {size}], chr(10)) AS content FROM l, range(0, len(l) + 1, {stride}) t(s) WHERE s = 0 OR s < len(l) - {size - stride}) SELECT path, start_line, end_line, md5(content) AS hash FROM c {where}")
    def _(spark, d):
        return code.chunks(table(spark, d, "documents"), "doc_id", "text", size, stride, blank).select("path", "start_line", "end_line", F.md5("content").alias("hash"))


_chunks("chunk_200_30", 200, 170, False)
_chunks("chunk_120_100", 120, 100, True)
_chunks("chunk_4_3", 4, 3, True)


@query("language_histogram", "SELECT CASE WHEN regexp_matches(split_part(split_part(url, '?', 1), '#', 1), '\\.html$') THEN 'html' ELSE 'other' END AS language, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").groupBy(code.language(path).alias("language")).agg(F.count("*").alias("n"))


@query("line_grep", "SELECT path, line, preview FROM (SELECT doc_id AS path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS l, l[1:200] AS preview FROM documents) WHERE contains(l, 'token')")
def _(spark, d):
    return code.grep(table(spark, d, "documents"), "token", "doc_id", "text")


@query("file_line_stats", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, strlen(text) AS bytes FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(code.lines(F.col("text"))).cast("bigint").alias("lines"), F.octet_length("text").cast("bigint").alias("bytes"))


FILES = [("a.py", "class Cat:\n    def purr(self):\n        if self.full:\n            return 1\n\ndef main():\n    for k in range(3):\n        Cat().purr()"), ("b.rs", "pub struct Dog { age: u8 }\nfn bark() {\n    match 1 { _ => () }\n}\npub async fn run() { bark() }")]


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


@query("symbols", "SELECT * FROM (VALUES ('a.py', 1::BIGINT, 'class', 'Cat'), ('a.py', 2, 'function', 'purr'), ('a.py', 6, 'function', 'main'), ('b.rs', 1, 'struct', 'Dog'), ('b.rs', 2, 'function', 'bark'), ('b.rs', 5, 'function', 'run')) t(path, line, kind, name)")
def _(spark, d):
    return code.symbols(files(spark))


@query("symbol_find", "SELECT 'b.rs' AS path, 2::BIGINT AS line, 'function' AS kind, 'bark' AS name")
def _(spark, d):
    return code.symbols(files(spark)).filter("name = 'bark'")


@query("references", "SELECT * FROM (VALUES ('b.rs', 2::BIGINT), ('b.rs', 5)) t(path, line)")
def _(spark, d):
    return code.references(files(spark), "bark")


@query("enclosing_symbol", "SELECT * FROM (VALUES ('a.py', 3::BIGINT, 'purr'), ('a.py', 7, 'main')) t(path, line, name)")
def _(spark, d):
    ranges = spark.createDataFrame([("a.py", "Cat", 1, 5), ("a.py", "purr", 2, 5), ("a.py", "main", 6, 8)], "path string, name string, start bigint, end bigint")
    at = spark.createDataFrame([("a.py", 3), ("a.py", 7)], "path string, line bigint")
    return code.enclosing(at, ranges)


@query("complexity", "SELECT * FROM (VALUES ('a.py', 3::BIGINT), ('b.rs', 2)) t(path, complexity)")
def _(spark, d):
    return files(spark).select("path", T.complexity(F.col("content")).alias("complexity"))


@query("project_detect", "SELECT * FROM (VALUES ('p', 'TypeScript'), ('q', 'Rust'), ('r', 'Mixed')) t(project, kind)")
def _(spark, d):
    f = spark.createDataFrame([("p", "p/package.json"), ("p", "p/tsconfig.json"), ("q", "q/Cargo.toml"), ("q", "q/setup.py"), ("r", "r/x.txt")], "project string, path string")
    return code.project_kind(f, "project", "path")


@query("path_globs", "SELECT * FROM (VALUES ('src/a.py'), ('src/deep/b.py')) t(path)")
def _(spark, d):
    f = spark.createDataFrame([("src/a.py",), ("src/deep/b.py",), ("src/test/c.py",), ("doc/a.md",)], "path string")
    return f.filter(T.monitored(F.col("path"), ["src/**/*.py"], ["**/test/**"]))


@query("symbol_tree_flatten", "SELECT * FROM (VALUES ('A', 0), ('b', 1), ('c', 1), ('d', 2)) t(name, depth)")
def _(spark, d):
    spark.createDataFrame([("A", None), ("b", "A"), ("c", "A"), ("d", "c")], "name string, parent string").createOrReplaceTempView("symbol_tree")
    return spark.sql("WITH RECURSIVE t(name, depth) AS (SELECT name, 0 FROM symbol_tree WHERE parent IS NULL UNION ALL SELECT s.name, t.depth + 1 FROM symbol_tree s JOIN t ON s.parent = t.name) SELECT name, depth FROM t")


@query("model_json_parse", "SELECT * FROM (VALUES ('Alice', 0.9::DOUBLE), ('Bob', NULL)) t(name, confidence)")
def _(spark, d):
    r = spark.createDataFrame([('Sure: {"extracted_entities":[{"name":"Alice","confidence":0.9},{"name":"Bob"}]} done',)], "reply string")
    parsed = F.from_json(extract.json_of(F.col("reply")), "extracted_entities array<struct<name string, confidence double>>")
    return r.select(F.explode(parsed["extracted_entities"]).alias("e")).select("e.*")


@query("fact_validation", "SELECT 'WORKS_AT' AS relation, true AS valid UNION ALL SELECT 'worksAt', false UNION ALL SELECT 'KNOWS', false")
def _(spark, d):
    f = spark.createDataFrame([("a", "b", "WORKS_AT"), ("a", "b", "worksAt"), ("a", "a", "KNOWS")], "source string, target string, relation string")
    return f.select("relation", (F.col("relation").rlike("^[A-Z]+(_[A-Z]+)*$") & (F.col("source") != F.col("target"))).alias("valid"))


@query("code_entity_lines", "SELECT * FROM (VALUES ('Function', 'main', 'entry point'), ('Class', 'Cat', 'an animal')) t(kind, name, description)")
def _(spark, d):
    r = spark.createDataFrame([("Function: main - entry point\nnoise\nClass: Cat - an animal",)], "reply string")
    line = r.select(F.explode(F.split("reply", "\n")).alias("l"))
    rule = r"^(\w+): (\S+) - (.+)$"
    return line.select(*(F.regexp_extract("l", rule, k).alias(n) for k, n in ((1, "kind"), (2, "name"), (3, "description")))).filter("name <> ''")


@query(
    "symbol_edges",
    "SELECT * FROM (VALUES ('a.py', 'a.py#Cat', 'CONTAINS'), ('a.py', 'a.py#purr', 'CONTAINS'), ('a.py', 'a.py#main', 'CONTAINS'), ('b.rs', 'b.rs#Dog', 'CONTAINS'), ('b.rs', 'b.rs#bark', 'CONTAINS'), ('b.rs', 'b.rs#run', 'CONTAINS'), ('b.rs#run', 'b.rs#bark', 'REFERENCES'), ('a.py#main', 'a.py#Cat', 'REFERENCES'), ('a.py#main', 'a.py#purr', 'REFERENCES')) t(source_id, target_id, relationship)",
)
def _(spark, d):
    return code.symbol_edges(files(spark))


@query("breakthroughs", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), 'eureka|finally|breakthrough|ered')")
def _(spark, d):
    return messages(spark, d).filter(T.any_of(F.lower("text"), ["eureka", "finally", "breakthrough", "ered"])).select("conv_id", "turn")


@query("prototype_classify", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e WHERE label IS NOT NULL) GROUP BY ALL), p AS (SELECT label, list(x ORDER BY k) AS v FROM c GROUP BY label), s AS (SELECT e.vec_id, p.label, round(list_cosine_similarity(e.v, p.v), 6) AS s FROM e, p) SELECT vec_id, arg_min(label, (-s, label)) AS label FROM s GROUP BY vec_id")
def _(spark, d):
    from kronograph.functions.vectors import cosine

    e = table(spark, d, "embeddings")
    parts = e.filter("label is not null").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    p = F.broadcast(parts.groupBy(F.col("label").alias("to")).agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("v")))  # one centroid a label
    s = e.crossJoin(p).groupBy("vec_id", "to").agg(F.round(F.max(cosine(F.col("embedding"), F.col("v"))), 6).alias("s"))
    return s.groupBy("vec_id").agg(F.min_by("to", F.struct(-F.col("s"), "to")).alias("label"))
