"""Worked examples: temporal, graph, similarity and stateful operators on small inputs."""

from pyspark.sql import functions as F

from kronograph.functions import text as T
from kronograph.functions import vectors
from kronograph.operators import events, extract, graph, reconcile, temporal
from kronograph.operators.components import connected_components
from kronograph.sources.model import ts

EDGE = "id string, source_id string, target_id string, relationship string, valid_from string, valid_to string"


def versions(spark):
    rows = [("e1", "a", "b", "r", "2024-01-01", None), ("e2", "a", "b", "r", "2024-02-01", "2024-03-01"), ("e3", "a", "b", "r", "2024-04-01", None)]
    df = spark.createDataFrame(rows, EDGE)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")}).withColumn("created_at", F.col("valid_from")).withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_conflicts_and_resolution(spark):
    v = versions(spark)
    assert ids(temporal.conflicts(v), "edge1", "edge2") == [("e1", "e2"), ("e1", "e3")]
    assert temporal.conflicts(temporal.resolve(v).withColumn("valid_to", F.expr("valid_to - interval 1 second"))).count() == 0
    assert ids(temporal.overlapping(v, ts("2024-03-01"), ts("2024-03-31")), "id") == [("e1",), ("e2",)]
    assert ids(temporal.expired(v, ts("2024-03-01")), "id") == []
    assert ids(temporal.expired(v, ts("2024-03-02")), "id") == [("e2",)]


def line(spark, names="abcde"):
    return spark.createDataFrame([(f"{x}{y}", x, y, "r", 1.0) for x, y in zip(names, names[1:])], "id string, source_id string, target_id string, relationship string, weight double")


def test_paths(spark):
    steps = graph.adjacency(line(spark))
    seed = spark.createDataFrame([("a",)], "id string")
    assert ids(graph.bfs(steps, seed, 3), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert ids(graph.depth_first_set(steps, seed, 3), "id") == [("a",), ("b",), ("c",)]
    assert ids(graph.shortest_path(steps, "a", "d", 3), "position", "id") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert graph.shortest_path(steps, "a", "d", 2).count() == 0


def triangles(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    return spark.createDataFrame([(x + y, x, y, 1.0) for x, y in e], "id string, source_id string, target_id string, weight double")


def test_communities(spark):
    e = triangles(spark)
    labels = spark.createDataFrame([(x, "1" if x in "abc" else "2") for x in "abcdef"], "id string, label string")
    assert abs(graph.modularity(e, labels).first()["q"] - 2 * (3 / 7 - 1 / 4)) < 1e-9
    assert ids(graph.community_stats(e, labels), "internal", "external", "density") == [(3, 1, 1.0), (3, 1, 1.0)]
    found = graph.louvain(e)
    assert graph.modularity(e, found).first()["q"] >= 0.35


def test_components_of_a_long_path(spark):
    n = 40
    e = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (5, 5)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_vectors(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    got = r.select(vectors.cosine("a", "a"), vectors.cosine("a", "b"), vectors.euclidean(F.col("c"), F.col("z")), vectors.cosine("a", "z"), vectors.hashing_embedding(4)(F.lit("ab"))).first()
    assert tuple(got)[:4] == (1.0, 0.0, 5.0, 0.0)
    assert [round(x, 6) for x in got[4]] == [0.703471, 0.710724, 0.0, 0.0]


def test_text(spark):
    r = spark.createDataFrame([("Jon Smith", "John Smith")], "a string, b string")
    assert r.select(T.similarity(F.col("a"), F.col("b"))).first()[0] == 0.9
    pairs = spark.createDataFrame([("Alice met Bob at the coffee shop.",)], "t string").select(extract.relation_of(F.col("t")), extract.mention_pairs(extract.capitalised(F.col("t")))).first()
    assert pairs[0] == "MEETS" and [tuple(p) for p in pairs[1]] == [("Alice", "Bob")]


def test_merge_relations(spark):
    rows = [(0, "Alice", "Bob", "KNOWS", 0.5, "a"), (1, " alice ", "BOB", "knows", 0.8, "b")]
    got = extract.merge_relations(spark.createDataFrame(rows, "ord int, source string, target string, relation string, confidence double, description string")).first()
    assert (got["source"], got["target"], got["relation"], got["confidence"], got["description"]) == ("Alice", "Bob", "KNOWS", 0.8, "a; b")


def test_sessions_and_clock(spark):
    e = spark.createDataFrame([(1, k, f"2024-01-01 00:{m:02d}:00", 1.0) for k, m in enumerate((0, 10, 25))], "user_id long, event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert ids(events.sessions(e, "user_id", "10 minutes"), "actions") == [(1,), (2,)]
    assert ids(events.cooldown(e.withColumn("event_type", F.lit("x")), "user_id", 900.0), "event_id") == [(0,), (2,)]
    v = spark.createDataFrame([(1, 0, {"a": 1, "b": 1}), (1, 1, {"a": 2, "b": 1}), (2, 0, {"a": 1, "b": 3}), (2, 1, {"a": 2, "b": 0})], "id long, o long, clock map<string,long>")
    assert ids(reconcile.clock_winner(v, "id", "o"), "id", "o") == [(1, 1), (2, 0)]
