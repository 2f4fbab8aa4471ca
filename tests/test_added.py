"""Stored indexes, parsers, folds, entity merging and as-of joins against brute force and worked examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kronograph import config
from kronograph.functions import code as C
from kronograph.functions import vectors
from kronograph.operators import events as E
from kronograph.operators import extract, graph, parser, providers, reconcile, temporal
from kronograph.operators.index import TextIndex
from kronograph.operators.vector_index import VectorIndex
from kronograph.sources import files
from kronograph.streaming import streams
from tests.test_whole import alike

RUST = '''/// Adds.
pub async fn add<T>(a: i32, b: T) -> Result<i32, Error> {
    if a > 0 { for x in 0..3 {} }
    match b { _ => {} } // }
}

pub struct Dog { age: u8 }
impl Animal for Dog {
    fn bark(&self) {
        println!("}");
    }
}
trait Animal {
    fn bark(&self);
}
'''
PYTHON = '''class Cat(Base):
    """An animal."""

    async def purr(self, n: int = 1) -> str:
        """Purrs.
        Loudly."""
        try:
            return "x"
        except E:
            pass

def main():
    while True:
        if 1:
            break
'''


def test_definitions():
    rust = {(d[2], d[3], d[4], d[5], d[6], tuple(d[8]), d[9], d[10], d[11]) for d in parser.definitions("a.rs", RUST)}
    assert rust == {
        ("function", "add", None, 2, 5, ("a: i32", "b: T"), "Result<i32, Error>", "Adds.", 6), ("struct", "Dog", None, 7, 7, (), None, "", 2),
        ("method", "bark", "Dog", 9, 11, ("&self",), None, "", 1), ("trait", "Animal", None, 13, 15, (), None, "", 4), ("method", "bark", "Animal", 14, 14, ("&self",), None, "", 1),
    }
    python = {(d[2], d[3], d[4], d[5], d[6], tuple(d[8]), d[9], d[10], d[11]) for d in parser.definitions("a.py", PYTHON)}
    assert python == {("class", "Cat", None, 1, 10, (), None, "An animal.", 5), ("method", "purr", "Cat", 4, 10, ("self", "n: int = 1"), "str", "Purrs.", 2), ("function", "main", None, 12, 15, (), None, "", 4)}
    assert [(d[2], d[3]) for d in parser.definitions("a.ts", "export const f = async (a) => {\n}\nclass A {\n}\nfunction g(x: T): U {\n}")] == [("function", "f"), ("class", "A"), ("function", "g")]
    assert [(d[2], d[3]) for d in parser.definitions("a.go", "func (s *S) Run(a int) error {\n}\ntype S struct {\n}")] == [("function", "Run"), ("struct", "S")]
    assert parser.definitions("a.txt", "def f():") == parser.definitions("a.py", None) == []


def test_code_heuristics(spark):
    one = spark.range(1)
    said = lambda c: one.select(c.alias("x")).first()["x"]
    assert said(C.relevance(F.lit("def f: Python on Spark"), "python", "spark")) == 2.0
    assert said(C.relevance(F.lit("a bug fix"), "rust")) == pytest.approx(1.2)
    assert said(C.code_fixes_bug(F.lit("x = null"), F.lit("x = 1"))) and not said(C.code_fixes_bug(F.lit("x"), F.lit("y")))
    assert said(C.edit_fixes_bug(F.lit("an error"), F.lit("ok"))) and not said(C.edit_fixes_bug(F.lit("error"), F.lit("error")))
    assert [p["pattern"] for p in said(C.patterns(F.lit("async await trait impl controller service"), F.lit("Rust")))] == ["Rust Trait Pattern", "Async/Await Pattern"]
    assert said(C.complexity_prior(F.lit("Class"), F.lit(200))) == 9 and said(C.complexity_prior(F.lit("x"), F.lit(None).cast("int"))) == 5


def test_han_names(spark):
    rows = extract.ner(spark.createDataFrame([(1, "张三在北京大学工作，李四住在上海。")], "id long, text string"), "id", "text").collect()
    found = {(r["text"], r["label"]) for r in rows}
    assert {("张三", "Person"), ("上海", "Location")} <= found and any("北京大学" in t and label == "Organization" for t, label in found)
    got = extract.candidates(spark.createDataFrame([(1, 'Dr. Smith met "the cat" at New Hall, 北京')], "id long, text string"), "id", "text")
    assert {"Dr", "Dr. Smith", "the cat", "New Hall", "北京"} <= {r["text"] for r in got.collect()}


def test_spans_of_all_documents(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = []
    for r in docs.collect():
        found = sorted({(m.start(1), m.end(1), m[1], label) for label, rule in extract.RULES for m in re.finditer(rule, r["text"] or "")})
        kept = []
        for s in found:
            if all(min(s[1], k[1]) - max(s[0], k[0]) <= 0.7 * min(s[1] - s[0], k[1] - k[0]) for k in kept):
                kept.append(s)
        want += [(r["doc_id"], t, label, 0.8, a, b) for a, b, t, label in kept]
    assert sorted(map(tuple, extract.spans(docs, "doc_id", "text").collect())) == sorted(want)


@pytest.mark.parametrize("least", [0.75, 0.9])
def test_merged_entities(spark, least):
    rng = random.Random(5)
    rows = [(f"{k:03d}", "".join(rng.choice("ab") for _ in range(rng.randrange(3, 8))), rng.choice("XY"), rng.choice([None, 0.2, 0.9])) for k in range(80)]
    lead = {}
    for i, n, t, _ in rows:
        # entities of one name and type are one, by the first of them
        same = next((j for j, m, u, _ in rows if (m, u) == (n, t)), i)
        lead[i] = lead[same] if same != i else next((j for j, m, u, _ in rows if j < i and lead[j] == j and 0.8 * alike(n, m) + 0.2 * (t == u) > least + 1e-12), i)
    got = {r["id"]: r for r in extract.merged_entities(spark.createDataFrame(rows, "id string, name string, type string, confidence double"), "id", "name", "type", "confidence", least).collect()}
    assert {i: r["leader"] for i, r in got.items()} == lead
    for i, *_ in rows:
        own = [0.5 if c is None else c for j, _, _, c in rows if lead[j] == lead[i]]
        assert got[i]["confidence"] == pytest.approx(min(1, sum(own) / len(own))) and got[i]["entity_type"] == next(t for j, _, t, _ in rows if j == lead[i])


def test_text_index(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    rows = [(1, "red cat", ["a"], "2024-01-01"), (2, "red red dog", ["b"], "2024-02-01"), (3, "cat", None, None)]
    docs = spark.createDataFrame(rows, "id int, body string, labels array<string>, day string")
    assert index.segments() == []
    index.add(docs, "id", {"content": "body"}, "labels", "day")
    assert {r["id"] for r in index.search("red", {"content": 1.0}).collect()} == {1, 2}
    assert {r["id"] for r in index.search("red", {"content": 1.0}, labels=["b"]).collect()} == {2}
    assert {r["id"] for r in index.search("red cat", {"content": 1.0}, until="2024-01-15").collect()} == {1}
    index.add(spark.createDataFrame([(1, "blue bird")], "id int, body string"), "id", {"content": "body"})
    index.delete(spark.createDataFrame([(2,)], "id int"))
    assert index.search("red", {"content": 1.0}).count() == 0
    assert {r["id"] for r in index.search("bird cat", {"content": 1.0}).collect()} == {1, 3}
    assert index.sizes().first()["n"] == 2 and index.segments() == [0, 1, 2] and index.facets().count() == 0
    index.clear()
    assert index.segments() == []


def test_vector_index(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(20, 16)) * 3
    x = centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 16), (3002, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").cache()
    index = VectorIndex(df, "id", "v", 16)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = df.filter("id % 100 = 0")
    want = {(q, i) for q in range(0, 3000, 100) for i in np.lexsort((np.arange(3000), -(unit @ unit[q])))[:10].tolist()}
    exact = {(r["query"], r["id"]) for r in index.search(queries, "id", "v", 10, probes=2).collect()}
    assert exact == want
    near = {(r["query"], r["id"]) for r in index.search(queries, "id", "v", 10, exact=False).collect()}
    assert len(near & want) >= 0.9 * len(want)
    index.drop()


def test_token_projection(spark):
    def number(token, place):
        m = 2**64
        x = ((token << 32) ^ place ^ 0xA5A55A5A12345678) + 0x9E3779B97F4A7C15
        x %= m
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % m
        return 2 * (((x ^ (x >> 31)) & 0xFFFFFFFF) / 0xFFFFFFFF) - 1

    got = [r["v"] for r in spark.createDataFrame([([3, 70000],), ([],)], "ids array<bigint>").select(vectors.token_projection(8)("ids").alias("v")).collect()]
    want = np.array([(number(3, k) + number(70000, k)) / 2 for k in range(8)])
    assert np.allclose(got[0], want / np.linalg.norm(want)) and got[1] == [0.0] * 8


EVENTS = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string, value double"


def made_events(spark, n=400):
    import datetime

    rng = random.Random(9)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(5), k, t0 + datetime.timedelta(seconds=rng.randrange(4000)), rng.choice(["error", "view", "buy"]), rng.random()) for k in range(n)]
    return sorted(rows, key=lambda r: (r[0], r[2], r[1])), spark.createDataFrame(rows, EVENTS)


def test_folds(spark):
    rows, df = made_events(spark)
    sent, want = {}, []
    for u, e, t, *_ in rows:
        recent = [s for s in sent.get(u, []) if (t - s).total_seconds() <= 60]
        if len(recent) < 1:
            want.append((u, e))
            recent.append(t)
        sent[u] = recent
    assert sorted(map(tuple, E.notify_limit(df, "user_id", 1).collect())) == sorted(want)
    last, want = {}, []
    for u, e, t, *_ in rows:
        if u not in last or (t - last[u]).total_seconds() >= 100:
            last[u] = t
            want.append((u, e))
    assert sorted(map(tuple, E.cooldown(df, "user_id", 100).collect())) == sorted(want)
    mean = {}
    for u, _, _, _, v in rows:
        mean[u] = mean[u] * 0.9 + v * (1 - 0.9) if u in mean else v
    assert {r["user_id"]: r["ema"] for r in E.ema(df, "user_id", 0.9, "ts", "event_id").collect()} == pytest.approx(mean)


def test_clock_winner(spark):
    rows = [(1, 1, {"a": 1}), (1, 2, {"a": 1, "b": 1}), (1, 3, {"a": 2}), (2, 1, {}), (2, 2, {"z": 1})]
    got = reconcile.clock_winner(spark.createDataFrame(rows, "id bigint, v bigint, clock map<string,bigint>"), "id", "v").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 2)]


def test_as_of(spark):
    rows, df = made_events(spark)
    left, right = df.filter("event_type = 'error'"), df.filter("event_type <> 'error'").select("user_id", "ts", F.col("event_id").alias("other"))
    got = {r["event_id"]: r["other"] for r in temporal.as_of(left, right, ["user_id"], "ts", ["other"]).collect()}
    want = {}
    for u, e, t, kind, _ in rows:
        before = [(x[2], x[1]) for x in rows if x[0] == u and x[2] <= t and x[3] != "error"]
        if kind == "error" and before:
            want[e] = max(before)[1]
    assert got == want


def test_config(tmp_path):
    (tmp_path / "app.toml").write_text('name = "a"\n[search]\nlimit = 5\nfast = false\n')
    (tmp_path / "other.json").write_text('{"limit": 1}')
    got = config.load("app.json", [tmp_path / "none", tmp_path], {"search": {"limit": 1, "boost": 2.0}, "tags": ["x"]}, "APP", {"APP_SEARCH_FAST": "true", "APP_SEARCH_BOOST": "3", "APP_TAGS": '["y"]'})
    assert got == {"search": {"limit": 5, "boost": 3.0, "fast": True}, "tags": ["y"], "name": "a"}
    assert config.load("other.json", [tmp_path], env={}) == {"limit": 1} and config.load("none", [], {"a": 1}, env={}) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        config.load("none", [tmp_path])


def test_safetensors(spark, tmp_path):
    import json

    x = np.arange(12, dtype="<f4").reshape(4, 3)
    head = json.dumps({"w": {"dtype": "F32", "shape": [4, 3], "data_offsets": [0, 48]}, "b": {"dtype": "BF16", "shape": [1, 2], "data_offsets": [48, 52]}}).encode()
    half = (np.array([1.5, -2.0], "<f4").view(np.uint32) >> 16).astype("<u2")
    (tmp_path / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + x.tobytes() + half.tobytes())
    got = files.safetensors(spark, f"file://{tmp_path}", "w").orderBy("row").collect()
    assert [r["vector"] for r in got] == x.tolist()
    assert files.safetensors(spark, f"file://{tmp_path}", "b").first()["vector"] == [1.5, -2.0]


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id int, text string")

    def bad(texts):
        raise TimeoutError

    got = {r["id"]: (r["answer"], r["provider"]) for r in providers.answered(df, "text", {"bad": bad, "good": lambda t: [x.upper() for x in t]}).collect()}
    assert got == {1: ("A B", "good"), 2: (None, None), 3: ("C", "good")}
    assert {(r["answer"], r["provider"]) for r in providers.answered(df, "text", {"bad": bad}).collect()} == {(None, None)}
    known = spark.createDataFrame([("c", [7.0])], "text string, embedding array<double>")
    vectors_of = {r["id"]: r["embedding"] for r in providers.embedded(df, "text", lambda t: F.array(F.length(t).cast("double")), known).collect()}
    assert vectors_of == {1: [3.0], 2: None, 3: [7.0]}
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("a", "gone")], "id string, needed string")
    assert sorted(map(tuple, providers.task_levels(tasks, needs).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    costs = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 1.0)], "id string, cost double")
    assert {r["id"]: r["runs"] for r in providers.within_budget(costs, ["id"], "cost", 5.0).collect()} == {"a": True, "b": True, "c": False}
    hooked = providers.hooked(df, [lambda d: d.filter("text is not null")], lambda d: d.withColumn("n", F.length("text")), [lambda d: d.filter("n > 1")])
    assert [r["id"] for r in hooked.collect()] == [1]


def test_stream_notifications(spark, sf, tmp_path):
    sent = []
    stream = streams.event_stream(spark, f"{sf}/events*.parquet").filter("event_type = 'error'")
    streams.notify(stream, lambda batch: sent.extend(r["event_id"] for r in batch.collect()), f"file://{tmp_path}/c").awaitTermination()
    assert sorted(sent) == sorted(r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").collect())


def test_random_walk_and_seeded_order(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")]
    edges = spark.createDataFrame([(f"e{k}", s, t, "R") for k, (s, t) in enumerate(pairs)], "id string, source_id string, target_id string, relationship string")
    walk = graph.random_walk(graph.adjacency(edges, "out"), spark.createDataFrame([("a",), ("d",)], "id string"), 5, seed=3).collect()
    by = {(r["start"], r["position"]): r["id"] for r in walk}
    assert by["a", 0] == "a" and by["d", 0] == "d" and ("d", 1) not in by
    for (start, k), node in by.items():
        assert k == 0 or (by[start, k - 1], node) in pairs
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    one, other = ([r["id"] for r in graph.shuffled(nodes.repartition(n), seed).collect()] for n, seed in ((3, 1), (2, 1)))
    assert one == other and sorted(one) == list("abcdefgh") and one != [r["id"] for r in graph.shuffled(nodes, 2).collect()]
