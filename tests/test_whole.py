"""Registered queries over whole tables: no subset of ids, languages or blocks is left out."""

import random
import re

import duckdb
import pytest

from kronograph import plans
from kronograph.operators import extract, search


def ours(spark, sf, name):
    return sorted(map(tuple, plans.QUERIES[name](spark, sf).collect()))


def theirs(sf, table, sql):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_late_events_of_all_users(spark, sf):
    sql = "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE ts < seen - INTERVAL 10 MINUTE"
    assert ours(spark, sf, "late_events") == theirs(sf, "events", sql)


def test_ner_rules_of_all_documents(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = {(k, m, label, 0.8) for k, t in docs for label, rule in extract.NER.items() for m in re.findall(rule, t or "")}
    assert ours(spark, sf, "ner_rules") == sorted(want)


def test_ner_beside_letters_that_are_not_ascii(spark):
    text = "\u00c9Anna Berg, Jos\u00e9 Mar, Max M\u00fcller, New York\u00e9, Otto Kern \u2013 Acme Ltd"
    got = extract.ner(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()
    assert sorted((r["text"], r["label"]) for r in got) == sorted((m, label) for label, rule in extract.NER.items() for m in re.findall(rule, text))
    assert ("Otto Kern", "Person") in {(r["text"], r["label"]) for r in got}


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_fuzzy_terms_of_all_tokens(spark, sf, tmp_path):
    docs = spark.createDataFrame([(1, "thing th\u00efng th\u00efngs \u00e9thin xyz")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert ours(spark, str(tmp_path), "fuzzy_terms") == [("thing", "thing"), ("th\u00efng", "thing"), ("th\u00efngs", "thing")]
    for at in (sf, str(tmp_path)):
        tokens = [r["token"] for r in search.postings(spark.read.parquet(f"{at}/documents.parquet"), "doc_id", {"content": "text"}).select("token").distinct().collect()]
        assert ours(spark, at, "fuzzy_terms") == sorted((t, "thing") for t in tokens if distance(t[:5], "thing") <= 1)


def alike(a, b):
    return 1.0 if a == b else 1 - distance(a, b) / max(len(a.encode()), len(b.encode()), 1)


def some_names():
    rng = random.Random(3)
    names = {"", "a", "b", "ab", "ba", "cold widget", "old widget", "bold widget", "aaaa", "aaab", "\u00e9", "\u00e9t\u00e9", "ete", "et\u00e9"}
    names |= {"".join(rng.choice("abc\u00e9" if k % 9 == 0 else "abc") for _ in range(rng.randrange(1, 9))) for k in range(150)}
    return [(f"{k:03d}", n) for k, n in enumerate(sorted(names, key=lambda n: rng.random()))]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 0.9])
def test_similar_pairs_and_leaders_lose_none(spark, least):
    rows = some_names()
    df = spark.createDataFrame(rows, "id string, name string")
    want = [(i, j) for i, a in rows for j, b in rows if i < j and alike(a, b) >= least]
    assert sorted((r["a"], r["b"]) for r in extract.similar_pairs(df, "id", "name", least).collect()) == sorted(want)
    if least == 0.75:
        lead = {}
        for i, a in rows:
            lead[i] = next((j for j, b in rows if j < i and lead[j] == j and alike(a, b) >= least), i)
        assert dict(map(tuple, extract.leaders(df, "id", "name", least).collect())) == lead


def test_dedup_entities_pairs_has_no_blocks(spark, sf):
    names = duckdb.connect().execute(f"select min('P:'||p_partkey), lower(p_name) from '{sf}/part.parquet' group by 2").fetchall()
    want = sorted((i, j) for i, a in names for j, b in names if i < j and alike(a, b) >= 0.5)
    assert [r[:2] for r in ours(spark, sf, "dedup_entities_pairs")] == want


def test_prototypes_of_all_labels(spark, sf):
    rows = duckdb.sql(f"select vec_id, label, embedding from '{sf}/embeddings.parquet'").fetchall()
    centroid = {label: [sum(c) / len(c) for c in zip(*(v for _, x, v in rows if x == label))] for label in {x for _, x, _ in rows}}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    assert ours(spark, sf, "prototype_classify") == sorted((k, min(centroid, key=lambda c: (-round(cosine(v, centroid[c]), 6), c))) for k, _, v in rows)
