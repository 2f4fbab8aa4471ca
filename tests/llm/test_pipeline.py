"""The pipeline keeps what its stages decide, and its pieces cover what they leave."""

import re
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from kronograph.llm import packing, quality
from tests.llm.test_operators import without_passages


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = docs.cache()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    texts = docs.toPandas()
    assert (texts["n_chars"] == texts["text"].str.len()).all()
    encode = packing.tokens(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in zip(texts["doc_id"], texts["text"]):
        ids = np.append(encode(t).astype("<u4"), np.array([1], "<u4"))
        want += [(i, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id", "ids_crc32").toPandas()
    assert sorted(want) == sorted(zip(got["doc_id"], got["ids_crc32"]))


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_stages_against_brute_force(spark, sf):
    """Each of the first three stages on what its predecessor kept, against plain Python."""
    grade, near, repeats, _ = (stage for _, stage in corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    at = docs.columns.index("text")
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r["doc_id"]] = 0 if r["toxic"] else 2 if r["quality"] else 1
    rated = sorted((r for r in rows if r[0] in labels), key=lambda r: r[0])
    model = quality.fit([quality.features(r[at]) for r in rated], np.array([labels[r[0]] for r in rated]))
    want = [r for r in rows if model.tails(model.score([quality.features(r[at])]))[0, -1] >= quality.KEEP]
    got = [tuple(r) for r in grade(spark, docs, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(rows)

    sets, up = shingle_sets([r[at] for r in want]), list(range(len(want)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for k, r in enumerate(want):
        best[root(k)] = min(best.get(root(k), r), r)
    kept = [best[k] for k in best]
    docs = spark.createDataFrame(want, docs.schema)
    got = [tuple(r) for r in near(spark, docs, sf).collect()]
    assert sorted(got) == sorted(kept) and len(got) < len(want)

    docs = spark.createDataFrame(kept, docs.schema)
    cut = {r["doc_id"]: r for r in repeats(spark, docs, sf).collect()}
    left = without_passages([(r[0], r[at]) for r in kept], 50)
    total = 0
    for r, (n, t) in zip(kept, left):
        total += n
        assert cut[r[0]]["text"] == t.decode() and cut[r[0]]["n_chars"] == len(t.decode())
    assert len(cut) == len(kept) and total
