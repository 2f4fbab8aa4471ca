"""Quality classifier (4): ordinal cumulative-link regression on graded ratings.

A rating is a grade: 0 toxic, 1 poor, 2 good. All grades share one weight for
each hashed text feature; ordered thresholds t1 < t2 cut the score w.x, and the
chance of a grade of k or more is 1 / (1 + exp(t_k - w.x)). That gives the
expected grade, and the tail probability of the top grade, by which documents
are kept.

Features are which words, stems, word shapes and marks around words a text has, and
binned shares of repeated, marked and shouted words. The model is fitted on the
driver on at most SAMPLE rated documents, those with the least hashed ids; only
their feature numbers are collected. Scoring is a map over all rows.

Null and empty texts have no features and get the grade that the thresholds give
for a score of 0. Without ratings everything is kept. Several ratings of one id
count as the lowest of them. Repeated rows are scored alike; empty tables stay
empty; other columns pass through keep_good() and are ignored elsewhere.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm.common import clean_names, cut, released, ship, table

#: Rated documents in the fit, features (a power of two), documents that a feature must occur in, steps and their rate, penalty, and the tail probability that keeps a document.
SAMPLE, FEATURES, LEAST_DOCS, STEPS, RATE, PENALTY, KEEP = 8000, 1 << 22, 4, 250, 0.05, 5e-4, 0.5
GRADES = 3
#: Lengths of the stems that count as features besides whole words.
STEMS = (3, 4, 5, 6, 7)

_PARTS = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


#: Words of the cache, at about 500 bytes each.
WORD_CACHE = 100_000


class _Features(dict):
    """Word to the numbers of its features, emptied at a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        before, core, after = _PARTS.match(word).groups()
        shape = "upper" if core.isupper() and len(core) > 1 else "digit" if core.isdigit() else "title" if core.istitle() else "lower" if core.islower() else "mixed"
        marks = tuple(f"m {x}" for x in (before, after) if x)
        low = core.lower()
        stems = tuple(f"p {low[:k]}" for k in STEMS if len(low) > k)
        names = (f"w {low}", f"s {shape}", *marks, *stems)
        out = self[word] = tuple(xxhash.xxh32_intdigest(x) & (FEATURES - 1) for x in names)
        return out


_of_word = _Features().__getitem__


def features(text: str | None) -> np.ndarray:
    """Numbers of the features that a text has, ascending."""
    words = (text or "").split()
    if not words:
        return np.array([], np.int64)
    kinds = set(words)
    found = set(chain.from_iterable(map(_of_word, kinds)))
    n = len(words)
    shares = {
        "repeated": 1 - len(kinds) / n if n >= 20 else 0.0,
        "upper": sum(map(str.isupper, words)) / n,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines := [x for x in text.split("\n") if x]) > 3 else 0.0,
        "marked": sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")" for w in words) / n,
        "digits": sum(map(str.isdigit, words)) / n,
    }
    size = n.bit_length()
    found.update(xxhash.xxh32_intdigest(f"b {k} {int(v * 10)}") & (FEATURES - 1) for k, v in shares.items())
    found.add(xxhash.xxh32_intdigest(f"b repeated {int(shares['repeated'] * 10)} {size}") & (FEATURES - 1))
    return np.fromiter(sorted(found), np.int64, len(found))


class Model:
    """Weights and thresholds of a proportional-odds model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Chances of a grade of at least 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -40, 40)))

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum(dtype=np.float64) for f in found])


def fit(found: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, penalty: float = PENALTY, rate: float = RATE) -> Model:
    """Maximum penalised likelihood by Adam; grades count by the inverse of their share's root."""
    n = len(found)
    used = np.zeros(FEATURES, np.int32)
    for f in found:
        used[f] += 1
    used = used >= LEAST_DOCS
    column = np.cumsum(used) - 1
    lengths = np.array([int(used[f].sum()) for f in found])
    cols, k = np.concatenate([column[f[used[f]]] for f in found]), int(used.sum())
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    del found
    share = np.bincount(grades, minlength=GRADES) / n
    importance = 1 / np.sqrt(np.maximum(share, 1e-9))[grades]
    importance /= importance.mean()
    # thresholds are b0 and b0 + exp(d): ordered whatever the parameters
    below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    params = np.concatenate([np.zeros(k), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m = v = np.zeros(len(params))
    for step in range(1, steps + 1):
        t = np.concatenate([params[k : k + 1], params[k] + np.cumsum(np.exp(params[k + 1 :]))])
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.zeros(n)
        if k:
            s[some] = np.add.reduceat(params[cols], starts)
        with np.errstate(over="ignore"):
            high, low = (1 / (1 + np.exp(-(edges[grades + up] - s))) for up in (1, 0))
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        ds = importance * (dh - dl) / p / n  # gradient of the loss by the score
        at = np.zeros(GRADES + 1)
        np.add.at(at, grades + 1, -importance * dh / p / n)
        np.add.at(at, grades, importance * dl / p / n)
        by_t = at[1:-1]
        grad = np.concatenate([np.bincount(cols, np.repeat(ds, lengths), k) + penalty * params[:k], [by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * np.exp(params[k + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = params[:k]
    return Model(weights, np.concatenate([params[k : k + 1], params[k] + np.cumsum(np.exp(params[k + 1 :]))]))


# -- the operator ----------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on the rated documents with the least hashed ids, sample of them at most; None without any."""
    ship(docs.sparkSession)
    rated = labels.select("doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min("quality").alias("quality"))
    rated = rated.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = "doc_id bigint, grade int, found array<int>"

    def run(batches):
        for batch in batches:
            for part in cut(batch, ["text"]):
                yield table(schema, {"doc_id": part.column(0), "grade": part.column(1), "found": [features(t) for t in part.column(2).to_pylist()]})

    # at most sample rows of two numbers
    joined = clean_names(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    rows = joined.mapInArrow(run, schema).groupBy("doc_id", "grade").agg(F.min("found").alias("found")).toArrow().sort_by("doc_id")
    grades = rows["grade"].to_numpy().astype(np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    found = rows["found"].combine_chunks()
    offsets, values = found.offsets.to_numpy(), found.values.to_numpy()
    return fit([values[a:b] for a, b in zip(offsets[:-1], offsets[1:])], grades)


def _scored(batch: pa.RecordBatch, at: int, model: Model | None, keep: float):
    """(expected grade, tail probability, kept) of a batch's texts."""
    n = batch.num_rows
    if model is None:
        return np.full(n, float(GRADES - 1)), np.ones(n), np.ones(n, bool)
    tails = model.tails(model.score([features(t) for t in batch.column(at).to_pylist()]))
    return tails.sum(1), tails[:, -1], tails[:, -1] >= keep


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row."""
    docs = clean_names(docs, doc_id=id_col, text=text_col)
    model = train(docs, labels, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, expected_grade double, tail_probability double, kept boolean"

    def run(batches):
        for batch in batches:
            for part in cut(batch, ["text"]):
                expected, tail, kept = _scored(part, 1, shared.value, keep)
                yield table(schema, {"doc_id": part.column(0), "expected_grade": expected, "tail_probability": tail, "kept": kept})

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that the model keeps."""
    model = train(docs, labels, id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in cut(batch, [text_col]):
                yield part.filter(pa.array(_scored(part, at, shared.value, keep)[2]))

    return docs.mapInArrow(released(run), docs.schema)
