"""Document fingerprints (10): invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs at line ends, and long paragraphs at places that
their own words choose, so that an edit changes only the paragraphs it touches.
Every paragraph's digest (with its running number among equal ones) is put into
three cells of a sketch; a cell sums counts, digests and check values. Two
sketches subtract cell by cell, and peeling recovers the digests that differ.
Where peeling fails, both sketches are made again at a larger size, so likeness
is exact up to equal digests: 2 x shared / (paragraphs of both). The larger ones
are made of the paragraphs, which only the run has: from stored fingerprints alone
near values follow where the CELLS cells peel, and not where texts differ more.

The text that follows a document is found by dealing the documents into ranges
of ids (bounds from approximate quantiles of the id column) and sending the
first document of each range also to the range before it; each range then
streams through one task in order.

Null and empty texts have no paragraphs; two texts without any are alike (1).
Equal ids are ordered by text, null ids come first; repeated rows repeat; the
only document of a table is its own follower; empty tables stay empty; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain, compress

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm.common import clean_names, cut, ship, shuffle_partitions, table

#: Cells of a stored sketch; a word ends a paragraph with a chance of 1 in PARAGRAPH_WORDS.
CELLS, PARAGRAPH_WORDS = 24, 8
HASHES = 3
#: Bytes of text that a range of ids has on average at most.
RANGE_BYTES = 64 << 20

_U = np.uint64


def _of_line(line: str) -> list[int]:
    """Digests of a line's paragraphs."""
    words = line.split()
    if not words:
        return []
    cuts = [k + 1 for k in compress(range(len(words)), map(_ends, words))]
    if not cuts or cuts[-1] < len(words):
        cuts.append(len(words))
    return [xxhash.xxh64_intdigest(" ".join(words[a:b])) for a, b in zip([0, *cuts], cuts)]


class _Lines(dict):
    """Line to its digests, for a few documents: an edited text shares most lines with its document or the next one."""

    def __missing__(self, line: str) -> list[int]:
        if len(self) > 2000:
            self.clear()
        out = self[line] = _of_line(line)
        return out


_lines = _Lines().__getitem__


def paragraphs(text: str) -> np.ndarray:
    """Digests of a text's paragraphs; the k-th of several equal ones is a digest of its own."""
    out = list(chain.from_iterable(map(_lines, text.split("\n"))))
    if len(set(out)) < len(out):
        seen: dict[int, int] = {}
        for k, d in enumerate(out):
            again = seen.get(d, 0)
            seen[d] = again + 1
            if again:
                out[k] = xxhash.xxh64_intdigest(f"{d} {again}")
    return np.array(out, _U)


class _Ends(dict):
    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh32_intdigest(word) % PARAGRAPH_WORDS == 0
        return out


_ends = _Ends().__getitem__


#: One salt for each part of a sketch, and one for check values.
_SALTS = np.array([0x9E3779B97F4A7C15 * (salt + 1) % 2**64 for salt in (*range(HASHES), 7)], _U)[:, None]


def _mixed(digests: np.ndarray) -> np.ndarray:
    """Rows of hashes of the digests: one for each part of a sketch, then their check values."""
    x = digests ^ _SALTS
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sketch:
    """HASHES parts of cells; a digest has one cell in each part."""

    def __init__(self, digests: np.ndarray, cells: int, mixed: np.ndarray | None = None):
        self.part = max(1, cells // HASHES)
        n = self.part * HASHES
        self.count, self.sums, self.checks = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)
        self.digests, self.mixed = digests, _mixed(digests) if mixed is None else mixed
        self.n = len(digests)
        self.change(digests, np.ones(len(digests), np.int64), self.mixed)

    def change(self, digests: np.ndarray, by: np.ndarray, mixed: np.ndarray) -> None:
        at = (mixed[:HASHES] % _U(self.part)).astype(np.int64)
        at += np.arange(0, HASHES * self.part, self.part)[:, None]
        at, signed = at.ravel(), by.astype(_U)
        for cells, change in ((self.count, by), (self.sums, digests * signed), (self.checks, mixed[HASHES] * signed)):
            np.add.at(cells, at, np.concatenate((change,) * HASHES))

    def resized(self, cells: int) -> Sketch:
        """A sketch of the same digests with another number of cells."""
        return Sketch(self.digests, cells, self.mixed)

    def packed(self) -> str:
        raw = self.n.to_bytes(4, "little") + self.count.astype("<i4").tobytes() + self.sums.tobytes() + self.checks.astype("<u4").tobytes()
        return base64.b64encode(raw).decode()

    def difference(self, other: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only here and only there; None where peeling gets stuck."""
        left = object.__new__(Sketch)
        left.part, left.n = self.part, 0
        left.count, left.sums, left.checks = self.count - other.count, self.sums - other.sums, self.checks - other.checks
        here, there, found = [], [], 0
        while True:
            at = np.flatnonzero(np.abs(left.count) == 1)
            if not len(at):
                break
            sign = left.count[at]
            signed = sign.astype(_U)
            digests = left.sums[at] * signed
            mixed = _mixed(digests)
            pure = np.flatnonzero(left.checks[at] * signed == mixed[HASHES])
            if not len(pure):
                break
            digests, first = np.unique(digests[pure], return_index=True)
            first = pure[first]
            sign = sign[first]
            here.append(digests[sign > 0])
            there.append(digests[sign < 0])
            left.change(digests, -sign, mixed[:, first])
            found += len(digests)
            if found > self.n + other.n:
                return None
        if left.count.any() or left.sums.any():
            return None
        none = np.array([], _U)
        return np.concatenate([none, *here]), np.concatenate([none, *there])


def likeness(x: Sketch, y: Sketch) -> float:
    """2 x shared / all paragraphs of two sketches of one size; both are made larger where they don't peel."""
    n = x.n + y.n
    if not n:
        return 1.0
    cells = len(x.count)
    found = x.difference(y) if abs(x.n - y.n) <= cells else None
    while found is None:
        cells = max(2 * cells, 3 * n // 2 + 3)
        found = x.resized(cells).difference(y.resized(cells))
    return 2 * (x.n - len(found[0])) / n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    ship(spark)
    docs = clean_names(docs, doc_id=id_col, text=text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    ids = docs.select("doc_id").filter("doc_id is not null")
    # one number for each range, not for each document
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)
    firsts = docs.select(bucket.alias("bucket"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    # the first document of each range closes the range before it; the first of all closes the last
    before = [firsts[k - 1]["bucket"] for k in range(len(firsts))]
    also = F.lit(None).cast("int")
    for row, to in zip(firsts, before):
        also = F.when((key == row["key"]) & (F.col("bucket") == row["bucket"]), F.lit(to)).otherwise(also)
    if len(firsts) > 40:  # long chains of conditions compile badly
        pairs = F.create_map(*(x for row, to in zip(firsts, before) for x in (F.lit(row["key"]), F.lit(to))))
        also = F.try_element_at(pairs, key)
    copies = F.when(also.isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("closes")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("closes")), F.struct(also.alias("bucket"), F.lit(1).alias("closes")))
    )
    dealt = docs.withColumn("bucket", bucket).withColumn("copy", F.explode(copies)).select("copy.bucket", "copy.closes", "doc_id", "text")
    dealt = dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "closes", "doc_id", "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def finished(doc, follower):
        doc_id, text, sketch = doc
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + follower[1][:quarter]
        other = Sketch(paragraphs(edited), cells)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.packed(), other.packed(),
            likeness(sketch, other), likeness(sketch, follower[2]),
        )

    def run(batches):
        last, at, out, closed = None, None, [], False
        for batch in batches:
            for part in cut(batch, ["text"]):
                for group, closes, doc_id, text in zip(*(part.column(k).to_pylist() for k in range(4))):
                    if closes and closed and group == at:
                        continue  # several documents have the first id: the first of them follows
                    text = text or ""
                    doc = doc_id, text, Sketch(paragraphs(text), cells)
                    if last is not None and group == at:
                        out.append(finished(last, doc))
                    last, at, closed = doc, group, bool(closes)
                if out:
                    yield table(schema, dict(zip(names, zip(*out))))
                    out = []

    return dealt.mapInArrow(run, schema)
