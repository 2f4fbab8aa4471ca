"""Suffix-array dedup (3): a distributed merge sort of sampled suffixes that knows its common prefixes.

Every byte covered by a WINDOW-byte string that also starts anywhere else is
removed; with unit="words", every word covered by a string of PASSAGE words that
does (a text is then a sequence of 8-byte word hashes, and white space doesn't
count). What is said of bytes below holds for the symbols of either kind. Suffixes are sampled by content: each window belongs to its anchor, the
place of its least GRAM-byte hash, so equal windows have equal anchors at equal
offsets, and a text has one anchor for about 180 bytes. An anchor's context is
all bytes of the windows that belong to it.

1. All texts give (anchor hash, context hash, place). Anchors whose hash occurs at
   one place only are dropped by a partial aggregation.
2. A context that occurs at two places is repeated as a whole; so are texts that
   occur twice. What is left to compare are different contexts with one anchor
   hash: borders and edited passages.
3. One representative of each such context is cut out of its text. Tasks sort the
   suffixes from the anchors on and exchange them as front-coded runs: the length
   of the prefix shared with the suffix before, and the rest. A loser tree merges
   the runs of a bucket; each run's head carries its common prefix with the last
   suffix put out, heads with different values are ordered by these alone, and
   others are compared only from there on.
4. Neighbours in the merged order say how far a suffix can match to the right;
   windows within that reach are matched with those of the same offset.
5. Covered ranges go back to all places of a context and are merged in each text.

Anchors with more contexts than SPLIT are split by offset and by the bytes that
all windows of a slice share. Inside a passage these slices are equal in every
context: a task sends each such slice once, with one witness, and reports the
others itself, so a bucket gets a slice once for each task whatever share of the
rows has the passage. Byte strings are compared by 64-bit hashes within a group of
suffixes that share GRAM bytes.

Whole copies and contexts with two places need no order: partial aggregations by
hash find them. Contexts that differ but share an anchor, the borders of passages
and edited copies, come through the merged order.

Null and empty texts have 0 bytes and the digest of the empty string. Texts
shorter than WINDOW keep everything. Repeated rows are removed in all copies, as
each occurs elsewhere. Matches never cross rows. Empty tables stay empty; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import xxhash
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm.common import Written, clean_names, cut, free_shuffles, fresh, released, ship, shuffle_partitions, table

#: Symbols of a window and of the string that makes an anchor: bytes, or words.
WINDOW, GRAM = 400, 48
PASSAGE, WORD_GRAM = 50, 6
#: Contexts of a bucket on average; contexts of one anchor from which it is split; slices of a context then; bytes of a run; symbols handled at once.
BUCKET, SPLIT, SLICES, RUN_BYTES, SEGMENT = 4000, 4000, 22, 16 << 20, 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = np.uint64((1 << 24) - 1)
_U = np.uint64


class _Powers:
    """Powers of the hash base and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n, b, _U)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _sums(data: bytes, size: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers) of symbols of that many bytes: the hash of symbols i to j is (sums[j] - sums[i]) * inverse[i]."""
    global _last
    if size == 1 and data is _last[0]:
        return _last[1]
    x = np.frombuffer(data, np.uint8).astype(_U) + _U(1) if size == 1 else np.frombuffer(data, _U).copy()
    up, down = _powers.get(len(x) + 1)
    x *= up[:-1]
    out = np.concatenate([np.zeros(1, _U), np.cumsum(x)]), down
    if size == 1:
        _last = data, out
    return out


#: The bytes that were summed last, and their sums: bytes and words of a text need the same ones.
_last: tuple = (None, None)

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of each word."""
    parts, at = [], 0
    while at < len(data):
        m = _SPACE.search(data, at + SEGMENT)
        some = data[at : m.start() if m else len(data)]
        inside = np.concatenate([[False], ~_SPACES[np.frombuffer(some, np.uint8)], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edges[::2], edges[1::2]
        sums, down = _sums(some)
        parts.append((first + at, end + at, _mix((sums[end] - sums[first]) * down[first] + (end - first).astype(_U))))
        at += len(some) or 1
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))


class Unit:
    """Windows of bytes (code 0) or words (code 1); the code is the last bit of an anchor's hash."""

    def __init__(self, name: str, window: int):
        self.code, self.size, self.gram = {"bytes": (0, 1, GRAM), "words": (1, 8, WORD_GRAM)}[name]
        if not self.gram < window < 8000:
            raise ValueError(f"a window has over {self.gram} and under 8000 {name}")
        self.window, self.width = window, max(1, (window - self.gram) // SLICES)
        #: Bytes that a text with a window has at least.
        self.least = window if name == "bytes" else 2 * window - 1

    def symbols(self, data: bytes) -> bytes:
        return words_of(data)[2].tobytes() if self.code else data


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, window: int = WINDOW, gram: int = GRAM, size: int = 1):
    """(anchor, first window, last window + 1, anchor hash, context hash) arrays; windows are named by their start."""
    parts = []
    for at in range(0, len(data) // size - window + 1, SEGMENT):
        some = data[at * size : (at + SEGMENT + window - 1) * size]
        sums, down = _sums(some, size)
        grams = _mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        places = (grams & ~_PLACE) | np.arange(len(grams), dtype=_U)
        best = (_sliding_least(places, window - gram + 1) & _PLACE).astype(np.int64)
        border = np.flatnonzero(np.diff(best)) + 1
        lo, hi = np.concatenate([[0], border]), np.concatenate([border, [len(best)]])
        a = best[lo]
        context = _mix((sums[hi - 1 + window] - sums[lo]) * down[lo] + (a - lo).astype(_U) * _U(0xD6E8FEB86659FD93) + (hi - lo).astype(_U))
        hashed = grams[a] & ~_U(1) | _U(size > 1)
        parts.append((a + at, lo + at, hi + at, hashed.view(np.int64), context.view(np.int64)))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5


def common(x: bytes, y: bytes, k: int) -> int:
    """Length of the common prefix, of which k bytes are known."""
    n = min(len(x), len(y))
    if x[k:n] == y[k:n]:
        return n
    low, high = k, n  # x[:low] == y[:low], x[:high] != y[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


# -- front-coded runs and their merge ------------------------------------------

_ENTRY = struct.Struct("<HHHHHqqB")


class Suffix:
    """right: bytes from the anchor on; left: bytes before it; windows have offsets near..far to the anchor."""

    __slots__ = ("right", "left", "near", "far", "anchor", "context", "whole")

    def __init__(self, right, left, near, far, anchor, context, whole):
        self.right, self.left, self.near, self.far = right, left, near, far
        self.anchor, self.context, self.whole = anchor, context, whole


def front_coded(run: list[Suffix]) -> bytes:
    out, before = [], b""
    for s in run:
        k = common(before, s.right, 0)
        out.append(_ENTRY.pack(k, len(s.right) - k, len(s.left), s.near, s.far, s.anchor, s.context, s.whole))
        out += s.right[k:], s.left
        before = s.right
    return b"".join(out)


def decoded(run: bytes):
    """(common prefix with the suffix before, suffix) of a run."""
    at, before, n = 0, b"", len(run)
    while at < n:
        k, more, left, near, far, anchor, context, whole = _ENTRY.unpack_from(run, at)
        at += _ENTRY.size
        before = before[:k] + run[at : at + more]
        at += more
        yield k, Suffix(before, run[at : at + left], near, far, anchor, context, whole)
        at += left


def merged(runs: list[bytes]):
    """(common prefix with the suffix before, suffix) of all runs, in order, by a loser tree."""
    sources = [decoded(r) for r in runs]
    size = 1
    while size < len(sources):
        size *= 2
    heads: list[Suffix | None] = [None] * size
    known = [0] * size  # common prefix of each head with the last suffix put out

    def fetch(i: int) -> None:
        got = next(sources[i], None) if i < len(sources) else None
        known[i], heads[i] = got if got else (0, None)

    def beats(i: int, j: int) -> bool:
        """Whether head i goes before head j; afterwards the loser's value refers to the winner."""
        if heads[j] is None:
            return True
        if heads[i] is None:
            return False
        if known[i] != known[j]:
            return known[i] > known[j]
        x, y = heads[i].right, heads[j].right
        k = common(x, y, known[i])
        first = x[k : k + 1] <= y[k : k + 1]
        known[j if first else i] = k
        return first

    for i in range(size):
        fetch(i)
        known[i] = 0
    losers = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        after = []
        for k in range(level):
            i, j = winners[2 * k], winners[2 * k + 1]
            first = beats(i, j)
            after.append(i if first else j)
            losers[level + k] = j if first else i
        winners = after
    top = winners[0]
    while heads[top] is not None:
        yield known[top], heads[top]
        fetch(top)
        node = (top + size) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def matches(entries, window: int = WINDOW, gram: int = GRAM, size: int = 1):
    """(anchor hash, context hash, from, to) of ranges, relative to the anchor, of windows that occur in another context.

    entries: (common prefix with the one before, suffix), in order.
    """
    group: list[tuple[int, Suffix]] = []
    for k, s in entries:
        if group and k < gram * size:
            yield from _of_group(group, window, size)
            group = []
        group.append((k // size, s))
    if group:
        yield from _of_group(group, window, size)


def _of_group(group: list[tuple[int, Suffix]], window: int, size: int = 1):
    if len(group) < 2:
        return
    reach = [max(k if i else 0, group[i + 1][0] if i + 1 < len(group) else 0) for i, (k, _) in enumerate(group)]
    keys, owners, offsets, seen, kept = [], [], [], set(), []
    for (_, s), far in zip(group, reach):
        name = s.context, s.near, s.far
        near = max(s.near, window - far)
        if name in seen or near > s.far:
            continue
        seen.add(name)
        sums, down = _sums(s.left + s.right, size)
        first = len(s.left) // size - s.far
        start = np.arange(first, first + s.far - near + 1)  # the first has the largest offset
        o = s.far - (start - first)
        keys.append(_mix((sums[start + window] - sums[start]) * down[start] + o.astype(_U) * _U(0xD6E8FEB86659FD93)))
        owners.append(np.full(len(start), len(kept)))
        offsets.append(o)
        kept.append(s)
    if len(kept) < 2:
        return
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    owner, offset = np.concatenate(owners)[hit], np.concatenate(offsets)[hit]
    breaks = np.flatnonzero((np.diff(owner) != 0) | (np.diff(offset) != -1)) + 1
    for part in np.split(np.arange(len(owner)), breaks):
        if len(part) and not kept[owner[part[0]]].whole:
            s = kept[owner[part[0]]]
            yield s.anchor, s.context, -int(offset[part[0]]), window - int(offset[part[-1]])


def slices(s: Suffix, unit: Unit):
    """A context cut by offsets, each with a key made of the symbols that all its windows share."""
    whole, a, size, width, window = s.left + s.right, len(s.left), unit.size, unit.width, unit.window
    for j in range(s.near // width, s.far // width + 1):
        near, far = max(s.near, j * width), min(s.far, (j + 1) * width - 1)
        core = whole[max(0, a - j * width * size) : a + (window - (j + 1) * width + 1) * size]
        yield xxhash.xxh64_intdigest(core, j) >> 1, Suffix(s.right[: (window - near) * size], whole[a - far * size : a], near, far, s.anchor, s.context, s.whole)


# -- the operator ----------------------------------------------------------------


def covered(docs: DataFrame, text_col: str, windows: dict[str, int]) -> DataFrame:
    """(hashed, unit, whole, ranges): for each text with repeated symbols, by its xxhash64, whether all of it or which ranges are repeated.

    windows: symbols of a window of "bytes" (unit 0), of "words" (unit 1) or both;
    both go through the same passes.
    """
    units = {u.code: u for u in (Unit(name, n) for name, n in windows.items())}
    docs = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null and text <> ''").withColumn("hashed", F.xxhash64("text"))
    spark = docs.sparkSession
    ship(spark)
    partitions = shuffle_partitions(spark)
    shortest = min(u.least for u in units.values())
    copies = docs.select("hashed", F.octet_length("text").alias("n")).filter(F.col("n") >= shortest).groupBy("hashed").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c > 1")
    fits = F.filter(F.array(*(F.struct(F.lit(u.code).alias("unit"), F.lit(u.least).alias("least")) for u in units.values())), lambda u: F.col("n") >= u["least"])
    copies = copies.select("hashed", F.explode(fits).alias("u")).select("hashed", "u.unit")
    schema = "hashed bigint, a int, lo int, hi int, anchor bigint, context bigint"

    def places(batches):
        seen = set()
        for batch in batches:
            for part in cut(batch, ["text"], 4 << 20):
                out = []
                for text, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if key in seen:
                        continue  # copies are found by their hashes
                    seen.add(key)
                    raw = text.encode()
                    for u in units.values():
                        data = u.symbols(raw) if len(raw) >= u.least else b""
                        if len(data) >= u.window * u.size:
                            found = anchors(data, u.window, u.gram, u.size)
                            out.append([np.full(len(found[0]), key), *found])
                if len(seen) > 500_000:
                    seen.clear()
                if out:
                    cols = [np.concatenate(c) for c in zip(*out)]
                    yield table(schema, dict(zip(("hashed", "a", "lo", "hi", "anchor", "context"), cols)))

    every = Written(docs.mapInArrow(released(places), schema), "anchors")
    place = F.struct("hashed", "a")
    repeated = every.read().groupBy("anchor").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.min("context").alias("c"), F.max("context").alias("d")).filter("x <> y")
    repeated = Written(repeated.select("anchor", (F.col("c") != F.col("d")).alias("mixed")), "repeated")
    free_shuffles(spark)
    some = Written(every.read().join(repeated.read(), "anchor"), "places")
    every.drop()
    free_shuffles(spark)
    each = some.read().groupBy("anchor", "context", "mixed").agg(F.min(F.struct("hashed", "a", "lo", "hi")).alias("x"), F.max(F.struct("hashed", "a", "lo", "hi")).alias("y"))
    each = Written(each.select("anchor", "context", "mixed", (F.col("x") != F.col("y")).alias("whole"), "x.*"), "contexts")
    repeated.drop()
    free_shuffles(spark)
    # what is compared: one representative of each context of an anchor that has several
    sizes = each.read().filter("mixed").groupBy("anchor").agg(F.count("*").alias("n"))
    large = Written(sizes.filter(F.col("n") > SPLIT).select("anchor", F.lit(True).alias("large")), "large")
    n = each.read().filter("mixed").count()
    buckets = max(1, -(-n // BUCKET))
    wanted = each.read().filter("mixed").join(large.read(), "anchor", "left")
    wanted = wanted.groupBy("hashed").agg(F.collect_list(F.struct("a", "lo", "hi", "anchor", "context", "whole", F.coalesce("large", F.lit(False)).alias("large"))).alias("wanted"))

    def firsts(batches):
        """One row of each text that a task has: a large group of copies isn't brought together."""
        seen = set()
        for batch in batches:
            keys = batch.column(1).to_pylist()
            fresh_ones = []
            for key in keys:
                fresh_ones.append(key not in seen)
                seen.add(key)
            if len(seen) > 500_000:
                seen.clear()
            yield batch.filter(pa.array(fresh_ones, pa.bool_()))

    texts = docs.mapInArrow(released(firsts), docs.schema).join(wanted, "hashed").select("hashed", "text", "wanted")

    names = "anchor", "context", "start", "stop"
    match_schema = "anchor bigint, context bigint, start int, stop int"
    run_schema = "bucket bigint, run binary, told binary"

    def runs(batches):
        by: dict[int, list[Suffix]] = {}
        known: dict[tuple, Suffix] = {}  # a slice that this task has, and its witness
        told: list[tuple] = []
        held, seen = 0, set()

        def put_out():
            buckets = sorted(by)
            blobs = []
            for b in buckets:
                by[b].sort(key=lambda s: s.right)
                blobs.append(front_coded(by[b]))
            by.clear()
            known.clear()
            for k in range(0, len(buckets), 64):
                yield table(run_schema, {"bucket": buckets[k : k + 64], "run": blobs[k : k + 64], "told": [None] * len(blobs[k : k + 64])})
            if told:
                yield table(run_schema, {"bucket": [told[0][1] & (2**62 - 1)], "run": [None], "told": [np.array(told, np.int64).tobytes()]})
            told.clear()

        def alone(name: int, one: Suffix) -> bool:
            """Whether the slice has no witness in this task yet; else both are told here."""
            key = xxhash.xxh3_128_intdigest(one.left + one.right), name, one.near, one.far
            first = known.setdefault(key, one)
            if first is one:
                return True
            for s in (first, one):
                if not s.whole:
                    s.whole = 1
                    told.append((s.anchor, s.context, -s.far, units[s.anchor & 1].window - s.near))
            return False

        for batch in batches:
            for part in cut(batch, ["text"], 4 << 20):
                for key, text, places in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if key in seen:
                        continue  # another copy of the text
                    seen.add(key)
                    raw, data = text.encode(), {}
                    for p in places:
                        a, lo, hi, u = p["a"], p["lo"], p["hi"], units[p["anchor"] & 1]
                        if u.code not in data:
                            data[u.code] = u.symbols(raw)
                        right, left = data[u.code][a * u.size : (hi - 1 + u.window) * u.size], data[u.code][lo * u.size : a * u.size]
                        s = Suffix(right, left, a - hi + 1, a - lo, p["anchor"], p["context"], int(p["whole"]))
                        for name, one in slices(s, u) if p["large"] else [(s.anchor >> 1, s)]:
                            if not p["large"] or alone(name, one):
                                by.setdefault(2 * (name % buckets) + u.code, []).append(one)  # a bucket is of one unit
                                held += len(one.right) + len(one.left) + 200
                    if held > RUN_BYTES or len(told) > 200_000:
                        yield from put_out()
                        held = 0
        yield from put_out()

    def found(batches):
        at, held = None, []
        for batch in batches:
            for bucket, run, told in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if told is not None:
                    rows = np.frombuffer(told, np.int64).reshape(-1, 4)
                    yield table(match_schema, {c: np.ascontiguousarray(rows[:, k]) for k, c in enumerate(names)})
                    continue
                if bucket != at:
                    yield from merge(at, held)
                    at, held = bucket, []
                held.append(run)
        yield from merge(at, held)

    def merge(at, held):
        u = units[at & 1] if held else None
        rows = list(matches(merged(held), u.window, u.gram, u.size)) if held else []
        if rows:
            yield table(match_schema, dict(zip(names, zip(*rows))))

    dealt = texts.mapInArrow(released(runs), run_schema).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    partial = Written(dealt.mapInArrow(released(found), match_schema), "matches")
    free_shuffles(spark)
    whole = each.read().filter("whole").select("anchor", "context")
    unit = F.col("anchor").bitwiseAND(1).cast("int").alias("unit")
    reach = F.element_at(F.create_map(*(F.lit(x) for u in units.values() for x in (u.code, u.window))), F.col("anchor").bitwiseAND(1).cast("int"))
    ranges = some.read().join(whole, ["anchor", "context"]).select("hashed", unit, F.col("lo").alias("start"), (F.col("hi") - 1 + reach).alias("stop"))
    ranges = ranges.unionByName(some.read().join(partial.read(), ["anchor", "context"]).select("hashed", unit, (F.col("a") + F.col("start")).alias("start"), (F.col("a") + F.col("stop")).alias("stop")))
    ranges = ranges.distinct().groupBy("hashed", "unit").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    out = copies.withColumn("whole", F.lit(True)).join(ranges, ["hashed", "unit"], "full")
    made = Written(out.select("hashed", "unit", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges"), "covered")
    for done in (some, each, partial, large):
        done.drop()
    free_shuffles(spark)
    return made.read()


def spans(ranges) -> list[list[int]]:
    """Ranges, joined where they touch."""
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def bounds(data: bytes, whole: bool, ranges, passage: int = 0) -> list[list[int]]:
    """First byte and end of each part of a text that goes.

    passage: words of a window, 0 where ranges are bytes; a passage goes up to
    the next word, and a copy of a text with fewer words stays.
    """
    if not passage:
        return [[0, len(data)]] if whole else spans(ranges or [])
    first = words_of(data)[0].tolist()
    cuts = [[0, len(first)]] if whole and len(first) >= passage else spans(ranges or [])
    first.append(len(data))
    return [[first[a], first[b]] for a, b in cuts]


def without(data: bytes, cuts: list[list[int]]) -> bytes:
    edges = [0, *(x for c in cuts for x in c), len(data)]
    return b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, text) of every row.

    The first five are of windows of bytes. n_passage_words counts the words that
    strings of passage words cover which also start anywhere else, and text is
    what the row's text is without them.
    """
    docs = clean_names(docs, doc_id=id_col, text=text_col)
    of = lambda unit: F.first(F.when(F.col("unit") == unit, F.struct("whole", "ranges")), ignorenulls=True)
    marks = covered(docs, "text", {"bytes": window, "words": passage}).groupBy("hashed").agg(of(0).alias("by_bytes"), of(1).alias("by_words"))
    marks = Written(marks, "marks").read()  # a plain join with it is split where a group of copies is large
    joined = docs.withColumn("hashed", F.xxhash64("text")).join(marks, "hashed", "left").select("doc_id", "text", "by_bytes", "by_words")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint, text string"

    def row(text, by_bytes, by_words):
        data = (text or "").encode()
        cuts = bounds(data, **by_bytes) if by_bytes else []
        kept = without(data, cuts) if cuts else data
        passages = bounds(data, **by_words, passage=passage) if by_words else []
        words = sum(len(data[a:b].split()) for a, b in passages)
        return len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), words, without(data, passages).decode()

    def run(batches):
        for batch in batches:
            for part in cut(batch, ["text"]):
                ids, *columns = (part.column(k).to_pylist() for k in range(4))
                rows = [row(*values) for values in zip(*columns)]
                yield table(schema, {"doc_id": ids} | dict(zip([f.split()[0] for f in schema.split(", ")[1:]], zip(*rows))))

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, unit: str = "bytes") -> DataFrame:
    """docs with repeated passages cut out of the text; a character that is cut in two goes as a whole. All columns are kept."""
    marks = covered(docs, text_col, {unit: window})
    kept = list(docs.columns)
    key, mark = fresh(docs, "hashed"), fresh(docs, "marks")
    marks = marks.select(F.col("hashed").alias(key), F.struct("whole", "ranges").alias(mark))
    joined = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`"))).join(marks, key, "left").select(*(F.col(f"`{c}`") for c in kept), mark)
    at = kept.index(text_col)

    def cleaned(text, marked):
        data = text.encode()
        return without(data, bounds(data, **marked, passage=0 if unit == "bytes" else window)).decode("utf-8", "ignore")

    def run(batches):
        for batch in batches:
            for part in cut(batch, kept):
                new = [cleaned(t, m) if m else t for t, m in zip(part.column(at).to_pylist(), part.column(len(kept)).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else part.column(k) for k in range(len(kept))], names=kept)

    return joined.mapInArrow(released(run), docs.schema)
