"""N-gram Jaccard join (2): signature trees over blocks of texts that share a rare shingle.

A document's set holds the 64-bit hashes of its distinct five-word shingles;
equal sets form a class, and only classes are joined.

1. One pass hashes all shingles of the corpus into a table of SKETCH counters
   of fixed size. Ordering shingles by (counter, hash) puts common ones last;
   any order common to all documents is right, this one keeps groups small.
2. Two sets with Jaccard similarity of 0.75 or more share one of their first
   n - ceil(0.75 n) + 1 shingles in that order. The holders of such a shingle,
   sorted by size, fall apart where the next size is out of reach; the least class
   of each part is its hub. Hub and holders meet in the hub's block, so any pair
   that can link shares a block.
3. In a block, a signature tree holds in each node the OR of its members' bitmaps
   and the range of their sizes. Dual traversal drops pairs of nodes whose
   largest possible overlap is too small. The first traversal uses bitmaps alone
   (2 to 4 bits for each shingle) and leaves groups of members that may link. The
   same group from several blocks counts once.
4. Only their whole sets are brought together, and a second traversal, which also
   skips nodes that are one component already, verifies what it cannot exclude.
5. A block of over BLOCK members is cut into chunks that each hold the hub.
   Members that don't link with the hub inside their chunk are then compared
   with every other chunk; the others are in one component already.
6. Links, a spanning set of them for each block, go to connected components.

No pair that can link is left out: neither step has a cap. Hashes have 64 bits.

Null texts, empty texts and texts without words have empty sets and link with
nothing, not even each other. Repeated rows are one class. Null ids may not name
a component unless the component has no other. Empty tables stay empty; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm.common import Written, clean_names, cut, empty, free_shuffles, fresh, released, ship, shuffle_partitions, table
from kronograph.operators.components import connected_components

WORDS, PERCENT = 5, 75
#: Counters of the corpus sketch (4 bytes each), in SKETCH_ROWS rows; members of a block that are compared at once; members of a leaf, for bitmaps alone and where whole sets follow.
SKETCH, SKETCH_ROWS, BLOCK, LEAF, SET_LEAF = 1 << 18, 64, 512, 1, 16
#: Bits of a shingle that find its holders; two shingles alike in them only make a block larger.
KEY_BITS = np.uint64(2**48 - 1)
_SHIFT = np.uint64(64 - SKETCH.bit_length() + 1)

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Words(dict):
    """Word to its hash, emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_word = _Words().__getitem__


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; of the whole sequence where it has fewer words."""
    found = text.encode().lower().split() if text else []  # bytes: only A-Z and the six ASCII white-space bytes count
    if not found:
        return np.array([], np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), len(found))], np.uint64)
    w = np.fromiter(map(_word, found), np.uint64, len(found))
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = (h ^ (h >> np.uint64(29))) * _ODD[k % len(_ODD)] + w[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def prefix(found: np.ndarray, counters: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of which a similar set must share one."""
    n = len(found)
    order = np.lexsort((found, counters[found >> _SHIFT]))
    return found[order[: n - -(-percent * n // 100) + 1]]


#: Values of a set that are coded at once, a multiple of 8.
_STEP = 1 << 16


def coded(found: np.ndarray) -> bytes:
    """A sorted set by Elias and Fano's code: low bits as they are, high bits as gaps in unary; about 66 - log2(n) bits each."""
    n, high = len(found), max(1, (len(found) - 1).bit_length())
    flags = np.zeros(n + (1 << high), np.uint8)
    flags[(found >> np.uint64(64 - high)).astype(np.int64) + np.arange(n)] = 1
    lows = [np.packbits(np.unpackbits(found[k : k + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, high:]).tobytes() for k in range(0, n, _STEP)]
    return b"".join([n.to_bytes(8, "little"), np.packbits(flags).tobytes(), *lows])


def decoded(data: bytes) -> np.ndarray:
    raw, n = np.frombuffer(data, np.uint8), int.from_bytes(data[:8], "little")
    high = max(1, (n - 1).bit_length())
    at = 8 + (n + (1 << high) + 7) // 8
    found = (np.flatnonzero(np.unpackbits(raw[8:at])) - np.arange(n)).astype(np.uint64) << np.uint64(64 - high)
    for k in range(0, n, _STEP):
        m = min(_STEP, n - k)
        size = (m * (64 - high) + 7) // 8
        bits = np.zeros((m, 64), np.uint8)
        bits[:, high:] = np.unpackbits(raw[at : at + size], count=m * (64 - high)).reshape(m, -1)
        found[k : k + m] |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
        at += size
    return found


# -- signature trees -----------------------------------------------------------


def bitmap(found: np.ndarray) -> bytes:
    """One bit for each shingle, in 2 to 4 bits of width for each."""
    width = 1 << max(6, (2 * len(found) - 1).bit_length())
    flags = np.zeros(width, np.uint8)
    flags[(found & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, brought to the least width among them."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, width // 8), axis=0) for m in maps])


class Tree:
    """Members of a block under a signature tree; pairs that bitmaps and sizes can't exclude go to close()."""

    leaf = LEAF

    def __init__(self, ids: list[int], sizes: np.ndarray, maps: list[bytes], percent: int = PERCENT):
        order = np.lexsort((ids, sizes))
        self.order, self.percent = order.tolist(), percent
        self.ids, self.sizes = [ids[i] for i in self.order], sizes[order]
        self.maps = folded([maps[i] for i in self.order])
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def least(self, a, b):
        """Overlap that sets of these sizes need."""
        return self.percent * (a + b) / (100 + self.percent)

    def halves(self, x):
        mid = (x[0] + x[1]) // 2
        return (x[0], mid), (mid, x[1])

    def node(self, x):
        """(OR of bitmaps, least size, largest size, most tokens that share bits)."""
        if x not in self.nodes:
            a, b = x
            self.nodes[x] = np.bitwise_or.reduce(self.maps[a:b]), self.sizes[a], self.sizes[b - 1], self.excess[a:b].max()
        return self.nodes[x]

    def possible(self, x, y) -> bool:
        (p, a, b, e), (q, c, d, f) = self.node(x), self.node(y)
        if self.percent * c > 100 * b or self.percent * a > 100 * d:
            return False
        return int(np.bitwise_count(p & q).sum()) + min(e, f) >= self.least(a, c)

    def traverse(self) -> None:
        stack = [((0, len(self.ids)), (0, len(self.ids)))]
        while stack:
            x, y = stack.pop()
            if self.settled(x, y) or x != y and not self.possible(x, y):
                continue
            if max(x[1] - x[0], y[1] - y[0]) <= self.leaf:
                a, b = self.maps[x[0] : x[1]], self.maps[y[0] : y[1]]
                n, m = self.sizes[x[0] : x[1], None], self.sizes[None, y[0] : y[1]]
                most = np.bitwise_count(a[:, None] & b[None]).sum(2) + np.minimum(self.excess[x[0] : x[1], None], self.excess[None, y[0] : y[1]])
                near = (most >= self.least(n, m)) & (self.percent * np.maximum(n, m) <= 100 * np.minimum(n, m))
                i, j = np.nonzero(np.triu(near, 1) if x == y else near)
                self.close(x[0] + i, y[0] + j)
            elif x == y:
                a, b = self.halves(x)
                stack += [(a, b), (b, b), (a, a)]
            elif x[1] - x[0] >= y[1] - y[0]:
                stack += [(half, y) for half in self.halves(x)]
            else:
                stack += [(x, half) for half in self.halves(y)]


class Candidates(Tree):
    """Groups of members that may link, directly or by way of each other."""

    def find(self) -> list[list[int]]:
        self.label = np.arange(len(self.ids))
        self.traverse()
        groups: dict[int, list[int]] = {}
        for c, g in zip(self.ids, self.label.tolist()):
            groups.setdefault(g, []).append(c)
        return [sorted(g) for g in groups.values() if len(g) > 1]

    def settled(self, x, y) -> bool:
        first = self.label[x[0]]
        return bool((self.label[x[0] : x[1]] == first).all() and (self.label[y[0] : y[1]] == first).all())

    def close(self, i, j) -> None:
        while (apart := np.flatnonzero(self.label[i] != self.label[j])).size:
            a, b = self.label[i[apart[0]]], self.label[j[apart[0]]]
            self.label[self.label == max(a, b)] = min(a, b)


class Block(Tree):
    """Members with their whole sets, and which of them are known to be connected."""

    leaf = SET_LEAF

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int = PERCENT):
        super().__init__(ids, np.array([len(s) for s in sets]), [bitmap(s) for s in sets], percent)
        self.sets = [sets[i] for i in self.order]
        self.up, self.links = list(range(len(ids))), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def verify(self, i: int, j: int) -> bool:
        """Link i and j if they are similar and not yet connected; whether they are connected now."""
        a, b = self.root(i), self.root(j)
        if a == b:
            return True
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        shared = int((y[at] == x).sum())
        if 100 * shared < self.percent * (len(x) + len(y) - shared):
            return False
        self.up[max(a, b)] = min(a, b)
        self.links.append((self.ids[i], self.ids[j]))
        return True

    def join(self, hub: int | None = None) -> None:
        """Find the components of the block; the hub is compared with all first."""
        if hub is not None:
            i = self.ids.index(hub)
            for j in range(len(self.ids)):
                if j != i and self.percent * max(self.sizes[i], self.sizes[j]) <= 100 * min(self.sizes[i], self.sizes[j]):
                    self.verify(i, j)
        self.traverse()

    def settled(self, x, y) -> bool:
        """Whether all members of both nodes are connected already."""
        first = self.root(x[0])
        return all(self.root(i) == first for i in range(*x)) and (x == y or all(self.root(i) == first for i in range(*y)))

    def close(self, i, j) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            self.verify(a, b)


# -- a Bloom filter of row keys ------------------------------------------------

#: Bits for each key, hashes, the most bits in all (64 MB; beyond that more rows pass, none is lost), and parts that are made apart.
BITS, HASHES, MOST_BITS, PARTS = 16, 4, 1 << 29, 64


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    x = keys.view(np.uint64)
    y = (x ^ (x >> np.uint64(33))) * _ODD[4] | np.uint64(1)
    return np.concatenate([((x + np.uint64(k) * y) >> np.uint64(16)) & np.uint64(size - 1) for k in range(HASHES)]).astype(np.int64)


def bloom_filter(rows: DataFrame, key: str) -> np.ndarray:
    """Bits of a Bloom filter of a bigint column; its size follows the number of rows up to MOST_BITS."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS * rows.count() - 1).bit_length()))
    step = size // PARTS

    def spread(batches):
        for batch in batches:
            at = np.sort(_bits(np.ascontiguousarray(batch.column(0).to_numpy()), size))
            edges = np.searchsorted(at, np.arange(PARTS + 1) * step)
            held = [k for k in range(PARTS) if edges[k] < edges[k + 1]]
            yield table("part int, at binary", {"part": held, "at": [(at[edges[k] : edges[k + 1]] - k * step).astype("<u4").tobytes() for k in held]})

    def mark(batches):
        """Rows come sorted by part; one part's bits are held at a time."""
        part, flags = None, None
        for batch in batches:
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != part:
                    if part is not None:
                        yield table("part int, flags binary", {"part": [part], "flags": [np.packbits(flags, bitorder="little").tobytes()]})
                    part, flags = k, np.zeros(step, bool)
                flags[np.frombuffer(at, "<u4")] = True
        if part is not None:
            yield table("part int, flags binary", {"part": [part], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    dealt = rows.select(key).mapInArrow(spread, "part int, at binary").repartition(PARTS, "part").sortWithinPartitions("part")
    out = np.zeros(size // 8, np.uint8)
    for r in dealt.mapInArrow(mark, "part int, flags binary").collect():  # PARTS rows, MOST_BITS in all
        out[r["part"] * step // 8 : (r["part"] + 1) * step // 8] = np.frombuffer(r["flags"], np.uint8)
    return out


def in_filter(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(np.ascontiguousarray(keys), 8 * len(flags)).reshape(HASHES, -1)
    return ((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


# -- the operator --------------------------------------------------------------


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _labelled(docs, id_col, text_col, words, percent, block).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component, that with the least id; rows without words all stay. All columns are kept."""
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hashed")
    best = _labelled(docs, id_col, text_col, words, percent, block).filter("n_shingles > 0").groupBy("component").agg(F.min(least).alias("row"))
    nil = F.lit(-(2**63))
    key, same, marked = fresh(docs, "hashed"), fresh(docs, "same"), docs
    best = Written(best.select(F.col("row.hashed").alias(key), F.coalesce("row.doc_id", nil).alias(same)), "best").read()
    marked = marked.withColumn(key, F.xxhash64(F.col(f"`{text_col}`"))).withColumn(same, F.coalesce(F.col(f"`{id_col}`").cast("bigint"), nil))
    wordless = F.coalesce(~F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = marked.filter(~wordless).join(best, [key, same]).dropDuplicates([key, same])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter(wordless))


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block: int) -> DataFrame:
    """(doc_id, hashed, n_shingles, component, component_id) of every row; component is null for empty sets."""
    docs = clean_names(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession
    ship(spark)
    docs = docs.withColumn("hashed", F.xxhash64("text"))
    per_row = SKETCH // SKETCH_ROWS
    first_schema = "doc_id bigint, hashed bigint, class bigint, n bigint, signature binary, part int, counts binary"

    def first(batches):
        counts, seen = np.zeros(SKETCH, np.int64), set()
        for batch in batches:
            for part in cut(batch, ["text"]):
                classes, sizes, maps = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, words)
                    sizes.append(len(found))
                    classes.append(class_of(found) if len(found) else None)
                    maps.append(None)
                    if len(found) and classes[-1] not in seen:
                        seen.add(classes[-1])
                        maps[-1] = bitmap(found)
                        counts += np.bincount((found >> _SHIFT).astype(np.int64), minlength=SKETCH) if len(found) > SKETCH // 8 else 0
                        if len(found) <= SKETCH // 8:
                            np.add.at(counts, (found >> _SHIFT).astype(np.int64), 1)
                        if len(seen) > 500_000:
                            seen.clear()
                none = [None] * part.num_rows
                yield table(first_schema, {"doc_id": part.column(0), "hashed": part.column(2), "class": classes, "n": sizes, "signature": maps, "part": none, "counts": none})
        rows = [counts[k * per_row : (k + 1) * per_row].astype("<u4").tobytes() for k in range(SKETCH_ROWS)]
        none = [None] * SKETCH_ROWS
        yield table(first_schema, {"doc_id": none, "hashed": none, "class": none, "n": none, "signature": none, "part": list(range(SKETCH_ROWS)), "counts": rows})

    base = Written(docs.mapInArrow(released(first), first_schema), "shingles")
    rows = Written(base.read().filter("part is null").select("doc_id", "hashed", "class", "n"), "rows").read()

    def added(t: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(c, "<u4").astype(np.int64) for c in t["counts"].to_pylist()), np.zeros(per_row, np.int64))
        return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()])})

    # SKETCH counters, whatever the size of the corpus
    sums = base.read().filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(added, "part int, counts binary").collect()
    counters = np.zeros(SKETCH, np.uint32)
    for r in sums:
        counters[r["part"] * per_row : (r["part"] + 1) * per_row] = np.frombuffer(r["counts"], "<u4")
    shared = spark.sparkContext.broadcast(counters)

    key_schema = "key bigint, n int, class bigint"

    def keys(batches):
        order, seen = shared.value, set()
        for batch in batches:
            for part in cut(batch, ["text"], 2 << 20):
                out, classes, sizes = [], [], []
                for text in part.column(0).to_pylist():
                    found = shingles(text, words)
                    if len(found):
                        c = class_of(found)
                        if c not in seen:  # a copy in the same task adds nothing
                            seen.add(c)
                            out.append(prefix(found, order, percent))
                            classes.append(c)
                            sizes.append(len(found))
                if len(seen) > 500_000:
                    seen.clear()
                if out:
                    each = [len(o) for o in out]
                    yield table(key_schema, {"key": (np.concatenate(out) & KEY_BITS).view(np.int64), "n": np.repeat(np.array(sizes, np.int32), each), "class": np.repeat(np.array(classes, np.int64), each)})

    def hubs(batches):
        """Rows come sorted by key, size and class: the first class within reach is the hub."""
        last, last_hub = None, 0
        for batch in batches:
            key, n, c = (batch.column(k).to_numpy() for k in range(3))
            if not len(key):
                continue
            before_key, before_n = (np.concatenate([[x[0]], x[:-1]]) for x in (key, n))
            if last is not None:
                before_key[0], before_n[0] = last
            new = (key != before_key) | (100 * before_n.astype(np.int64) < percent * n.astype(np.int64))
            new[0] |= last is None
            hub = np.concatenate([[last_hub], c[new]])[np.cumsum(new)]
            last, last_hub = (key[-1], n[-1]), hub[-1]
            pick = hub != c
            both = np.unique(np.stack([c[pick], hub[pick]], 1), axis=0) if pick.any() else np.zeros((0, 2), np.int64)
            yield table("class bigint, hub bigint", {"class": np.ascontiguousarray(both[:, 0]), "hub": np.ascontiguousarray(both[:, 1])})

    partitions = shuffle_partitions(spark)
    keyed = docs.select("text").mapInArrow(released(keys), key_schema).repartition(partitions, "key").sortWithinPartitions("key", "n", "class")
    holders = Written(keyed.mapInArrow(released(hubs), "class bigint, hub bigint").distinct(), "hubs")
    del keyed
    free_shuffles(spark)

    # members of each hub's block, the hub itself in every chunk
    counted = holders.read().groupBy("hub").agg(F.ceil((F.count("*") + 1) / block).alias("chunks"))
    counted = Written(counted, "blocks")
    member = holders.read().join(counted.read(), "hub").select("class", "hub", F.pmod(F.xxhash64("class", "hub"), F.col("chunks")).alias("chunk"), "chunks")
    itself = counted.read().select(F.col("hub").alias("class"), "hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "chunks")
    members = Written(member.unionByName(itself), "members")
    # blocks of one chunk become the groups that bitmaps say may link, named by their members
    single = members.read().filter("chunks = 1").select("class", "hub")
    maps = base.read().filter("signature is not null").join(single.select("class").distinct().hint("merge"), "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
    near_schema = "class bigint, hub bigint, chunk bigint, chunks bigint"

    def near(batches):
        at, ids, sizes, found = None, [], [], []

        def finish():
            groups = Candidates(ids, np.array(sizes), found, percent).find() if len(ids) > 1 else []
            return [(c, class_of(np.array(g)), 0, 1) for g in groups for c in g]

        for batch in batches:
            out = []
            for hub, c, n, m in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if hub != at:
                    out += finish()
                    at, ids, sizes, found = hub, [], [], []
                ids.append(c)
                sizes.append(n)
                found.append(m)
            yield table(near_schema, dict(zip(("class", "hub", "chunk", "chunks"), zip(*out)))) if out else empty(near_schema)
        out = finish()
        yield table(near_schema, dict(zip(("class", "hub", "chunk", "chunks"), zip(*out)))) if out else empty(near_schema)

    marked = single.join(maps.hint("merge"), "class").select("hub", "class", "n", "signature").repartition(partitions, "hub").sortWithinPartitions("hub", "class").mapInArrow(near, near_schema)
    all_members = members
    members = Written(marked.distinct().unionByName(all_members.read().filter("chunks > 1")), "near")
    del marked, maps, single
    for done in (base, all_members, holders):
        done.drop()
    free_shuffles(spark)
    # one row of the input stands for each class that is in a block
    wanted = members.read().select("class").distinct()
    stands = rows.filter("n > 0").groupBy("class").agg(F.min(F.struct("hashed", "doc_id")).alias("row")).join(wanted, "class", "left_semi")
    stands = Written(stands.select(F.xxhash64("row.hashed", "row.doc_id").alias("key")), "stands")
    filtered = bloom_filter(stands.read(), "key")
    shared_bits = spark.sparkContext.broadcast(filtered)

    def sets(batches):
        bits = shared_bits.value
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(bits, batch.column(1).to_numpy())))
            for part in cut(batch, ["text"], 2 << 20):
                made = [shingles(t, words) for t in part.column(0).to_pylist()]
                yield table("class bigint, set binary", {"class": [class_of(f) for f in made if len(f)], "set": [coded(f) for f in made if len(f)]})

    # rows that the filter lets through by chance find no block, or are one more copy there
    found = docs.select("text", F.xxhash64("hashed", "doc_id").alias("key"))
    kept = Written(found.mapInArrow(released(sets), "class bigint, set binary"), "sets")
    free_shuffles(spark)
    linked_schema = "src bigint, dst bigint, alone boolean"

    def compared(cross: bool):
        def run(batches):
            at, ids, found, sides = None, [], [], []
            for batch in batches:
                for hub, a, b, c, s in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if at != (hub, a, b):
                        if at is not None and len(ids) > 1:
                            yield finish(at[0], ids, found)
                        at, ids, found = (hub, a, b), [], []
                    if not ids or ids[-1] != c:
                        ids.append(c)
                        found.append(decoded(s))
            if at is not None and len(ids) > 1:
                yield finish(at[0], ids, found)

        def finish(hub, ids, found):
            made = Block(ids, found, percent)
            made.join(hub if hub in ids else None)
            src, dst, alone = [a for a, _ in made.links], [b for _, b in made.links], [False] * len(made.links)
            if not cross and hub in made.ids:
                top = made.root(made.ids.index(hub))
                apart = [c for k, c in enumerate(made.ids) if made.root(k) != top]
                src, dst, alone = src + apart, dst + [hub] * len(apart), alone + [True] * len(apart)
            return table(linked_schema, {"src": src, "dst": dst, "alone": alone})

        return run

    def grouped(who: DataFrame, sets: DataFrame, cross: bool) -> DataFrame:
        """who: class, hub, chunk, other. Both sides are large on a large corpus, so they are merged whatever their size."""
        full = who.join(sets.hint("merge"), "class").select("hub", "chunk", "other", "class", "set")
        return full.repartition(partitions, "hub", "chunk", "other").sortWithinPartitions("hub", "chunk", "other", "class").mapInArrow(compared(cross), linked_schema)

    one = members.read().withColumn("other", F.lit(-1).cast("bigint"))
    within = Written(grouped(one, kept.read(), False), "links")
    free_shuffles(spark)
    links = within.read().filter("not alone").select("src", "dst")
    # blocks of several chunks: members apart from their hub meet the other chunks too
    apart = within.read().filter("alone").select(F.col("src").alias("class"), F.col("dst").alias("hub")).join(counted.read().filter("chunks > 1"), "hub").distinct()
    parts = apart.groupBy("hub").agg(F.ceil(F.count("*") / block).alias("parts"))
    parts, more = Written(parts, "parts"), []
    if parts.read().limit(1).count():
        every = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
        lone = apart.join(parts.read(), "hub").select("class", "hub", F.explode(every).alias("chunk"), F.pmod(F.xxhash64("hub", "class"), F.col("parts")).alias("other"))
        rest = members.read().join(parts.read(), "hub").select("class", "hub", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
        who = Written(lone.unionByName(rest).distinct(), "across")
        # only the sets of these blocks are moved again
        wide = spark.sparkContext.broadcast(bloom_filter(who.read().select("class").distinct(), "class"))

        def those(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_filter(wide.value, batch.column(0).to_numpy())))

        across = Written(grouped(who.read(), kept.read().mapInArrow(those, "class bigint, set binary"), True), "across-links")
        links = links.unionByName(across.read().select("src", "dst"))
        who.drop()
        more.append(across)
    kept.drop()
    free_shuffles(spark)
    joined = Written(connected_components(links), "components")
    for done in (members, stands, counted, parts, within, *more):
        done.drop()
    least = rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    least = least.join(joined.read(), least["class"] == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    least = Written(least, "least")
    named = Written(least.read().groupBy("component").agg(F.min("least").alias("component_id")), "named")
    label = Written(least.read().join(named.read(), "component").select("class", "component", "component_id"), "labels")
    out = rows.join(label.read(), "class", "left")
    return out.select("doc_id", "hashed", F.col("n").alias("n_shingles"), "component", "component_id")
