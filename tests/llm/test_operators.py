"""The ten operators on small tables against brute force, with nulls, empty and repeated rows, clashing columns and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kronograph.llm import bpe, bpe_codec, chat_format, embedding_dedup, fingerprints, html_extract, ngram_join, packing, quality, suffix_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, ids string, hashed string, class int"


def sha(t):
    return hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()


def words(rnd, n):
    return " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "Sed", "não", "été,"]) + str(rnd.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base, passage = words(rnd, 120), words(rnd, 90)
    near = base.split()
    near[5] = "changed"
    out = [base, base, " ".join(near), words(rnd, 80) + " " + passage, passage + "\n" + words(rnd, 60), "", None, "one two", "one two", "ONE two", "a <|endoftext|> b", "x" * 900, "é" * 500, words(rnd, 3000)]
    return list(enumerate(out)) + [(0, base), (None, "loose words here that are five or more")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in texts], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_equals_library():
    own, lib, rnd = bpe.ByteBPE(PATH), library(), random.Random(1)
    letters = [*map(chr, range(0x250)), " ", "  ", "\n", "'s", "<|endoftext|>", "　", "中", "😀", "́", "\x85"]
    for n in range(400):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.count(t) == len(ids) and own.decode(own.encode(t)) == t
        assert packing.tokens(PATH)(t).tolist() == ids


def test_codec_and_counts(docs, none, texts):
    lib = library()
    want = sorted((str(i), len(ids := lib.encode(t or "", add_special_tokens=False).ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")) for i, t in texts)
    assert sorted((str(r[0]), *r[1:]) for r in bpe_codec.round_trip_digests(docs, PATH).collect()) == want
    counts = token_counts.token_counts(docs, PATH).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in counts) == sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in ((x, len(lib.encode(x[1] or "", add_special_tokens=False).ids)) for x in texts))
    back = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in texts)
    assert bpe_codec.round_trip_digests(none, PATH).count() == token_counts.token_counts(none, PATH).count() == 0


def test_packing(docs, none, texts):
    rows = packing.pack(docs, PATH, group_docs=4).collect()
    lib = library()
    want = sorted((str(i), zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")[s : s + 2048].tobytes())) for i, t in texts for s in range(0, len(lib.encode(t or "", add_special_tokens=False).ids) + 1, 2048))
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, PATH).count() == 0


def test_pieces_are_read_where_they_are_packed(docs):
    """One Python process a task cuts pieces and one packs and reads them back; a third took an executor's memory."""
    plan = packing.pack(docs, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("sequence", [64, 100])
def test_packed_sequences_hold_all_ids(docs, none, texts, sequence):
    rows = packing.sequences(docs, PATH, sequence=sequence, group_docs=4, padding=7).collect()
    lib, found, exact = library(), {}, 0
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        n = r["length"]
        exact += n & (n - 1) == 0
        assert sum(r["lengths"]) == n and len(r["ids"]) == (n if n & (n - 1) == 0 else sequence) and set(r["ids"][n:]) <= {7}
        at = 0
        for doc, start, length, total in zip(r["doc_ids"], r["starts"], r["lengths"], r["doc_tokens"]):
            found.setdefault(str(doc), []).append((start, total, r["ids"][at : at + length]))
            at += length
    want = {}
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(str(i), []).extend((s, len(ids), ids[s : s + sequence]) for s in range(0, len(ids), sequence))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.sequences(none, PATH).count() == 0
    if sequence == 64:
        assert exact


def test_first_fit_decreasing():
    rnd = np.random.default_rng(0)
    lengths = rnd.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - free[b])
        free[b] -= lengths[i]


def jaccard_components(texts):
    sets = []
    for _, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[i] = up[j] = min(up[i], up[j])
    return sets, up


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join(docs, none, texts, block):
    sets, up = jaccard_components(texts)
    want = []
    for k, (i, _) in enumerate(texts):
        named = [texts[j][0] for j in range(len(texts)) if up[j] == up[k] and texts[j][0] is not None]
        want.append((str(i), len(sets[k]), str(min(named)) if named else "None"))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in ngram_join.components(docs, block=block).collect()) == sorted(want)
    assert ngram_join.components(none).count() == 0
    if block == 512:
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({up[k] for k in range(len(texts)) if sets[k]}) + sum(not s for s in sets)


def removed(texts, window):
    seen = {}
    data = [(t or "").encode() for _, t in texts]
    for b in data:
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] = seen.get(b[k : k + window], 0) + 1
    for (i, _), b in zip(texts, data):
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                mask[k : k + window] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        yield str(i), len(b), int(mask.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~mask]))


def without_passages(texts, passage):
    """(words in passages that occur elsewhere too, text without them) of each text."""
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for _, t in texts]
    seen = {}
    for words in found:
        for k in range(len(words) - passage + 1):
            key = tuple(m[0] for m in words[k : k + passage])
            seen[key] = seen.get(key, 0) + 1
    for (_, t), words in zip(texts, found):
        mask = [False] * len(words)
        for k in range(len(words) - passage + 1):
            if seen[tuple(m[0] for m in words[k : k + passage])] > 1:
                mask[k : k + passage] = [True] * passage
        data = (t or "").encode()
        ends = [m.start() for m in words[1:]] + [len(data)]
        yield sum(mask), (data[: words[0].start()] if words else data) + b"".join(data[m.start() : end] for m, end, hit in zip(words, ends, mask) if not hit)


@pytest.mark.parametrize("split", [4000, 0])
def test_suffix_dedup(docs, none, texts, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 8)
    want = [(*a, n, left.decode()) for a, (n, left) in zip(removed(texts, 400), without_passages(texts, 50))]
    assert sum(n > 0 for *_, n, _ in want) > 5
    assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.report(docs).collect()) == sorted(want)
    assert suffix_dedup.report(none).count() == 0
    if split:
        cut = suffix_dedup.remove_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == len(texts)
        cut = suffix_dedup.remove_repeats(docs, window=50, unit="words")
        assert sorted(r["text"] or "" for r in cut.collect()) == sorted(w[-1] for w in want)


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_suffix_dedup_of_a_passage_in_many_texts(spark, unit, monkeypatch):
    """Texts that share one passage, in other surroundings each: split anchors and slices that a task tells itself."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", 4)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 8)
    rnd = random.Random(11)
    passage = words(rnd, 100)
    texts = [(k, words(rnd, rnd.randint(0, 60)) + " " + passage + " " + words(rnd, rnd.randint(0, 60))) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    got = suffix_dedup.remove_repeats(df, window=400 if unit == "bytes" else 50, unit=unit).collect()
    if unit == "words":
        want = [left.decode() for _, left in without_passages(texts, 50)]
        assert sorted(r["text"] for r in got) == sorted(want) and not any(passage in w for w in want)
    else:
        assert sorted((str(r["doc_id"]), sha(r["text"])) for r in got) == sorted((i, h) for i, *_, h in removed(texts, 400))


CLASHES = "doc_id bigint, text string, _hashed int, hashed int, _id int, _whole int, _ranges int, marks int, text2 string, same int"


def test_clashing_columns_are_kept(spark, texts):
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, "seven", 8) for i, t in texts], CLASHES)
    labels = spark.createDataFrame([(k, int(k != 3), 0, 9) for k in range(12)], "doc_id bigint, quality int, toxic int, text int")
    for out in (ngram_join.keep_one(df), suffix_dedup.remove_repeats(df), suffix_dedup.remove_repeats(df, window=50, unit="words"), quality.keep_good(df, labels)):
        rows = out.collect()
        assert out.schema == df.schema and rows
        assert {tuple(r)[2:] for r in rows} == {(1, 2, 3, 4, 5, 6, "seven", 8)}


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(5)
    runs, every = [], []
    for _ in range(7):
        some = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30))]
        every += some
        runs.append(suffix_dedup.front_coded(sorted((suffix_dedup.Suffix(s, b"", 0, 0, 0, 0, 0) for s in some), key=lambda s: s.right)))
    out = [(k, s.right) for k, s in suffix_dedup.merged(runs)]
    assert [s for _, s in out] == sorted(every)
    assert all(k == suffix_dedup.common(a, b, 0) for (_, a), (k, b) in zip(out, out[1:]))


def test_quality(spark, none):
    rnd = random.Random(2)
    words = lambda rnd, n: " ".join("".join(rnd.choices("abcdefghijklmnoprstuvyz", k=8)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        t = words(rnd, 60)
        if kind == 0:
            t += " idiot " + words(rnd, 5)
        if kind == 1:
            t = " ".join(w + "%%%" for w in t.split())
        rows.append((i, t))
        if i < 200:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (None, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.grade(docs, marks).collect() if r["doc_id"] is not None}
    held = [i for i in range(200, 300)]
    assert sum(got[i]["kept"] == (i % 3 == 2) for i in held) >= 97
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got.values())
    assert quality.keep_good(docs, marks.limit(0)).count() == 302
    assert quality.grade(docs.limit(0), marks).count() == 0
    m = quality.fit([quality.features(t) for _, t in rows], np.array([k % 3 for k in range(300)]))
    assert m.thresholds[0] < m.thresholds[1]


def test_embedding_dedup(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(60, 8))
    base[20:30] = base[0] + rnd.normal(size=(10, 8)) * 0.1
    base[40] = base[41] * 3
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(60, base[0].tolist()), (61, [0.0] * 8), (62, None), (63, [float("nan")] * 8), (64, [1.0, None] + [0.0] * 6), (65, [1.0])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=16).collect()}
    good = [k for k, v in rows[:61]]
    x = np.array([rows[k][1] for k in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.arange(61)
    for _ in range(61):
        label = np.array([min(label[k], *label[hit[k]]) if hit[k].any() else label[k] for k in range(61)])
    for k in good:
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (hit[k].sum(), label[k], label[k] == k)
    for k in range(61, 66):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_embedding_dedup_of_several_lengths(spark):
    """Vectors of each length link among themselves, in blocks and strips of their own."""
    rnd = np.random.default_rng(8)
    rows = []
    for n, many in ((3, 90), (6, 50), (2, 2), (1, 1)):
        x = rnd.normal(size=(many, n))
        x[many // 2 :] = x[: many - many // 2] * 2 + 1e-3
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(x)]
    rnd.shuffle(rows)
    for kind in ("double", "float"):
        df = spark.createDataFrame([(int(i), v) for i, v in rows], f"vec_id bigint, embedding array<{kind}>")
        values = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=8).collect()}
        near = {i: [j for j, y in values.items() if j != i and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9] for i, x in values.items()}
        label = {i: i for i in values}
        for _ in values:
            label = {i: min([label[i], *(label[j] for j in near[i])]) for i in values}
        assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (len(near[i]), label[i]) for i in values}


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav>{}<aside>side</aside><div class='cookie-notice'>ok?</div><form><p>mail</p></form><footer>&copy; x</footer></body></html>"


def test_html(spark):
    bodies = [f"<div><h1>Head {k}</h1><p>Text &amp;\n more <b>bold {k}<br>next<p>Second {k}</div><div><p>Same on all pages</p></div>" for k in range(12)]
    rows = [(k, f"http://h.example/{k}", PAGE.format(b)) for k, b in enumerate(bodies)]
    rows += [(100, "http://other.example/", PAGE.format("<article><h1>A</h1><p>B&nbsp;c</p><div class='comments'><p>no</p></div></article><p>out</p>")), (101, None, None), (102, "x", ""), (103, "http://h.example/0", rows[0][2])]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(12):
        assert got[k]["text"] == f"Head {k}\n\nText & more bold {k} next\n\nSecond {k}"
    assert got[100]["text"] == "A\n\nB c" and got[100]["n_chars"] == 6
    assert (got[101]["text"], got[102]["text"], got[103]["text"]) == ("", "", got[0]["text"])


#: No tag or class says what is content: menu, notice, side column and foot are plain tables and divisions; the foot varies.
BARE = "<html><body><div><div>Site</div><div><a href=a>Home {0}</a> <a href=b>News</a></div></div><div><div><p>Read us daily {1}</p></div><div>{2}</div><div><div><a href=x>Other story {0}</a></div><div><a href=y>Third story {0}</a></div></div></div><div>Printed {0} at noon</div></body></html>"


def test_html_without_markup_that_tells(spark):
    rnd = random.Random(4)
    says = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99)) for _ in range(n))
    for pages in (2, 7):
        rows, want = [], []
        for k in range(pages):
            parts = [says(60) for _ in range(3)]
            extra = "<div><p>Join our list</p></div>" if pages > 3 else ""
            rows.append((k, f"http://h.example/{k}", BARE.format(k, pages, "<h1>" + says(4) + "</h1>" + extra + "".join(f"<p>{p}</p>" for p in parts))))
            want.append(parts)
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
        for k in range(pages):
            assert got[k].split("\n\n")[1:] == want[k] and got[k].startswith(rows[k][2].partition("<h1>")[2].partition("</h1>")[0])


def test_simple_tree_matching_is_exact():
    rnd = random.Random(6)

    def tree(depth):
        slot = html_extract.Slot(rnd.choice("abc"))
        slot.children = [tree(depth - 1) for _ in range(rnd.randint(0, 4))] if depth else []
        return slot

    def plain(x, y):
        if x.label != y.label:
            return 0
        best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, a in enumerate(x.children):
            for j, b in enumerate(y.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(a, b))
        return 1 + best[-1][-1]

    for _ in range(150):
        x, y = tree(4), tree(4)
        x.label = y.label = "#root"
        page = html_extract.numbered(html_extract.shape(y))
        matching = html_extract.Matching(html_extract.numbered(html_extract.shape(x)))
        pairs = matching.align(page)
        assert len(pairs) == plain(x, y) == len({n for n, _ in pairs}) == len({s.number for _, s in pairs})
        labels = [s.label for s in html_extract.count(matching.seed)]
        assert all(labels[n] == s.label for n, s in pairs)
        ordered = sorted((n, s.number) for n, s in pairs)
        assert ordered == sorted(ordered, key=lambda p: p[1])
    wide = html_extract.fold(html_extract.parse("<div><b>x</b><h2>a</h2><p>b</p></div>" * 300))
    assert len(html_extract.Matching(html_extract.numbered(html_extract.shape(wide))).align(wide)) == wide.size
    deep = html_extract.fold(html_extract.parse("<div>" * 5000 + "x"))
    assert len(html_extract.Matching(html_extract.numbered(html_extract.shape(deep))).align(deep)) == 5001


def test_ordinal_fit_against_plain_descent():
    """The penalised likelihood of the fit is as good as that of a plain descent with numerical gradients."""
    rnd = np.random.default_rng(2)
    n, k = 60, 4
    found, grades = [], []
    for _ in range(n):
        own = np.flatnonzero(rnd.random(k) < 0.5)
        found.append((own * 7 + 3).astype(np.int32))
        grades.append(int(np.clip(round(own.sum() / 3 + rnd.normal() * 0.7), 0, 2)))
    grades = np.array(grades)
    grades[:3] = [0, 1, 2]
    m = quality.fit(found, grades)
    share = np.bincount(grades) / n
    weight = 1 / np.sqrt(share)[grades]
    weight /= weight.mean()

    def loss(w, t):
        s = np.array([sum(w[f] for f in x.tolist()) for x in found])
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        p = 1 / (1 + np.exp(-(edges[grades + 1] - s))) - 1 / (1 + np.exp(-(edges[grades] - s)))
        return -(weight * np.log(np.maximum(p, 1e-12))).mean() + quality.PENALTY / 2 * sum(x * x for x in w.values())

    used = sorted({f for x in found for f in x.tolist()})
    params = np.zeros(len(used) + 2)
    params[-2:] = -1, 1

    def of(x):
        return loss(dict(zip(used, x)), np.sort(x[-2:]))

    for step in range(1500):
        grad = np.array([(of(params + e) - of(params - e)) / 2e-5 for e in np.eye(len(params)) * 1e-5])
        params -= 0.5 * grad
    mine = loss({f: float(m.weights[f]) for f in used}, m.thresholds)
    assert mine <= of(params) + 0.02 and m.thresholds[0] < m.thresholds[1], (mine, of(params))


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|> <\\|end|>"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None), (2, 1, "assistant", "b\\"), (2, 0, None, ""), (None, 0, "assistant", "<|endoftext|>")]
    turns = chat_format.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), PATH)
    got = {r["conv_id"]: r for r in chat_format.read_back(turns, PATH).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine))
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(mine), len(loss), sha(loss))
    for t in ("<|turn|>", "<\\|turn|>", "a<s>b", "[INST", "\\", "<\\\\s>"):
        assert chat_format.unescape(chat_format.escape(t)) == t


def test_fingerprints(docs, none, texts, spark):
    rows = sorted(((i, t or "") for i, t in texts if i is not None), key=lambda r: r)
    unique = {i: t for i, t in reversed(rows)}
    df = spark.createDataFrame(list(unique.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    order = sorted(unique)
    for k, i in enumerate(order):
        t, n = unique[i], unique[order[(k + 1) % len(order)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited))
        a, b, c = (set(fingerprints.paragraphs(x).tolist()) for x in (t, edited, n))
        like = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        assert abs(got[i]["near_edited"] - like(a, b)) < 1e-12 and abs(got[i]["near_next"] - like(a, c)) < 1e-12
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[3]["fingerprint"]
    assert fingerprints.fingerprints(docs).count() == len(texts) and fingerprints.fingerprints(none).count() == 0


def test_coded_sets():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 9, 1000, 65537):
        found = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(ngram_join.decoded(ngram_join.coded(found)), found)
    ends = np.array([0, 1, 2**64 - 1], np.uint64)
    assert np.array_equal(ngram_join.decoded(ngram_join.coded(ends)), ends)
