"""HTML extraction (7): wrapper induction over the pages of a host.

1. Every page becomes a small tree: a run of sibling leaf blocks with one label
   (paragraphs, items of a menu) folds into one slot, containers stay apart. Every
   slot knows the hash of its text and how much of it lies in and outside links.
2. Each host gets a seed tree: of the pages with its most common layout, the one
   with the least hash.
3. All pages of the host are aligned with the seed by simple tree matching (the
   largest number of matched nodes that keeps parents and order, found exactly).
   Each distinct body casts one vote for the text that it has at every seed node.
4. The votes make the wrapper. Its region is found from the root on: as long as one
   container holds REGION of the text outside links, the wrapper goes into it,
   unless that would lose a heading or block that varies. Constant nodes are
   template, containers that hold little but links are menus, and the varying
   slots of the region are content.
5. Extraction aligns each page again and joins the region's content slots. Inside
   the region, markup is a hint besides: an article in it is preferred, and what
   is declared as menu, advert, form and the like goes. Where a host has a single
   body, or no region stands out, or a page lacks it, markup alone decides.

Seeds, votes and wrappers are aggregated by host with partial sums, and pages
meet their wrapper in a join whose strategy Spark picks by the wrapper table's
size; the html itself is not grouped by host, so a host may have any share of
the pages. Depth, size and number of siblings don't change how a page is handled.

A node of the region needs LEAST bodies to be template: two or three bodies that
share a block may be copies of one text. Null or empty html gives the empty text;
a page without url belongs to the host ''. Repeated pages repeat and vote once.
Empty tables stay empty; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm.common import clean_names, cut, empty, ship, table, written

#: Share of a node's text outside links by which a container is gone into; share of equal texts that makes a node constant; share of links that makes a menu.
REGION, CONSTANT, MENU = 0.8, 0.9, 0.8
#: Distinct bodies that a host needs for a wrapper, and a constant node of the region to be left out.
BODIES, LEAST = 2, 4

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
LEFT_OUT = frozenset("head nav footer aside form script style noscript template iframe title button select option input textarea dialog menu svg object embed canvas".split())
MARKED = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist cookie cookies notice consent gdpr popup modal overlay newsletter subscribe share sharing social related recommended login signup search disqus respond skip pagination toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
LEAVES = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre figure img option hr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an end tag or an implied end doesn't reach beyond.
SCOPE = frozenset("article section main div td th table ul ol body html aside nav header footer blockquote form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "mark", "children", "said", "chars", "links")

    def __init__(self, tag: str, mark: str = ""):
        self.tag, self.mark, self.children = tag, mark, []


def parse(html: str) -> Node:
    """A forgiving DOM tree: unknown ends are ignored, missing ones implied."""
    root = Node("#root")
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
        elif m[2]:
            tag, rest = m[2].lower(), m[3]
            if tag in P_ENDS:
                _end(stack, {"p"})
            if tag in CLOSED_BY:
                _end(stack, CLOSED_BY[tag])
            mark = " ".join(f"{a[0].lower()}={a[1] or a[2] or a[3]}" for a in _ATTR.findall(rest)) if rest else ""
            node = Node(tag, mark)
            stack[-1].children.append(node)
            if tag in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag not in VOID and not rest.endswith("/"):
                stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _end(stack: list[Node], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in SCOPE:
            return


def declared(node: Node, in_article: bool) -> bool:
    """Whether markup itself says that this is no content."""
    if node.tag in LEFT_OUT:
        return True
    if not in_article and node.tag == "header":
        return True
    if not node.mark or node.tag in ("html", "body", "article", "main", "h1"):
        return False
    words = set(_WORD.findall(node.mark.lower()))
    return bool(words & MARKED) or any(f"role={r}" in node.mark.lower() for r in ROLES) or (not in_article and "header" in words)


def roots(tree: Node) -> list[Node]:
    """The outermost articles, else mains, else the whole page."""
    for tag in ("article", "main"):
        found, stack = [], [(tree, False)]
        while stack:
            node, out = stack.pop()
            if node.tag == tag and not out:
                found.append(node)
                continue
            out = out or declared(node, False)
            stack += [(c, out) for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [tree]


def blocks(start: list[Node], left_out: set[int], inside: bool) -> list[str]:
    """Texts of the content blocks of some nodes, in page order; left_out holds ids of nodes."""
    out: list[str] = []
    for root in start:
        inner, run = inside or root.tag in ("article", "main"), []

        def flush():
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

        stack = [root]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                run.append(node)
            elif node.tag in ("br", "wbr"):
                run.append(" " if node.tag == "br" else "")
            elif id(node) not in left_out and (node is root or not declared(node, inner)):
                if node.tag not in INLINE:
                    flush()
                    stack.append(None)
                stack += reversed(node.children)
        flush()
    return out


# -- folded trees and simple tree matching ---------------------------------


class Slot:
    """Siblings that stand for one node; number counts slots in page order, size those of the subtree."""

    __slots__ = ("label", "nodes", "children", "number", "kind", "size")

    def __init__(self, label: str):
        self.label, self.nodes, self.children, self.number, self.kind, self.size = label, [], [], 0, 0, 1

    @property
    def tag(self) -> str:
        return self.label.partition(" ")[0]

    def said(self) -> int:
        return _hash(n.said for n in self.nodes)

    def chars(self) -> int:
        return sum(n.chars for n in self.nodes)

    def links(self) -> int:
        return sum(n.links for n in self.nodes)


def _hash(parts) -> int:
    h = xxhash.xxh64()
    for p in parts:
        if p:
            h.update(p.to_bytes(8, "little"))
    return h.intdigest() >> 1


def weigh(tree: Node) -> None:
    """Hash of the text below each node (0 without text), and its length outside and in links."""
    nodes = [tree]
    for node in nodes:
        nodes += (c for c in node.children if isinstance(c, Node))
    for node in reversed(nodes):
        parts, node.chars, node.links = [], 0, 0
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                parts.append(xxhash.xxh64_intdigest(text) >> 1 if text else 0)
                node.chars += len(text)
            else:
                parts.append(c.said)
                node.chars, node.links = node.chars + c.chars, node.links + c.links
        node.said = _hash(parts) if any(parts) else 0
        if node.tag == "a":
            node.chars, node.links = 0, node.chars + node.links


def fold(tree: Node) -> Slot:
    weigh(tree)
    root = Slot("#root")
    root.nodes = [tree]
    every = [root]
    for slot in every:
        for node in slot.nodes:
            last = None
            for c in node.children:
                if isinstance(c, str) or c.tag in INLINE or c.tag in RAW:
                    continue
                label = f"{c.tag} {c.mark}".strip()
                if last is None or last.label != label or c.tag not in LEAVES:
                    last = Slot(label)
                    slot.children.append(last)
                last.nodes.append(c)
        every += slot.children
    count(root)
    return root


def count(root: Slot) -> list[Slot]:
    """Number the slots in page order."""
    order, stack = [], [root]
    while stack:
        slot = stack.pop()
        slot.number = len(order)
        order.append(slot)
        stack += reversed(slot.children)
    return order


def shape(root: Slot) -> list:
    """Labels and numbers of children, in page order."""
    return [[s.label, len(s.children)] for s in count(root)]


def numbered(spec: list) -> Slot:
    """The slots of a stored shape."""
    root = Slot(spec[0][0])
    open_, left = [root], [spec[0][1]]
    for label, n in spec[1:]:
        while not left[-1]:
            open_.pop()
            left.pop()
        left[-1] -= 1
        slot = Slot(label)
        open_[-1].children.append(slot)
        open_.append(slot)
        left.append(n)
    count(root)
    return root


def alike(p, q) -> tuple[int, int]:
    """Numbers of equal kinds that two rows begin and end with; to match these with each other is always best."""
    most, first = min(len(p), len(q)), 0
    while first < most and p[first] == q[first]:
        first += 1
    last = 0
    while last < most - first and p[-1 - last] == q[-1 - last]:
        last += 1
    return first, last


class Matching:
    """Simple tree matching of pages with one seed. Subtrees of one kind have equal shapes; kinds are matched once."""

    def __init__(self, seed: Slot):
        self.seed, self.kinds, self.labels = seed, {}, {}
        self.shapes: list[tuple] = []  # of each kind: label, kinds of the children, size
        self.memo: dict[tuple[int, int], int] = {}
        self.sort(seed)

    def sort(self, root: Slot) -> None:
        for slot in reversed(count(root)):
            key = self.labels.setdefault(slot.label, len(self.labels)), *(c.kind for c in slot.children)
            slot.size = 1 + sum(c.size for c in slot.children)
            slot.kind = self.kinds.setdefault(key, len(self.shapes))
            if slot.kind == len(self.shapes):
                self.shapes.append((key[0], key[1:], slot.size))

    def weights(self, a: int, b: np.ndarray) -> np.ndarray:
        """Matched nodes of a subtree with each of some others; all pairs of one label are in memo."""
        kinds, back = np.unique(b, return_inverse=True)
        label = self.shapes[a][0]
        return np.array([self.memo[a, k] if self.shapes[k][0] == label else 0 for k in kinds.tolist()], np.int64)[back]

    def rows(self, a: list[int], b: np.ndarray) -> np.ndarray:
        """Matched nodes of all of a with each beginning of b."""
        best, seen = np.zeros(len(b) + 1, np.int64), {}
        for x in a:
            if x not in seen:
                seen[x] = self.weights(x, b)
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + seen[x]))
        return best

    def size(self, a: int, b: int) -> int:
        """Matched nodes of two subtrees with one label."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.memo:
                stack.pop()
            elif x == y:
                self.memo[x, y] = self.shapes[x][2]
            else:
                p, q = self.shapes[x][1], self.shapes[y][1]
                i, j = alike(p, q)
                alone = 1 + sum(self.shapes[k][2] for k in (*p[:i], *p[len(p) - j :]))
                p, q = p[i : len(p) - j], q[i : len(q) - j]
                p_kinds, q_kinds = dict.fromkeys(p), dict.fromkeys(q)
                todo = [(i, j) for i in p_kinds for j in q_kinds if self.shapes[i][0] == self.shapes[j][0] and (i, j) not in self.memo]
                if todo:
                    stack += todo
                else:
                    self.memo[x, y] = alone + (int(self.rows(list(p), np.array(q))[-1]) if p and q else 0)
        return self.memo[a, b]

    def pairs(self, a: list[Slot], b: list[Slot]) -> list[tuple[Slot, Slot]]:
        """An alignment of two rows of siblings with the most matched nodes; rows are halved, so memory is linear in them."""
        p, q = [x.kind for x in a], [y.kind for y in b]
        first, last = alike(p, q)
        out = [*zip(a[:first], b[:first]), *zip(a[len(a) - last :], b[len(b) - last :])]
        stack, q = [(first, len(a) - last, first, len(b) - last)], np.array(q, np.int64)
        while stack:
            i, j, k, n = stack.pop()
            if i == j or k == n:
                continue
            if j - i == 1:
                w = self.weights(p[i], q[k:n])
                if w.max():
                    out.append((a[i], b[k + int(w.argmax())]))
                continue
            m = (i + j) // 2
            both = self.rows(p[i:m], q[k:n]) + self.rows(p[m:j][::-1], q[k:n][::-1])[::-1]
            cut_at = k + int(both.argmax())
            stack += [(i, m, k, cut_at), (m, j, cut_at, n)]
        return out

    def align(self, page: Slot) -> list[tuple[int, Slot]]:
        """(seed node, page slot) of all matched nodes."""
        if len(self.shapes) > 100_000:
            self.__init__(self.seed)
        self.sort(page)
        self.size(self.seed.kind, page.kind)
        out, stack = [], [(self.seed, page)]
        while stack:
            a, b = stack.pop()
            out.append((a.number, b))
            if a.kind == b.kind:
                stack += zip(a.children, b.children)
            elif a.children and b.children:
                for x in {c.kind for c in a.children}:
                    for y in {c.kind for c in b.children}:
                        if (x, y) not in self.memo and self.shapes[x][0] == self.shapes[y][0]:
                            self.size(x, y)
                stack += self.pairs(a.children, b.children)
        return out


class Wrapper:
    """Of a host: the seed to align with, the region, constant nodes of the region, and menus."""

    def __init__(self, spec: str, votes: list[dict]):
        """votes: node, n (bodies), text (the most common), same (bodies that have it), chars, links."""
        seed = numbered(json.loads(spec))
        self.matching = Matching(seed)
        self.votes = {v["node"]: v for v in votes}
        self.region = self.find(seed)
        slots = count(seed)
        inner = {s.number for s in slots[self.region : self.region + slots[self.region].size]} if self.region is not None else {s.number for s in slots}
        self.constant = {k: v["text"] for k, v in self.votes.items() if k in inner and v["n"] >= LEAST and self.same(k) and k != self.region}
        self.menus = {s.number for s in slots if s.number in inner and s.number in self.votes and s.tag not in LEAVES and self.linked(s.number) and s.number != self.region}

    def same(self, node: int) -> bool:
        return self.votes[node]["same"] >= CONSTANT * self.votes[node]["n"]

    def linked(self, node: int) -> bool:
        v = self.votes[node]
        return v["n"] >= BODIES and v["links"] >= MENU * max(1, v["chars"] + v["links"])

    def varies(self, slot: Slot) -> bool:
        """Whether a heading or block that stands for itself is not the same on all pages."""
        return slot.number in self.votes and self.votes[slot.number]["chars"] > 0 and not self.same(slot.number)

    def find(self, seed: Slot) -> int | None:
        """The number of the node that holds the content; None if no container stands out."""
        at = seed
        mass = lambda s: self.votes[s.number]["chars"] if s.number in self.votes else 0
        while at.tag not in ("article", "main"):
            inner = [c for c in at.children if c.tag not in LEAVES and c.tag != "h1" and c.number in self.votes]
            best = max(inner, key=mass, default=None)
            if best is None or mass(best) < REGION * max(1, mass(at)):
                break
            rest = [c for c in at.children if c is not best]
            if any(c.tag in LEAVES and self.varies(c) for c in rest) or any(s.tag == "h1" and self.varies(s) for c in rest for s in _below(c)):
                break
            at = best
        return None if at.tag in ("#root", "html", "body") else at.number


def _below(slot: Slot) -> list[Slot]:
    out = [slot]
    for s in out:
        out += s.children
    return out


def content(html: str, wrapper: Wrapper | None) -> str:
    """Main text of a page, given its host's wrapper."""
    tree = parse(html)
    start, left_out, inside = [tree], set(), False
    if wrapper is not None:
        for number, slot in wrapper.matching.align(fold(tree)):
            if number == wrapper.region:
                start, inside = slot.nodes, True
            elif number in wrapper.menus or number in wrapper.constant and wrapper.constant[number] == slot.said():
                left_out.update(id(n) for n in slot.nodes)
    return "\n\n".join(blocks([r for node in start for r in roots(node)], left_out, inside))


# -- the operator ------------------------------------------------------------


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    pages = clean_names(pages, page_id=id_col, url=url_col, html=html_col)
    ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.withColumn("host", host)
    wrapper = wrappers(pages)
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def texts(batches):
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            for part in cut(batch, ["html"]):
                ids, urls, hosts, htmls, specs, votes = (part.column(k) for k in range(6))
                out = []
                for k, (name, html) in enumerate(zip(hosts.to_pylist(), htmls.to_pylist())):
                    if name not in known:
                        if len(known) > 1000:
                            known.clear()
                        spec = specs[k].as_py()
                        known[name] = Wrapper(spec, votes[k].as_py()) if spec else None
                    out.append(content(html, known[name]) if html else "")
                yield table(schema, {"page_id": ids, "url": urls, "text": out, "n_chars": [len(t) for t in out]})

    joined = pages.join(wrapper, "host", "left").select("page_id", "url", "host", "html", "seed", "votes")
    return joined.mapInArrow(texts, schema)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, seed, votes) of each host with BODIES distinct bodies and more; pages: host, url, html."""

    def seeds(batches):
        best: dict[tuple[str, int], list] = {}
        for batch in batches:
            for name, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not html:
                    continue
                rank = xxhash.xxh64_intdigest(f"{url}\0{html}") >> 1
                spec = shape(fold(parse(html)))
                key = name, xxhash.xxh64_intdigest(json.dumps([x for x in spec if x[0].partition(" ")[0] not in LEAVES])) >> 1
                held = best.setdefault(key, [0, rank, spec])
                held[0] += 1
                if rank < held[1]:
                    held[1:] = rank, spec
            if len(best) > 2000:
                yield from told(best)
        yield from told(best)

    def told(best):
        if best:
            yield table("host string, layout bigint, n bigint, rank bigint, seed string", {"host": [k[0] for k in best], "layout": [k[1] for k in best], "n": [x[0] for x in best.values()], "rank": [x[1] for x in best.values()], "seed": [json.dumps(x[2]) for x in best.values()]})
            best.clear()

    found = pages.select("host", "url", "html").mapInArrow(seeds, "host string, layout bigint, n bigint, rank bigint, seed string")
    # the seed's number of bytes doesn't depend on the number of pages
    layouts = found.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.min(F.struct("rank", "seed")).alias("first"))
    seed = written(layouts.groupBy("host").agg(F.max_by("first.seed", F.struct("n", -F.col("first.rank"))).alias("seed")), "seeds")

    votes_schema = "host string, body bigint, nodes array<bigint>, texts array<bigint>, chars array<bigint>, links array<bigint>"

    def votes(batches):
        known: dict[str, Matching] = {}
        for batch in batches:
            rows = []
            for name, html, spec in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = Matching(numbered(json.loads(spec)))
                page = fold(parse(html))
                pairs = known[name].align(page)
                rows.append((name, page.said(), [n for n, _ in pairs], *([f(s) for _, s in pairs] for f in (Slot.said, Slot.chars, Slot.links))))
            yield table(votes_schema, dict(zip(("host", "body", "nodes", "texts", "chars", "links"), zip(*rows)))) if rows else empty(votes_schema)

    with_html = pages.filter("html is not null and html <> ''")
    cast = written(with_html.select("host", "html").join(seed, "host").select("host", "html", "seed").mapInArrow(votes, votes_schema).dropDuplicates(["host", "body"]), "votes")
    hosts = cast.groupBy("host").agg(F.count("*").alias("bodies")).filter(F.col("bodies") >= BODIES).select("host")
    each = cast.select("host", F.explode(F.arrays_zip("nodes", "texts", "chars", "links")).alias("v"))
    texts = each.groupBy("host", F.col("v.nodes").alias("node"), F.col("v.texts").alias("text")).agg(F.count("*").alias("n"), F.sum("v.chars").alias("chars"), F.sum("v.links").alias("links"))
    nodes = texts.groupBy("host", "node").agg(F.sum("n").alias("n"), F.max_by("text", F.struct("n", "text")).alias("text"), F.max("n").alias("same"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    # as many votes as the seed has nodes
    told_by = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "n", "text", "same", "chars", "links")).alias("votes"))
    return written(seed.join(hosts, "host").join(told_by, "host"), "wrappers")
