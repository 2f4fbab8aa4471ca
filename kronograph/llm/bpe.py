"""Byte-level BPE by rank queue and linked symbol list; no Spark in here.

A text is cut into pre-tokens, a pre-token into its UTF-8 bytes. The bytes form
a doubly linked list of symbols. A heap holds every adjacent pair that the
vocabulary can merge, lowest rank first and leftmost first among equal ranks;
an entry whose symbols have changed since it was pushed is stale and skipped.
Results of pre-tokens are kept in a bounded cache, so frequent words are merged
once for each worker.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import lru_cache

import regex

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a cache of pre-tokens before it is emptied (about 200 bytes each);
#: chunks, which repeat less, get half as many.
CACHE_ENTRIES = 600_000

#: Code points of a long text that are handled at once.
PIECE_CHARS = 1 << 20


def byte_symbols() -> dict[str, int]:
    """Printable stand-in character of each byte, as byte-level vocabularies spell them."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Cache(dict):
    """Key to result; emptied when it reaches its bound."""

    def __init__(self, make, bound: int = CACHE_ENTRIES):
        super().__init__()
        self._make, self._bound = make, bound

    def __missing__(self, key):
        if len(self) >= self._bound:
            self.clear()
        out = self[key] = self._make(key)
        return out


class Chunked:
    """Results of a text's chunks, in order and through a cache.

    No pre-token spans a space that is followed by another character than white
    space from the left, so a text may be cut before every such space. A chunk
    is cached without its leading space; the first chunk of a text has none.
    """

    _cut, _odd, _far = regex.compile(r" (?=\S)"), regex.compile(r" (?:\s|$)"), regex.compile(r"\S \S")

    def __init__(self, make):
        self._first = _Cache(make, CACHE_ENTRIES // 8)
        self._later = _Cache(lambda chunk: make(" " + chunk), CACHE_ENTRIES // 2)

    def __call__(self, text: str):
        """Lists of results; a long text is cut into pieces first."""
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > PIECE_CHARS:
                found = self._far.search(text, at + PIECE_CHARS)
                end = found.start() + 1 if found else n
            piece = text if end - at == n else text[at:end]
            chunks = self._cut.split(piece) if self._odd.search(piece) else piece.split(" ")
            if chunks[0]:  # else the piece begins with a space to cut at
                yield (self._first[chunks[0]],)
            del chunks[0]
            yield map(self._later.__getitem__, chunks)
            at = end


class ByteBPE:
    """Vocabulary, merge ranks and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_symbols()
        vocab = model["vocab"]
        as_bytes = lambda token: bytes(chars[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        #: bytes of each id, for decoding
        self.spelled = [b""] * size
        for token, i in vocab.items():
            self.spelled[i] = token.encode() if token in self.special else as_bytes(token)
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        #: (left id, right id) to (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self._words = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._ids = _Cache(lambda w: array("I", self.merge(w)).tobytes())
        self._counts = _Cache(self.merge_count)
        self._ids_by_chunk = Chunked(self._ids_of)
        self._counts_by_chunk = Chunked(self._count_of)

    # -- merging ---------------------------------------------------------

    def _queue(self, symbols: list[int]) -> list[tuple[int, int, int, int]]:
        merges, queue = self.merges, []
        for i in range(len(symbols) - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        return queue

    def _merged(self, symbols: list[int]) -> int:
        """Merge in place; merged-away places become -1. Returns the number of merges."""
        merges, n, done = self.merges, len(symbols), 0
        queue = self._queue(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            made = symbols[i] = merges[left, right][1]
            symbols[j] = -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                found = merges.get((made, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, made, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], made))
                if found:
                    heapq.heappush(queue, (found[0], h, symbols[h], made))
        return done

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        of_byte = self.of_byte
        symbols = [of_byte[b] for b in word.encode()]
        self._merged(symbols)
        return [s for s in symbols if s >= 0]

    def merge_count(self, word: str) -> int:
        """Tokens of one pre-token: initial symbols less merges."""
        of_byte = self.of_byte
        symbols = [of_byte[b] for b in word.encode()]
        return len(symbols) - self._merged(symbols)

    # -- texts -----------------------------------------------------------

    def words(self, text: str):
        """(pre-token, special id or None) of a text, in order."""
        if self._special is None or not any(t in text for t in self.special):
            return [(w, None) for w in self._words.findall(text)]
        out = []
        for k, run in enumerate(self._special.split(text)):
            out += [(run, self.special[run])] if k % 2 else [(w, None) for w in self._words.findall(run)]
        return out

    def _ids_of(self, chunk: str) -> bytes:
        get = self._ids.__getitem__
        return b"".join(get(w) if i is None else i.to_bytes(4, "little") for w, i in self.words(chunk))

    def _count_of(self, chunk: str) -> int:
        get = self._counts.__getitem__
        return sum(get(w) if i is None else 1 for w, i in self.words(chunk))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(x for part in self._ids_by_chunk(text) for x in part)

    def count(self, text: str) -> int:
        """Tokens of a text; no ids are made."""
        return sum(x for part in self._counts_by_chunk(text) for x in part)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids: the vocabulary strings, concatenated."""
        return b"".join(map(self.spelled.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")

    def ranks(self) -> dict[bytes, int] | None:
        """Spelling to id, where the ids of merges follow their order; else None.

        Then a rank table alone describes the vocabulary, and a library that
        merges by such a table gives the same ids.
        """
        made = [m for _, m in self.merges.values()]
        if made != list(range(made[0], made[0] + len(made))) or max(self.of_byte) >= made[0]:
            return None
        return {self.spelled[i]: i for i in [*self.of_byte, *made]}


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """The tokenizer at path, once for each worker process."""
    return ByteBPE(path)
