"""Packing (1): first-fit decreasing by a tournament tree, in randomised groups.

Each document becomes its token ids and a final separator. A document longer
than a sequence is cut into full pieces and a rest. Documents are dealt at
random (by their place in the input, never by a column, so that no key can make
a group large) into groups of about GROUP_DOCS; within each group the pieces go,
longest first, each to the first bin with room. A tournament tree over the
bins' free space finds that bin in logarithmic time. A full piece is a sequence
of its own. The ids move with their pieces: sequences() gives the packed ids,
padded, and pack() reads the pieces back from them.

The tokens come from a library that merges by the ranks of the tokenizer file;
where the file's ids don't follow its merges, from the tokenizers library.

A null or empty text is one piece that holds just the separator. Repeated rows
are packed as often as they occur; ties are broken by length, document and
start. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kronograph.llm import bpe
from kronograph.llm.common import OUT_BYTES, clean_names, cut, released, ship, table

#: Tokens of a sequence, the separator's id, and documents of a group.
SEQUENCE, SEPARATOR, GROUP_DOCS = 2048, 1, 2048

#: Fills a sequence after its last piece; the sequence's length tells it from ids of texts.
PADDING = 0

#: Bytes of padded ids that are laid out at once.
BLOCK_BYTES = 2 << 20


class BinTree:
    """Tournament tree: each node holds the largest free space of the bins below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.size)

    def take(self, length: int) -> int:
        """The first bin with that much room; its room shrinks."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < length:
                node += 1
        found = node - self.size
        best[node] -= length
        node //= 2
        while node:
            a, b = best[2 * node], best[2 * node + 1]
            best[node] = a if a > b else b
            node //= 2
        return found


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; the pieces are placed longest first, equal lengths in the given order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == room).sum())
    bins[order[:full]] = np.arange(full)
    if n > full:
        tree, used = BinTree(n - full, room), [0] * (n - full)
        for i in order[full:].tolist():
            length = int(lengths[i])
            b = tree.take(length)
            bins[i], offsets[i] = full + b, used[b]
            used[b] += length
    return bins, offsets


@lru_cache(maxsize=2)
def tokens(path: str):
    """text to its ids, as the tokenizers library gives them for that file."""
    import tiktoken

    codec = bpe.ByteBPE(path)  # not kept: the library has tables of its own
    ranks, special = codec.ranks(), set(codec.special)
    if ranks is not None:
        own = tiktoken.Encoding("packing", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=codec.special)
        return lambda text: own.encode_to_numpy(text, allowed_special=special, disallowed_special=())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


def laid_out(t: pa.Table, at: np.ndarray, sequence: int, padding: int) -> Iterator[pa.RecordBatch]:
    """Sequences of pieces that are in the order of their sequences' ids and their place there; at: the sequence's id of each."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    step = max(1, BLOCK_BYTES // (4 * sequence))
    for k in range(0, len(first), step):
        heads = first[k : k + step]
        lo, hi = heads[0], first[k + step] if k + step < len(first) else len(at)
        part, heads = t.slice(lo, hi - lo).combine_chunks(), heads - lo
        ids = np.frombuffer(b"".join(part["ids"].to_pylist()), "<u4")
        lengths = pc.binary_length(part["ids"]).to_numpy().astype(np.int64) // 4
        used = np.add.reduceat(lengths, heads)
        width = np.where(used & (used - 1) == 0, used, sequence)
        ends = np.cumsum(width)
        padded = np.full(ends[-1], padding, np.int32)
        padded[np.repeat(ends - width - np.cumsum(used) + used, used) + np.arange(len(ids))] = ids
        bounds = pa.array(np.append(heads, hi - lo), pa.int32())
        each = {to: pa.ListArray.from_arrays(bounds, part[c].combine_chunks()) for to, c in (("doc_ids", "doc_id"), ("starts", "start"), ("doc_tokens", "doc_tokens"))}
        each |= {"lengths": pa.ListArray.from_arrays(bounds, pa.array(lengths)), "ids": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(padded))}
        yield table(SEQUENCES, each | {"sequence_id": pa.array(at[lo:hi][heads]), "length": pa.array(used)})


#: A packed sequence: its ids with padding, how many of them are no padding, and its pieces in order.
SEQUENCES = "sequence_id bigint, length bigint, ids array<int>, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, doc_tokens array<bigint>"


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, separator: int = SEPARATOR, group_docs: int = GROUP_DOCS, padding: int = PADDING) -> DataFrame:
    """One row per packed sequence (SEQUENCES). ids are padded to the full length, except where their number is a power of two.

    sequence_id is unique over all groups: the group's number times 2**32, plus
    the bin; full pieces count on from the number of groups, by the task that
    cut them. The number of groups follows the number of rows.
    """
    return _packed(docs, lambda batches: batches, SEQUENCES, tokenizer, id_col, text_col, sequence, separator, group_docs, padding)


def _packed(docs: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tokenizer: str, id_col: str, text_col: str, sequence: int, separator: int, group_docs: int, padding: int) -> DataFrame:
    """What read makes of the packed sequences (SEQUENCES), in the process that packs them: padded ids needn't go to another one."""
    docs = clean_names(docs, doc_id=id_col, text=text_col)
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    pieces_schema = "grp bigint, sequence_id bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary"

    def pieces(batches):
        encode, task, full = tokens(tokenizer), TaskContext.get().partitionId(), 0
        dealt = np.random.default_rng(task)
        names = ("grp", "sequence_id", "doc_id", "start", "doc_tokens", "ids")
        for batch in batches:
            for part in cut(batch, ["text"]):
                out, size = [], 0
                at = dealt.integers(0, groups, part.num_rows).tolist()
                for group, doc_id, text in zip(at, part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(np.asarray(encode(text), np.dtype("<u4")), np.array([separator], "<u4")) if text else np.array([separator], "<u4")
                    for k, start in enumerate(range(0, len(ids), sequence)):
                        piece = ids[start : start + sequence]
                        own = None
                        if len(piece) == sequence:
                            own, full = ((groups + task) << 32) + full, full + 1
                        # a long document's pieces go to one group after the other
                        out.append(((group + k) % groups, own, doc_id, start, len(ids), piece.tobytes()))
                        size += 4 * len(piece)
                        if size > OUT_BYTES:
                            yield table(pieces_schema, dict(zip(names, zip(*out))))
                            out, size = [], 0
                if out:
                    yield table(pieces_schema, dict(zip(names, zip(*out))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rests = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            full = t.filter(pc.is_valid(t["sequence_id"]))
            if full.num_rows:
                yield from laid_out(full, full["sequence_id"].to_numpy(), sequence, padding)
            rests.append(t.filter(pc.is_null(t["sequence_id"])))
        t = pa.concat_tables(rests)
        if t.num_rows:
            t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
            bins, offsets = first_fit_decreasing(pc.binary_length(t["ids"]).to_numpy().astype(np.int64) // 4, sequence)
            order = np.lexsort((offsets, bins))
            yield from laid_out(t.take(order), (t["grp"].to_numpy() << 32) + bins[order], sequence, padding)

    def packed_and_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read(packed(batches))

    return docs.mapInArrow(released(pieces), pieces_schema).groupBy("grp").applyInArrow(packed_and_read, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, separator: int = SEPARATOR, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; read back from the packed sequences."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def read_back(batches):
        for batch in batches:
            for part in cut(batch, ["ids"]):
                c = {f.name: part.column(i) for i, f in enumerate(part.schema)}
                ids = c["ids"].flatten().to_numpy().astype("<u4")
                lengths = c["lengths"].flatten().to_numpy()
                pieces = pc.list_value_length(c["lengths"]).to_numpy()
                offsets = np.cumsum(lengths) - lengths
                heads = np.cumsum(pieces) - pieces
                offsets -= np.repeat(offsets[heads], pieces)
                width = pc.list_value_length(c["ids"]).to_numpy().astype(np.int64)
                at = np.repeat(np.cumsum(width) - width, pieces) + offsets
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), lengths.tolist())]
                each = {to: c[f].flatten() for to, f in (("doc_id", "doc_ids"), ("start", "starts"), ("length", "lengths"), ("doc_tokens", "doc_tokens"))}
                yield table(schema, each | {"ids_crc32": crc, "sequence_id": pa.array(np.repeat(c["sequence_id"].to_numpy(), pieces)), "offset": pa.array(offsets)})

    return _packed(docs, read_back, schema, tokenizer, id_col, text_col, sequence, separator, group_docs, PADDING)
