r"""Chat formatting (8): token-level assembly.

Each turn's role and text are escaped and encoded separately; reserved ids that
no text can produce are spliced between them. The loss mask is the running sum
of +1 and -1 at the borders of what assistants say.

The template of a turn is <|turn|> role <|text|> text <|end|>. A control string
that occurs in a role or text gets a backslash after its first character (one
more, if it has some there already), which takes it out of the tokenizer's and
the template's reach; reading back takes that backslash away again.

Encoding is done on rows, before the turns of a conversation are brought
together; a row of the result is a turn, so a conversation of any length is
never one value. Null roles and texts count as empty, null conversation ids are
one conversation; turns with equal numbers are ordered by role and text;
repeated rows repeat; empty tables stay empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.llm import bpe
from kronograph.llm.common import clean_names, cut, map_rows, ship, shuffle_partitions, table

#: The template's marks, and other control strings that texts may hold.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
CONTROL = (*MARKS, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def assembled(role: str, text: str, codec: bpe.ByteBPE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    turn, start, end = (len(codec.spelled) + k for k in range(3))
    a, b = (np.frombuffer(codec.encode(escape(t)), "<u4") for t in (role, text))
    ids = np.concatenate([[turn], a, [start], b, [end]]).astype("<u4")
    change = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        change[len(a) + 2] += 1
        change[len(a) + 2 + len(b)] -= 1
    return ids, np.cumsum(change[:-1]).astype(np.uint8)


def format_turns(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, ids binary, mask binary, order string): each turn, ready to be strung together by turn and order."""

    def make():
        def one(role, text):
            ids, mask = assembled(role or "", text or "", bpe.load(tokenizer))
            return ids.tobytes(), mask.tobytes(), f"{role or ''}\n{text or ''}"

        return one

    rows = clean_names(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return map_rows(rows, ["role", "text"], "conv_id bigint, turn bigint, ids binary, mask binary, order string", make, ["ids", "mask", "order"])


class ReadBack:
    """Digests of one conversation, read from its ids and mask alone; takes a turn at a time."""

    def __init__(self, codec: bpe.ByteBPE):
        self.codec, self.turns, self.loss, self.chars, self.n, self.loss_chars = codec, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, packed: bytes, masked: bytes) -> None:
        ids, mask, first = np.frombuffer(packed, "<u4"), np.frombuffer(masked, np.uint8), len(self.codec.spelled)
        marks = np.flatnonzero(ids >= first)
        if (ids[marks] - first).tolist() != [0, 1, 2] * (len(marks) // 3) or len(marks) % 3:
            raise ValueError("marks are out of order")
        for t, s, e in marks.reshape(-1, 3).tolist():
            role, text = (self.codec.decode(ids[a + 1 : b].tobytes()) for a, b in ((t, s), (s, e)))
            self.n += 1
            self.chars += sum(map(len, MARKS)) + len(role) + len(text)
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            text = unescape(self.codec.decode(ids[a:b].tobytes()))
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what format_turns() gave.

    A conversation's turns stream through one task in order; only running
    digests are held.
    """
    spark = turns.sparkSession
    ship(spark)
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = schema.replace(" bigint", "").replace(" string", "").split(", ")

    def run(batches):
        codec, out, now, state = bpe.load(tokenizer), [], None, None
        for batch in batches:
            for part in cut(batch, ["ids"]):
                for conv, ids, mask in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if state is None or conv != now:
                        if state is not None:
                            out.append((now, *state.row()))
                        now, state = conv, ReadBack(codec)
                    state.add(ids, mask)
                if out:
                    yield table(schema, dict(zip(names, zip(*out))))
                    out = []
        if state is not None:
            yield table(schema, dict(zip(names, zip((now, *state.row())))))

    dealt = turns.repartition(shuffle_partitions(spark), F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "order")
    return dealt.select("conv_id", "ids", "mask").mapInArrow(run, schema)
