"""BPE encoding and decoding (6), and token counts (9).

Ids come from the rank queue and linked symbol list in bpe.py; decoding
concatenates the vocabulary strings. Both are maps over rows: no shuffle, no
state beyond a bounded cache of pre-tokens in each worker.

Nulls and empty texts have no ids, decode to the empty string and count 0.
Repeated rows give repeated results; an empty table gives an empty one. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from kronograph.llm import bpe
from kronograph.llm.common import clean_names, map_rows


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): ids of each whole text as little-endian unsigned 32-bit integers."""

    def make():
        return lambda text: (bpe.load(tokenizer).encode(text or ""),)

    return map_rows(clean_names(docs, doc_id=id_col, text=text_col), ["text"], "doc_id bigint, ids binary", make, ["ids"])


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): texts of packed ids, with special tokens spelled out."""

    def make():
        return lambda ids: (bpe.load(tokenizer).decode(ids or b""),)

    return map_rows(clean_names(encoded, doc_id=id_col, ids=ids_col), ["ids"], "doc_id bigint, text string", make, ["text"])


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded in one pass."""

    def make():
        def both(text):
            codec = bpe.load(tokenizer)
            ids = codec.encode(text or "")
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

        return both

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(clean_names(docs, doc_id=id_col, text=text_col), ["text"], schema, make, ["n_tokens", "ids_sha256", "decoded_sha256"])
