"""Token counts (9): initial symbols less merges, with no ids emitted.

Each pre-token's bytes are merged by repeatedly popping the lowest-rank
adjacent pair from a heap over a linked list (bpe.py); the count is the number
of bytes less the number of merges. A special token's string counts as one.

Null and empty texts count 0; repeated rows repeat; an empty table stays empty;
columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kronograph.llm import bpe
from kronograph.llm.common import clean_names, map_rows


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text."""

    def make():
        def one(text):
            n = bpe.load(tokenizer).count(text) if text else 0
            return len(text.encode()) if text else 0, n, n > limit

        return one

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_rows(clean_names(docs, doc_id=id_col, text=text_col), ["text"], schema, make, ["n_bytes", "n_tokens", "over_limit"])
