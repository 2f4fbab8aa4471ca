"""Vector functions (F20-F22): built-in array expressions, in double precision; hashing embeddings by Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for zero vectors and unequal lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    """Unit vector; zero vectors stay."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def fitted(a: Column, dimension: int) -> Column:
    """Cut or padded with zeros to a dimension."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)


def hashing_embedding(dimension: int = 64):
    """Arrow function text -> unit vector: byte i adds b / 255 at i mod dimension."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            raw = np.frombuffer((text or "").encode(), np.uint8) / 255
            padded = np.zeros(-(-max(len(raw), 1) // dimension) * dimension)
            padded[: len(raw)] = raw
            v = padded.reshape(-1, dimension).sum(0)
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def token_projection(dimension: int = 64):
    """Arrow function token ids -> unit vector (F23): each id gives each place a fixed number in -1..1; an embedding is their mean.

    The numbers come from SplitMix64 of id x 2^32, the place and a constant, all combined by XOR.
    """
    u = np.uint64

    @F.pandas_udf("array<double>")
    def embed(ids: pd.Series) -> pd.Series:
        places = np.arange(dimension, dtype=u) ^ u(0xA5A55A5A12345678)

        def one(tokens):
            if tokens is None or not len(tokens):
                return [0.0] * dimension
            x = (np.asarray(tokens, u)[:, None] << u(32)) ^ places
            with np.errstate(over="ignore"):
                x = x + u(0x9E3779B97F4A7C15)
                x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
            low = (x ^ (x >> u(31))) & u(0xFFFFFFFF)
            v = (2.0 * (low.astype(np.float64) / 0xFFFFFFFF) - 1.0).mean(0)
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return ids.map(one)

    return embed
