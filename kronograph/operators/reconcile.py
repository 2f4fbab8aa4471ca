"""Replica reconciliation (R1-R7) as aggregations."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.functions.text import place


def last_writer(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The version modified last."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def clock_winner(versions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the winner of a left fold by vector clocks (R2).

    A later version wins if some of its clocks are higher and none is lower;
    concurrent versions keep the earlier one. Each key streams through one task
    in order, which holds the winner so far.
    """

    def newer(a: dict, b: dict) -> bool:
        gaps = [b.get(n, 0) - a.get(n, 0) for n in {*a, *b}]
        return any(g > 0 for g in gaps) and not any(g < 0 for g in gaps)

    def run(batches):
        at, best = None, None
        for pdf in batches:
            out = []
            for k, o, names, ticks in zip(*(pdf[c] for c in (key, order, "names", "ticks"))):
                clock = dict(zip(names, ticks))
                if best is None or k != at:
                    if best is not None:
                        out.append((at, best[0]))
                    at, best = k, (o, clock)
                elif newer(best[1], clock):
                    best = o, clock
            yield pd.DataFrame(out, columns=[key, order])
        if best is not None:
            yield pd.DataFrame([(at, best[0])], columns=[key, order])

    rows = versions.select(key, order, F.map_keys("clock").alias("names"), F.map_values("clock").alias("ticks")).filter(F.col(key).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, versions.select(key, order).schema)


def ring_owner(keys: DataFrame, nodes: list[str], replicas: int) -> DataFrame:
    """(node, n): keys by owner on a consistent-hash ring (R7); the owner is the node of the next point, the first after the last.

    The ring has replicas points for each node, so it is a small constant; an
    Arrow function finds each key's next point by binary search.
    """
    points = sorted((int(hashlib.md5(f"{n}#{k}".encode()).hexdigest()[:15], 16), n) for n in nodes for k in range(replicas))
    at, owner = np.array([p for p, _ in points]), np.array([n for _, n in points])

    @F.pandas_udf("string")
    def find(h: pd.Series) -> pd.Series:
        return pd.Series(owner[np.searchsorted(at, h.to_numpy()) % len(owner)])

    return keys.groupBy(find(place(F.col("key"))).alias("node")).agg(F.count("*").alias("n"))
