"""Mutations as functions from tables to tables (W1-W16) and the scans beside them.

A table is an append-only log; its current state is the latest row of each key.
Deletes are anti-joins. All of it is one declarative plan, written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def adjacent(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges that leave (out), enter (in) or touch (both) a node."""
    out, into = F.col("source_id") == node, F.col("target_id") == node
    return edges.filter({"out": out, "in": into, "both": out | into}[direction])


def recent(edges: DataFrame, relationship: str, limit: int) -> DataFrame:
    """Newest edges of a relationship (S6); a top-k, not a sort."""
    return edges.filter(F.col("relationship") == relationship).orderBy(F.desc("created_at"), "id").limit(limit)


def prune_to(edges: DataFrame, limit: int) -> DataFrame:
    """The newest edges, up to a number."""
    return edges.orderBy(F.desc("created_at"), "id").limit(limit)


def latest(log: DataFrame, key: list[str], by: str) -> DataFrame:
    """Current rows of an upsert log (W1, W2): one aggregation with partial sums, no window sort."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(by, *(c for c in rest if c != by))).alias("_row")).select(*key, "_row.*")


def kv_view(puts: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Last value put for each key."""
    return puts.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in ids."""
    return df.join(ids.select(key), key, "left_anti")


def first_per_signature(edges: DataFrame, signature: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """One edge, that with the least id, for each signature (W4); nulls are equal. Signatures in existing are left out."""
    names = [f"_s{k}" for k in range(len(signature))]
    marked = edges.select("*", *(s.alias(n) for s, n in zip(signature, names)))
    out = marked.groupBy(*names).agg(F.min_by(F.struct(*edges.columns), "id").alias("_row"))
    if existing is not None:
        old = existing.select(*(s.alias(f"_o{k}") for k, s in enumerate(signature)))
        same = [F.col(n).eqNullSafe(F.col(f"_o{k}")) for k, n in enumerate(names)]
        out = out.join(old, same, "left_anti")
    return out.select("_row.*")


def missing(candidates: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Candidates whose key no existing row has."""
    return candidates.join(existing.select(*key), key, "left_anti")


def transform(base: DataFrame, deletes: DataFrame, updates: DataFrame, adds: DataFrame, key: str = "id") -> DataFrame:
    """Deletes, then updates, then additions."""
    rest = [c for c in base.columns if c != key]
    new = updates.select(key, F.struct(*(c for c in updates.columns if c != key)).alias("_new"))
    changed = without(base, deletes, key).join(new, key, "left")
    fields = [c for c in updates.columns if c != key]
    cols = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rest]
    return changed.select(key, *cols).unionByName(adds.select(*base.columns))


def batch_result(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """Number, failures and success rate in percent of each batch."""
    n, f = F.count("*"), F.count_if(failed)
    return df.groupBy(*by).agg(n.alias("n"), f.alias("failed"), F.round((n - f) * 100.0 / n, 6).alias("success_rate"))


def remove_paths(df: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """Rows of other files."""
    return df.filter(~F.col(column).isin(paths))


def point_id(text: Column) -> Column:
    """First 16 hexadecimal digits of the md5, as an unsigned number."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10)


def compact(spark: SparkSession, source: str, target: str, files: int, sort: list[str]) -> None:
    """Rewrite a Parquet table in fewer files, clustered for scans."""
    spark.read.parquet(source).repartitionByRange(files, *sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(target)


def line_edit(text: Column, first: int, last: int, lines: list[str]) -> Column:
    """Lines first..last (from 1) replaced by others."""
    parts = F.split(text, "\n", -1)
    return F.array_join(F.concat(F.slice(parts, 1, F.lit(first - 1)), F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>"), F.when(F.size(parts) > last, F.slice(parts, F.lit(last + 1), F.size(parts))).otherwise(F.array().cast("array<string>"))), "\n")
