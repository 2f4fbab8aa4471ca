"""Bi-temporal operators (T1-T9) on tables with valid_from, valid_to, created_at and expired_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source_id", "target_id", "relationship")


def snapshot(df: DataFrame, at: Column, known_at: Column | None = None) -> DataFrame:
    """Rows valid at a time: from valid_from on, before valid_to; optionally as the system knew it then."""
    out = df.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    if known_at is not None:
        out = out.filter((F.col("created_at") <= known_at) & (F.col("expired_at").isNull() | (known_at < F.col("expired_at"))))
    return out


def overlapping(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows whose closed validity meets the closed range (T2); open ends meet anything later."""
    return df.filter((F.col("valid_from") <= end) & (F.coalesce("valid_to", end) >= start))


def conflicts(edges: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Pairs of edges with one key whose closed validities overlap (T3): the key, edge1 before edge2, and the overlap.

    An equi-join on the key with an interval condition. Rows that no other row
    of their key can meet are dropped first by a window over the latest end so
    far and the next start, so only real candidates are joined.
    """
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    by = Window.partitionBy(*key).orderBy("valid_from", "id")
    end = F.coalesce("valid_to", far)
    marked = edges.select("id", *key, "valid_from", "valid_to").withColumns({
        "before": F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.lead("valid_from").over(by),
    })
    some = marked.filter((F.col("before") >= F.col("valid_from")) | (F.col("after") <= F.coalesce("valid_to", far))).drop("before", "after")
    a, b = some.alias("a"), some.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    order = (F.col("a.valid_from") < F.col("b.valid_from")) | ((F.col("a.valid_from") == F.col("b.valid_from")) & (F.col("a.id") < F.col("b.id")))
    meet = F.col("b.valid_from") <= F.coalesce("a.valid_to", far)
    least = F.least(F.coalesce("a.valid_to", far), F.coalesce("b.valid_to", far))
    return a.join(b, [*on, order, meet]).select(
        *(F.col(f"a.{k}") for k in key), F.col("a.id").alias("edge1"), F.col("b.id").alias("edge2"), F.col("b.valid_from").alias("overlap_start"), F.when(least < far, least).alias("overlap_end")
    )


def resolve(edges: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Edges with each validity cut where the next version of its key begins (T4, T6). Linear in the versions."""
    after = F.lead("valid_from").over(Window.partitionBy(*key).orderBy("valid_from", "created_at", "id"))
    return edges.withColumn("valid_to", F.least("valid_to", after))


def versions(edges: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Version number, successor's start and whether the version runs into it."""
    by = Window.partitionBy(*key).orderBy("valid_from", "id")
    after = F.lead("valid_from").over(by)
    return edges.withColumns({
        "version": F.row_number().over(by).cast("bigint"), "superseded_at": after,
        "conflicting": F.coalesce(after <= F.coalesce("valid_to", after), F.lit(False)),
    })


def expired(df: DataFrame, now: Column) -> DataFrame:
    """Rows whose validity ended strictly before now (T7); open validities never do."""
    return df.filter(F.col("valid_to") < now)


def invalidate(edges: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Set expired_at of the edges in ids, which has id and reason."""
    return edges.join(ids.select("id", "reason").dropDuplicates(["id"]), "id", "left").withColumn("expired_at", F.coalesce("expired_at", F.when(F.col("reason").isNotNull(), at)))


def recency_weight(score: Column, valid_from: Column, start: Column, end: Column) -> Column:
    """Scores of rows outside a time range count half."""
    return F.when(valid_from.between(start, end), score).otherwise(score * 0.5)


def merge_edges(edges: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One edge for all of a key: the least id, the sum of weights, from the first start to the last end, open if one is open."""
    end = F.when(F.bool_or(F.col("valid_to").isNull()), None).otherwise(F.max("valid_to"))
    return edges.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("merged"), F.sum("weight").alias("weight"), F.min("valid_from").alias("valid_from"), end.alias("valid_to"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """left with the given columns of right's last row of the same keys at the time or before; rows without one drop out.

    One union and one sort by key and time, not a join of all pairs; of rows of
    one time that with the largest columns counts.
    """
    a = left.select("*", F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_found"), F.lit(1).alias("_asks"))
    b = right.select(*keys, time, F.struct(*columns).alias("_found"), F.lit(0).alias("_asks"))
    by = Window.partitionBy(*keys).orderBy(time, "_asks", "_found").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_found", ignorenulls=True).over(by))
    return rows.filter("_asks = 1 and _found is not null").select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in columns))


def contradictions(edges: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys with edges that are valid from one time on and say different things, with how many (T9: content conflict)."""
    return edges.groupBy(*key, "valid_from").agg(F.count_distinct("properties", "weight").alias("contents"), F.min("id").alias("first")).filter("contents > 1")


def version_conflicts(edges: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Edges that the system learned later than their successor in event time (T9: version conflict)."""
    by = Window.partitionBy(*key).orderBy("valid_from", "id")
    return edges.withColumn("_next", F.lead("created_at").over(by)).filter(F.col("created_at") > F.col("_next")).drop("_next")
