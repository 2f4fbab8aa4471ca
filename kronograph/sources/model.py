"""The bi-temporal property graph as DataFrames (D1-D8), projected from the star-schema tables.

Four flat time columns stamp every row: created_at and expired_at are system
time, valid_from and valid_to event time; null ends are open. They stay
top-level columns, so predicates on them reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1992-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _stamped(df: DataFrame, valid_from=None, valid_to=None) -> DataFrame:
    start = ts(EPOCH) if valid_from is None else valid_from
    none = F.lit(None).cast("timestamp_ntz")
    return df.withColumns({"created_at": start, "valid_from": start, "valid_to": none if valid_to is None else valid_to, "expired_at": none})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, entity_type, labels, properties (JSON) and the time columns (D3)."""

    def one(name, prefix, key, label, kind, **properties):
        t = table(spark, sf_dir, name)
        made = t.select(
            F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("entity_type"),
            F.array(F.lit("Entity"), F.lit(kind)).alias("labels"), F.to_json(F.struct(*(F.col(c).alias(k) for k, c in properties.items()))).alias("properties"),
        )
        return _stamped(made)

    return reduce(
        DataFrame.unionByName,
        [
            one("region", "R", "r_regionkey", "r_name", "Region", region="r_regionkey"),
            one("nation", "N", "n_nationkey", "n_name", "Nation", region="n_regionkey"),
            one("customer", "C", "c_custkey", "c_name", "Customer", nation="c_nationkey", acctbal="c_acctbal", segment="c_mktsegment"),
            one("supplier", "S", "s_suppkey", "s_name", "Supplier", nation="s_nationkey", acctbal="s_acctbal"),
            one("part", "P", "p_partkey", "p_name", "Part", brand="p_brand", type="p_type", size="p_size", price="p_retailprice"),
        ],
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, episode_type, content, source and the time columns (D4): documents, messages and order events."""
    d = table(spark, sf_dir, "documents")
    documents = _stamped(d.select(F.concat(F.lit("D:"), "doc_id").alias("id"), F.concat(F.lit("doc "), "doc_id").alias("name"), F.lit("document").alias("episode_type"), F.col("text").alias("content"), "source"))
    c = table(spark, sf_dir, "conversations")
    message = c.select(F.concat(F.lit("M:"), "conv_id", F.lit(":"), "turn").alias("id"), F.concat(F.lit("conversation "), "conv_id").alias("name"), F.lit("message").alias("episode_type"), F.col("text").alias("content"), F.col("role").alias("source"), "turn")
    messages = _stamped(message, F.expr(f"timestamp_ntz '{EPOCH}' + make_interval(0, 0, 0, 0, 0, int(turn), 0)")).drop("turn")
    o = table(spark, sf_dir, "orders")
    order = o.select(F.concat(F.lit("O:"), "o_orderkey").alias("id"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.lit("event").alias("episode_type"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"), F.lit("orders").alias("source"), "o_orderdate")
    return documents.unionByName(messages).unionByName(_stamped(order, F.col("o_orderdate")).drop("o_orderdate"))


def edges(spark: SparkSession, sf_dir: str, *relationships: str) -> DataFrame:
    """id, source_id, target_id, relationship, weight, properties and the time columns (D7); only the named relationships are read."""

    def key(prefix, column):
        return F.concat(F.lit(f"{prefix}:"), column)

    def static(name, relationship, source, target):
        t = table(spark, sf_dir, name)
        made = t.select(F.concat(F.lit(f"{relationship}:"), source).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(relationship).alias("relationship"), F.lit(1.0).alias("weight"), F.lit("{}").alias("properties"))
        return _stamped(made)

    def lines():
        t = table(spark, sf_dir, "lineitem")
        serial = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
        return t.withColumn("serial", serial)

    def ordered():
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        made = lines().join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("ORDERED:"), "serial").alias("id"), key("C", "o_custkey").alias("source_id"), key("P", "l_partkey").alias("target_id"), F.lit("ORDERED").alias("relationship"),
            F.col("l_quantity").alias("weight"), F.to_json(F.struct(F.col("l_returnflag").alias("flag"))).alias("properties"), "o_orderdate",
        )
        return _stamped(made, F.col("o_orderdate")).drop("o_orderdate")

    def supplied():
        made = lines().select(
            F.concat(F.lit("SUPPLIED_BY:"), "serial").alias("id"), key("P", "l_partkey").alias("source_id"), key("S", "l_suppkey").alias("target_id"), F.lit("SUPPLIED_BY").alias("relationship"),
            F.col("l_quantity").alias("weight"), F.to_json(F.struct(F.col("l_returnflag").alias("flag"))).alias("properties"), "l_shipdate", "l_quantity", "l_linestatus",
        )
        end = F.expr("CASE WHEN l_linestatus <> 'O' THEN l_shipdate + make_dt_interval(int(l_quantity)) END")
        return _stamped(made, F.col("l_shipdate"), end).drop("l_shipdate", "l_quantity", "l_linestatus")

    made = {
        "IN_REGION": lambda: static("nation", "IN_REGION", key("N", "n_nationkey"), key("R", "n_regionkey")),
        "IN_NATION": lambda: static("customer", "IN_NATION", key("C", "c_custkey"), key("N", "c_nationkey")).unionByName(static("supplier", "IN_NATION", key("S", "s_suppkey"), key("N", "s_nationkey"))),
        "ORDERED": ordered,
        "SUPPLIED_BY": supplied,
    }
    return reduce(DataFrame.unionByName, [made[r]() for r in relationships or made])


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of the model and of the tables behind it, for SQL."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    entities(spark, sf_dir).createOrReplaceTempView("entities")
    episodes(spark, sf_dir).createOrReplaceTempView("episodes")
    edges(spark, sf_dir).createOrReplaceTempView("edges")
