"""File sources and sinks (S13-S18, W12-W13): source trees, JSON lines, vector files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronograph.functions.text import glob_pattern

#: Folders that a project listing leaves out.
SKIPPED = ("node_modules", "target", "build", "dist", "out")
CHUNK_SCHEMA = "id string, content string, relative_path string, start_line bigint, end_line bigint, file_extension string, language string"


def source_tree(spark: SparkSession, root: str, extensions: list[str], deny: list[str] = ()) -> DataFrame:
    """(path, length, modified, content) of a tree's text files (S13-S15); the content column is pruned where unused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder = r"/(\.[^/]+|" + "|".join(SKIPPED) + ")/"
    kept = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(extensions) & ~F.col("path").rlike(folder))
    if deny:
        kept = kept.filter(~reduce(lambda a, b: a | b, [F.col("path").rlike(glob_pattern("**/" + g)) for g in deny]))
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def changed_since(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files created or modified after their last scan."""
    return files.join(scanned.select("path", F.col("modified").alias("_seen")), "path", "left").filter(F.col("_seen").isNull() | (F.col("modified") > F.col("_seen"))).drop("_seen")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks stored as JSON lines (S16); blank lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).json(path).filter("id is not null")


def vector_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of {id: [numbers]} files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<float>>")).alias("id", "embedding"))


def append_vectors(df: DataFrame, path: str, dimension: int) -> None:
    """Append vectors of the right length; others fail the job."""
    checked = df.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit("wrong dimension"))))
    checked.write.mode("append").parquet(path)


def append_chunks(df: DataFrame, path: str) -> None:
    """Append chunks by collection, so that dropping a collection drops a folder."""
    df.write.mode("append").partitionBy("collection").parquet(path)


def safetensors(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(row, vector) of a matrix in safetensors files (S22): 8 bytes of header length, a JSON header, then the numbers.

    A file is one row of a binary scan, so it has to fit into a task.
    """
    import json

    import numpy as np
    import pandas as pd

    kinds = {"F32": "<f4", "F64": "<f8", "F16": "<f2"}

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                n = int.from_bytes(raw[:8], "little")
                told = json.loads(raw[8 : 8 + n]).get(name)
                if told is None:
                    continue
                first, last = told["data_offsets"]
                data = raw[8 + n + first : 8 + n + last]
                if told["dtype"] == "BF16":  # the upper half of a 32-bit float
                    x = (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
                else:
                    x = np.frombuffer(data, kinds[told["dtype"]])
                x = x.reshape(told["shape"]).astype(np.float64)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pd.DataFrame({"row": np.arange(at, at + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row bigint, vector array<double>")
