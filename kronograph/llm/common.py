"""What the operators of this subpackage share: shipping the package, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronograph.sources.shared import Written, free_shuffles, written  # noqa: F401

#: Bytes of Arrow data that an operator hands back at once.
OUT_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_kronograph_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp())
    target = folder / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._kronograph_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system at its end: an idle worker keeps none of it from the next stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple]], names: list[str]) -> DataFrame:
    """Apply a function of some columns to each row, in Arrow batches.

    make() is called once for each task and gives the function; it takes the
    given columns' values of a row and gives the values for names. All columns
    of df that schema names besides are passed on.
    """
    ship(df.sparkSession)
    passed = [c for c in df.columns if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in cut(batch, columns):
                values = [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
                rows = [f(*row) for row in zip(*values)]
                out = list(zip(*rows)) if rows else [() for _ in names]
                yield table(schema, dict(zip(names, out)) | {c: part.column(part.schema.get_field_index(c)) for c in passed})

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, columns: Iterable[str], most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with no more than about that many bytes of Arrow data each."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


#: Arrow type of each SQL type used in schemas here.
TYPES = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32()}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow schema of 'name type, name type'."""
    fields = []
    for item in schema.split(","):
        name, kind = item.split()
        inner = kind[6:-1] if kind.startswith("array<") else None
        fields.append(pa.field(name, pa.list_(TYPES[inner]) if inner else TYPES[kind]))
    return pa.schema(fields)


def table(schema: str, columns: dict) -> pa.RecordBatch:
    """A batch of the named columns, in the schema's order and types."""
    kinds = arrow_schema(schema)
    made = []
    for f in kinds:
        c = columns[f.name]
        if isinstance(c, (pa.Array, pa.ChunkedArray)):
            made.append(c if c.type == f.type else c.cast(f.type))
        else:
            made.append(pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(made, schema=kinds)


def empty(schema: str) -> pa.RecordBatch:
    kinds = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in kinds], schema=kinds)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def clean_names(df: DataFrame, **kept: str) -> DataFrame:
    """Only the named columns, under the names the operator uses; all other columns, clashing or not, are left out."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in kept.items()))
