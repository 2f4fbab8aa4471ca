"""Places where models and services plug in (H2-H13, O5): plain functions of texts, run in Arrow batches on the executors.

A provider is a function from a list of texts to a list of answers. It may raise;
then it is tried again, and after that the next provider gets the texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from kronograph.operators.search import lexical_score
from kronograph.sources.shared import Written, written

Provider = Callable[[list[str]], list]


def answered(df: DataFrame, text_col: str, providers: dict[str, Provider], attempts: int = 3, kind: str = "string") -> DataFrame:
    """df with answer, provider and tries of the first provider that succeeds on a batch; nulls where none does.

    Null texts have no answer and are not sent.
    """
    passed = df.drop("answer", "provider", "tries")
    schema = StructType([*passed.schema.fields, *StructType.fromDDL(f"answer {kind}, provider string, tries int").fields])
    at = passed.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sent = [t for t in texts if t is not None]
            found, who, tries = iter([None] * len(sent)), None, 0
            for name, provider in providers.items() if sent else ():
                for _ in range(attempts):
                    tries += 1
                    try:
                        got = list(provider(sent))
                    except Exception:  # the provider's failure, whatever it is: try again, then the next one
                        continue
                    if len(got) == len(sent):
                        found, who = iter(got), name
                        break
                if who is not None:
                    break
            answers = [None if t is None else next(found) for t in texts]
            new = [pa.array(answers), pa.array([None if t is None else who for t in texts], pa.string()), pa.array([tries] * len(texts), pa.int32())]
            if pa.types.is_null(new[0].type):
                new[0] = new[0].cast(to_arrow_type(schema["answer"].dataType))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return passed.mapInArrow(run, schema)


def embedded(df: DataFrame, text_col: str, embed: Callable[[Column], Column], known: DataFrame | None = None, name: str = "embedding") -> DataFrame:
    """df with an embedding of each text; each distinct text is embedded once, and not at all if known (text, embedding) has it."""
    texts = df.select(F.col(text_col).alias("_text")).filter("_text is not null").distinct()
    if known is not None:
        had = known.select(F.col("text").alias("_text"), F.col("embedding").alias(name))
        new = texts.join(had.select("_text"), "_text", "left_anti").select("_text", embed(F.col("_text")).alias(name))
        vectors = texts.join(had, "_text").unionByName(new)
    else:
        vectors = texts.select("_text", embed(F.col("_text")).alias(name))
    return df.join(vectors, F.col(text_col) == F.col("_text"), "left").drop("_text")


def reranked(hits: DataFrame, query: str, limit: int, score: Callable[[str, Column], Column] = lexical_score, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, score): hits by a cross-encoder's score of query and text, the lexical score where none is given (H4)."""
    return hits.select(F.col(id_col).alias("id"), score(query, F.col(text_col)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def degraded(fresh: DataFrame, last_good: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, stale): fresh values, and the last good ones where they are missing."""
    old = last_good.select(key, F.col(value).alias("_old"))
    joined = fresh.select(key, value).join(old, key, "full")
    return joined.select(key, F.coalesce(value, "_old").alias(value), (F.col(value).isNull() & F.col("_old").isNotNull()).alias("stale"))


def hooked(events: DataFrame, before: list[Callable[[DataFrame], DataFrame]], act: Callable[[DataFrame], DataFrame], after: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Tool calls through hooks: each before hook, the call, each after hook, as one plan."""
    for hook in (*before, act, *after):
        events = hook(events)
    return events


def task_levels(tasks: DataFrame, needs: DataFrame, most: int = 1000) -> DataFrame:
    """(id, level): the round in which each task can run, 0 without needs (H11). needs: id, needed. Tasks on a cycle have no row.

    One round of joins for each level; a round is written to the shared folder.
    """
    # what isn't a task can't hold one up
    open_ = Written(needs.select("id", "needed").join(tasks.select(F.col("id").alias("needed")), "needed", "left_semi").distinct(), "needs")
    rest = Written(tasks.select("id").distinct(), "tasks")
    out = None
    for level in range(most):
        ready = written(rest.read().join(open_.read().select("id"), "id", "left_anti").select("id", F.lit(level).cast("bigint").alias("level")), "level")
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        done = ready.select("id")
        after_rest = Written(rest.read().join(done, "id", "left_anti"), "tasks")
        after_open = Written(open_.read().join(done.withColumnRenamed("id", "needed"), "needed", "left_anti"), "needs")
        rest.drop()
        open_.drop()
        rest, open_ = after_rest, after_open
    return out if out is not None else tasks.select("id", F.lit(0).cast("bigint").alias("level")).limit(0)


def within_budget(tasks: DataFrame, order: list[str], cost: str, budget: float) -> DataFrame:
    """Tasks with a column runs: whether the costs up to and with it stay within the budget, in order.

    One running total over all tasks: a sort in one task, for queues of tasks, not for corpora.
    """
    from pyspark.sql import Window

    return tasks.withColumn("runs", F.sum(cost).over(Window.orderBy(*order)) <= budget)
