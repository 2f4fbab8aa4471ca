"""Event-stream analytics (N1-N8, A12-A23, Z1-Z13, F35-F37, O2) on tables (user, ts, type, value); batch twins of the streaming forms."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: str, score: str, least: float, *order: str) -> DataFrame:
    """The first row of each key whose score reaches a threshold; lower rows don't count (N1, N2). One partial aggregation."""
    return df.filter(F.col(score) >= least).groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("_r")).select(key, "_r.*")


def recents(df: DataFrame, key: str, k: int, *order: Column | str) -> DataFrame:
    """At most k rows of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def trailing(df: DataFrame, key: str, seconds: int) -> DataFrame:
    """Rows of the key within the trailing time window, and their mean value."""
    by = Window.partitionBy(key).orderBy("t").rangeBetween(-seconds, 0)
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return df.withColumn("t", F.floor(t)).withColumns({"n": F.count("*").over(by), "mean": F.avg("value").over(by)}).drop("t")


def ema(df: DataFrame, key: str, keep: float, *order: str) -> DataFrame:
    """Exponential moving average of each key's values in order, from the first value on.

    The value k places from the end counts keep^k, the first one in full: ranks
    by a sort that spills, then a sum.
    """
    by = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    first = Window.partitionBy(key).orderBy(*order)
    ranked = df.select(key, "value", (F.row_number().over(by) - 1).alias("k"), (F.row_number().over(first) == 1).alias("first"))
    weight = F.pow(F.lit(keep), F.col("k")) * F.when(F.col("first"), 1.0).otherwise(1 - keep)
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("value") * weight).alias("ema"))


def sessions(df: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions that a pause of more than the gap ends; exactly the gap still belongs."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    out = df.groupBy(key, w.alias("w")).agg(F.count("*").alias("actions"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("value").alias("value"))
    return out.drop("w")


def difficulty(base: Column, hours: Column, files: Column) -> Column:
    """Base + hours (3 at most) + files / 5, 10 at most."""
    return F.least(F.lit(10.0), base + F.least(hours, F.lit(3.0)) + F.floor(files / 5))


def hourly_cap(df: DataFrame, key: str, cap: int) -> DataFrame:
    """At most cap rows of each key in an hour, the first of them."""
    by = Window.partitionBy(key, F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return df.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= cap).drop("_n")


def folded(df: DataFrame, key: str, columns: list[str], start: Callable[[], object], step: Callable, out: str) -> DataFrame:
    """Rows that a fold over each key's rows gives, in the order of ts and event_id.

    What a row gives depends on the rows before it, so each key streams through
    one task in order; only the state of the key at hand is held. step(state,
    key, *columns) gives (state, row or None); out is the schema of the rows.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches):
        at, state = object(), None
        for pdf in batches:
            rows = []
            for k, *values in zip(pdf[key], *(pdf[c] for c in columns)):
                if k != at:
                    at, state = k, start()
                state, row = step(state, k, *values)
                if row is not None:
                    rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    some = df.select(*dict.fromkeys([key, "ts", "event_id", *columns])).filter(F.col(key).isNotNull())
    return some.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, out)


def cooldown(df: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, event_id) of rows accepted by a cooldown since the last accepted row of the key."""

    def step(last, k, event, t):
        ok = last is None or (t - last).total_seconds() >= seconds
        return (t, (k, event)) if ok else (last, None)

    return folded(df, key, ["event_id", "ts"], lambda: None, step, f"{key} bigint, event_id bigint")


def notify_limit(df: DataFrame, key: str, most: int = 10, seconds: float = 60.0) -> DataFrame:
    """(key, event_id) of rows that may be sent: fewer than most accepted ones in the trailing time (Z5). Holds most times."""

    def step(sent, k, event, t):
        sent = [s for s in sent if (t - s).total_seconds() <= seconds]
        return (sent + [t], (k, event)) if len(sent) < most else (sent, None)

    return folded(df, key, ["event_id", "ts"], list, step, f"{key} bigint, event_id bigint")


def circuit_breaker(df: DataFrame, key: str, failures: int = 5, pause: float = 60.0, successes: int = 2) -> DataFrame:
    """(key, event_id, state) after each event: closed, open or half_open."""

    def step(held, k, event, t, kind):
        state, bads, goods, since = held
        bad = kind == "error"
        if state == "open" and (t - since).total_seconds() >= pause:
            state, goods = "half_open", 0
        if state == "closed":
            bads = bads + 1 if bad else 0
            if bads >= failures:
                state, since = "open", t
        elif state == "half_open":
            if bad:
                state, since = "open", t
            else:
                goods += 1
                if goods >= successes:
                    state, bads = "closed", 0
        return (state, bads, goods, since), (k, event, state)

    return folded(df, key, ["event_id", "ts", "event_type"], lambda: ("closed", 0, 0, None), step, f"{key} bigint, event_id bigint, state string")


def failover(df: DataFrame, key: str, failures: int = 3, recovery: float = 30.0) -> DataFrame:
    """(key, event_id, up) after each event: a node is down after so many errors in a row, and tried again after the recovery time."""

    def step(held, k, event, t, kind):
        bads, since = held
        if since is not None and (t - since).total_seconds() >= recovery:
            bads, since = 0, None
        if since is None:
            bads = bads + 1 if kind == "error" else 0
            if bads >= failures:
                since = t
        return (bads, since), (k, event, since is None)

    return folded(df, key, ["event_id", "ts", "event_type"], lambda: (0, None), step, f"{key} bigint, event_id bigint, up boolean")


def work_sessions(df: DataFrame, key: str, activity: str, gap: float = 600.0) -> DataFrame:
    """(key, activity, started, ended, actions, complete) by the full rules of Z1, one row for each session that has ended.

    A pause over the gap ends a session, and the row after it starts the next.
    Confidence starts at 0.5 and moves by 0.1 as rows agree with the activity or
    not; below 0.3 the activity becomes that of the row. Over 10 actions at a
    confidence over 0.7 complete a session. A session still open gives no row.
    """

    def step(held, k, event, t, kind):
        if held is not None and (t - held[3]).total_seconds() > gap:
            done, held = held, (kind, 5, t, t, 1)
            return held, (k, done[0], done[2], done[3], done[4], False)
        if held is None:
            return (kind, 5, t, t, 1), None
        at, tenths, started, _, actions = held
        tenths = min(10, tenths + 1) if kind == at else max(0, tenths - 1)
        if tenths < 3:
            at, tenths = kind, 5
        if actions + 1 > 10 and tenths > 7:
            return None, (k, at, started, t, actions + 1, True)
        return (at, tenths, started, t, actions + 1), None

    return folded(df, key, ["event_id", "ts", activity], lambda: None, step, f"{key} bigint, activity string, started timestamp_ntz, ended timestamp_ntz, actions bigint, complete boolean")


def histogram(value: Column, bounds: list[float]) -> Column:
    """The first bound that is not below the value, else +Inf (A20); the least bound comes first."""
    out = F.lit("+Inf")
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(str(b))).otherwise(out)
    return out


def health(cpu: Column, memory: Column, errors: Column) -> Column:
    """Critical if any measure is critical, else warning if any is high."""
    critical = (cpu > 90) | (memory > 90) | (errors > 0.1)
    return F.when(critical, "critical").when((cpu > 70) | (memory > 80) | (errors > 0.05), "warning").otherwise("healthy")


def severity(value: Column, threshold: float) -> Column:
    """Critical from twice the threshold on, warning above it."""
    return F.when(value >= 2 * threshold, "critical").when(value > threshold, "warning")


#: Base impact of each kind of learning event.
IMPACT = {"new_entity": 0.7, "new_relationship": 0.6, "code_pattern": 0.8, "breakthrough": 0.9}


def impact(kind: Column, confidence: Column) -> Column:
    """Base of the kind times the confidence."""
    base = F.create_map(*(F.lit(x) for kv in IMPACT.items() for x in kv))
    return F.coalesce(F.try_element_at(base, kind), F.lit(0.5)) * confidence
