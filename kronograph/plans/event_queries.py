"""Queries of novelty, sessions, limits, statistics, health and alerts over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kronograph.functions import text as T
from kronograph.operators import events as E
from kronograph.plans.registry import query
from kronograph.sources.model import table


def events(spark, d):
    return table(spark, d, "events")


def _novelty(name, key, sql_key, least):
    @query(name, f"SELECT {sql_key} AS {key}, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY {sql_key} ORDER BY ts, event_id) AS r FROM events WHERE value / 100.0::DOUBLE >= {least}::DOUBLE) WHERE r = 1 GROUP BY 1")
    def _(spark, d):
        e = events(spark, d).select(F.expr(sql_key.replace("VARCHAR", "STRING")).alias(key), "event_id", "ts", (F.col("value") / 100.0).alias("confidence"))
        return E.first_seen(e, key, "confidence", least, "ts", "event_id").select(key, "event_id")


_novelty("novelty_types", "kind", "event_type", 0.7)
_novelty("novelty_relations", "relation", "event_type||'>'||CAST(user_id % 7 AS VARCHAR)", 0.6)


@query("event_cap", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS r FROM events) WHERE r <= 5")
def _(spark, d):
    return E.recents(events(spark, d), "user_id", 5, "event_type", "ts", "event_id").select("user_id", "event_id")


@query("bounded_recents", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 20")
def _(spark, d):
    return E.recents(events(spark, d), "user_id", 20, F.desc("ts"), "event_id").select("user_id", "event_id")


@query("topk_per_group", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def _(spark, d):
    return E.recents(events(spark, d), "event_type", 10, F.desc("value"), "event_id").select("event_type", "event_id", "value")


def _sessions(name, gap, interval):
    @query(
        name,
        f"""SELECT user_id, count(*) AS actions, min(ts) AS started, max(ts) AS ended, round(sum(value), 6) AS value FROM (
 SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL {interval} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s""",
    )
    def _(spark, d):
        return E.sessions(events(spark, d), "user_id", gap).withColumn("value", F.round("value", 6))


_sessions("sessions_gap", "10 minutes", "10 MINUTE")
_sessions("session_summary", "6 hours", "6 HOUR")


@query("hourly_cap", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2")
def _(spark, d):
    return E.hourly_cap(events(spark, d), "event_type", 2).select("event_id")


def fold_sql(start: str, step: str, select: str, columns: str = "") -> str:
    """A fold over each user's events by a recursive query: r holds the state after each event, o the numbered events."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, k, event_id, {start} FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.event_id, {step} FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
 {select}"""


_WAITED = "epoch(o.ts) - epoch(r.last) >= 3600"


@query("cooldown", fold_sql("ts AS last, true AS ok", f"CASE WHEN {_WAITED} THEN o.ts ELSE r.last END, {_WAITED}", "SELECT event_id FROM r WHERE ok"))
def _(spark, d):
    return E.cooldown(events(spark, d), "user_id", 3600.0).select("event_id")


_SENT = "list_filter(r.sent, lambda s: epoch(o.ts) - epoch(s) <= 86400)"


@query("notify_limit", fold_sql("[ts] AS sent, true AS ok", f"CASE WHEN len({_SENT}) < 2 THEN list_append({_SENT}, o.ts) ELSE {_SENT} END, len({_SENT}) < 2", "SELECT event_id FROM r WHERE ok"))
def _(spark, d):
    return E.notify_limit(events(spark, d), "user_id", 2, 86400.0).select("event_id")


# the state that an event meets, and what it makes of it, for two failures, a pause of an hour and one success
_MET = "CASE WHEN r.state = 'open' AND epoch(o.ts) - epoch(r.since) >= 3600 THEN 'half_open' ELSE r.state END"
_BAD = "o.event_type = 'error'"
_NOW = f"CASE {_MET} WHEN 'closed' THEN CASE WHEN {_BAD} AND r.bads + 1 >= 2 THEN 'open' ELSE 'closed' END WHEN 'half_open' THEN CASE WHEN {_BAD} THEN 'open' ELSE 'closed' END ELSE 'open' END"


@query(
    "circuit_breaker",
    fold_sql(
        "'closed' AS state, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bads, ts AS since",
        f"{_NOW}, CASE {_MET} WHEN 'closed' THEN CASE WHEN {_BAD} THEN r.bads + 1 ELSE 0 END WHEN 'half_open' THEN CASE WHEN {_BAD} THEN r.bads ELSE 0 END ELSE r.bads END, CASE WHEN {_NOW} = 'open' AND {_MET} <> 'open' THEN o.ts ELSE r.since END",
        "SELECT user_id, event_id, state FROM r",
    ),
)
def _(spark, d):
    return E.circuit_breaker(events(spark, d), "user_id", failures=2, pause=3600.0, successes=1)


_DOWN = "CASE WHEN r.since IS NOT NULL AND epoch(o.ts) - epoch(r.since) >= 86400 THEN NULL ELSE r.since END"
_BADS = f"CASE WHEN ({_DOWN}) IS NOT NULL THEN r.bads WHEN NOT {_BAD} THEN 0 WHEN r.since IS NOT NULL THEN 1 ELSE r.bads + 1 END"


@query(
    "failover",
    fold_sql(
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bads, CAST(NULL AS TIMESTAMP) AS since",
        f"{_BADS}, CASE WHEN ({_DOWN}) IS NOT NULL THEN r.since WHEN {_BADS} >= 2 THEN o.ts END",
        "SELECT user_id, event_id, since IS NULL AS up FROM r",
    ),
)
def _(spark, d):
    return E.failover(events(spark, d), "user_id", failures=2, recovery=86400.0)


_OVER = "r.activity IS NULL OR epoch(o.ts) - epoch(r.last) > 86400"
_TENTHS = "CASE WHEN o.event_type = r.activity THEN least(10, r.tenths + 1) ELSE greatest(0, r.tenths - 1) END"
_KIND = f"CASE WHEN {_TENTHS} < 3 THEN o.event_type ELSE r.activity END"
_LEFT = f"CASE WHEN {_TENTHS} < 3 THEN 5 ELSE {_TENTHS} END"
_DONE = f"r.actions + 1 > 10 AND {_LEFT} > 7"


@query(
    "sessions_full_rules",
    fold_sql(
        "event_type AS activity, 5 AS tenths, ts AS started, ts AS last, 1 AS actions, CAST(NULL AS STRUCT(activity VARCHAR, started TIMESTAMP, ended TIMESTAMP, actions INTEGER, complete BOOLEAN)) AS ended",
        f"""CASE WHEN {_OVER} THEN o.event_type WHEN {_DONE} THEN NULL ELSE {_KIND} END, CASE WHEN {_OVER} THEN 5 ELSE {_LEFT} END, CASE WHEN {_OVER} THEN o.ts ELSE r.started END, o.ts, CASE WHEN {_OVER} THEN 1 ELSE r.actions + 1 END,
 CASE WHEN r.activity IS NULL THEN NULL WHEN epoch(o.ts) - epoch(r.last) > 86400 THEN {{'activity': r.activity, 'started': r.started, 'ended': r.last, 'actions': r.actions, 'complete': false}} WHEN {_DONE} THEN {{'activity': {_KIND}, 'started': r.started, 'ended': o.ts, 'actions': r.actions + 1, 'complete': true}} END""",
        "SELECT user_id, ended.activity AS activity, ended.started AS started, ended.ended AS ended, CAST(ended.actions AS BIGINT) AS actions, ended.complete AS complete FROM r WHERE ended IS NOT NULL",
    ),
)
def _(spark, d):
    return E.work_sessions(events(spark, d), "user_id", "event_type", 86400.0)


@query("trailing_window", "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return E.trailing(events(spark, d), "event_type", 3600).select("event_id", "n", F.round("mean", 6).alias("mean"))


@query("ema", "SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.9::DOUBLE + x * (1 - 0.9::DOUBLE)), 6) AS ema FROM events GROUP BY user_id")
def _(spark, d):
    return E.ema(events(spark, d), "user_id", 0.9, "ts", "event_id").withColumn("ema", F.round("ema", 6))


@query("trend_slope", "SELECT event_type, round(regr_slope(value, r), 6) AS slope FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n, -row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE n <= 5 GROUP BY event_type")
def _(spark, d):
    by = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = events(spark, d).withColumn("n", F.row_number().over(by)).filter("n <= 5")
    return e.groupBy("event_type").agg(F.round(F.regr_slope(F.col("value"), -F.col("n")), 6).alias("slope"))


@query("histogram", "SELECT event_type, CASE WHEN value <= 1.0 THEN '1.0' WHEN value <= 10.0 THEN '10.0' WHEN value <= 100.0 THEN '100.0' ELSE '+Inf' END AS bucket, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return events(spark, d).groupBy("event_type", E.histogram(F.col("value"), [1.0, 10.0, 100.0]).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("latency_alerts", "SELECT event_id, CASE WHEN value >= 300 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE value > 150")
def _(spark, d):
    return events(spark, d).select("event_id", E.severity(F.col("value"), 150.0).alias("severity")).filter("severity is not null")


HEALTH = "SELECT user_id, avg(value) AS cpu, max(value) / 4 AS memory, count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) AS errors FROM events GROUP BY user_id"
STATUS = "CASE WHEN cpu > 90 OR memory > 90 OR errors > 0.1 THEN 'critical' WHEN cpu > 70 OR memory > 80 OR errors > 0.05 THEN 'warning' ELSE 'healthy' END"


@query("health_report", f"SELECT {STATUS} AS status, count(*) AS n, round(avg(cpu), 6) AS cpu FROM ({HEALTH}) GROUP BY 1")
def _(spark, d):
    m = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("cpu"), (F.max("value") / 4).alias("memory"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("errors"))
    return m.groupBy(E.health(F.col("cpu"), F.col("memory"), F.col("errors")).alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("cpu"), 6).alias("cpu"))


@query("health_score", "SELECT user_id, CAST(greatest(100 - sum(CASE WHEN value >= 400 THEN 30 WHEN value >= 300 THEN 20 WHEN value >= 200 THEN 10 WHEN value >= 100 THEN 5 ELSE 0 END), 0) AS BIGINT) AS score FROM events GROUP BY user_id")
def _(spark, d):
    v = F.col("value")
    penalty = F.when(v >= 400, 30).when(v >= 300, 20).when(v >= 200, 10).when(v >= 100, 5).otherwise(0)
    return events(spark, d).groupBy("user_id").agg(F.greatest(100 - F.sum(penalty), F.lit(0)).cast("bigint").alias("score"))


@query("error_share", "SELECT user_id % 10 AS category, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, d):
    e = events(spark, d).filter("event_type = 'error'").groupBy((F.col("user_id") % 10).alias("category")).agg(F.count("*").alias("n"))
    total = F.broadcast(e.agg(F.sum("n").alias("total")))  # one row
    return e.crossJoin(total).select("category", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@query("success_rates", "SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1 END), 6) AS rate, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)), 6).alias("rate"), F.round(F.avg("value"), 6).alias("mean"))


@query("query_stats", "SELECT md5(props) AS hash, count(*) AS n, CAST(floor(avg(value)) AS BIGINT) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY props")
def _(spark, d):
    return events(spark, d).groupBy("props").agg(F.count("*").alias("n"), F.floor(F.avg("value")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")).select(F.md5("props").alias("hash"), "n", "mean", "least", "most")


@query("search_frequency", "SELECT lower(event_type) AS term, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 3")
def _(spark, d):
    return events(spark, d).groupBy(F.lower("event_type").alias("term")).agg(F.count("*").alias("n")).filter("n > 3")


@query("edit_counts", "SELECT user_id, json_extract(props, '$.k')::BIGINT AS file, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def _(spark, d):
    return events(spark, d).groupBy("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("file")).agg(F.count("*").alias("n")).filter("n > 2")


@query("distinct_ratio", "SELECT user_id, count(DISTINCT event_type) / CAST(count(*) AS DOUBLE) < 0.5 AND count(*) > 5 AS focused FROM events GROUP BY user_id")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(((F.count_distinct("event_type") / F.count("*") < 0.5) & (F.count("*") > 5)).alias("focused"))


@query("activity_argmax", "SELECT user_id, arg_min(event_type, (-s, event_type)) AS activity, round(least(max(s) / 1000, 1), 6) AS score FROM (SELECT user_id, event_type, round(sum(value), 6) AS s FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark, d):
    s = events(spark, d).groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("s"))
    return s.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("s"), "event_type")).alias("activity"), F.round(F.least(F.max("s") / 1000, F.lit(1.0)), 6).alias("score"))


@query("tag_stats", "SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type = 'error' THEN ['alert','error'] ELSE ['info', event_type] END) AS tag FROM events) GROUP BY tag")
def _(spark, d):
    tags = F.when(F.col("event_type") == "error", F.array(F.lit("alert"), F.lit("error"))).otherwise(F.array(F.lit("info"), F.col("event_type")))
    return events(spark, d).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("notify_filter", "SELECT event_id, round((CASE event_type WHEN 'signup' THEN 0.7 WHEN 'purchase' THEN 0.9 ELSE 0.5 END) * least(value / 100, 1), 6) AS impact FROM events WHERE least(value / 100, 1) >= 0.5 AND (CASE event_type WHEN 'signup' THEN 0.7 WHEN 'purchase' THEN 0.9 ELSE 0.5 END) * least(value / 100, 1) >= 0.5")
def _(spark, d):
    kind = F.when(F.col("event_type") == "signup", "new_entity").when(F.col("event_type") == "purchase", "breakthrough").otherwise("other")
    e = events(spark, d).withColumn("confidence", F.least(F.col("value") / 100, F.lit(1.0))).withColumn("impact", E.impact(kind, F.col("confidence")))
    return e.filter("confidence >= 0.5 and impact >= 0.5").select("event_id", F.round("impact", 6).alias("impact"))


@query("priority_order", "SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, ts DESC, event_id LIMIT 100")
def _(spark, d):
    t = F.col("event_type")
    level = F.when(t == "error", 4).when(t == "purchase", 3).when(t == "signup", 2).otherwise(1)
    return events(spark, d).orderBy(level.desc(), F.desc("ts"), "event_id").limit(100).select("event_id")


@query("evict_lowest", "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY n, user_id) AS r, count(*) OVER () AS total FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)) WHERE r <= total / 4")
def _(spark, d):
    n = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.orderBy("n", "user_id").limit(n.count() // 4).select("user_id")


@query("access_probability", "SELECT user_id, round(least(1.0::DOUBLE, 0.4::DOUBLE * ln(count(*)) / 10 + 0.4::DOUBLE * exp(-epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 / 24) + 0.2::DOUBLE * exp(-epoch(TIMESTAMP '2024-02-01' - min(ts)) / 3600 / 168)), 6) AS p FROM events GROUP BY user_id")
def _(spark, d):
    t = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    now = 1706745600.0
    p = T.access_probability(F.count("*"), (now - t(F.max("ts"))) / 3600, (now - t(F.min("ts"))) / 3600)
    return events(spark, d).groupBy("user_id").agg(F.round(p, 6).alias("p"))


@query("ttl_active", "SELECT event_id FROM events WHERE ts + INTERVAL 300 SECOND > TIMESTAMP '2024-01-15'")
def _(spark, d):
    return events(spark, d).filter(F.expr("ts + interval 300 seconds > timestamp_ntz '2024-01-15'")).select("event_id")


@query("action_inference", "SELECT event_type, CASE event_type WHEN 'error' THEN 'debugging' WHEN 'view' THEN 'exploring' WHEN 'click' THEN 'exploring' ELSE 'implementing' END AS activity, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    t = F.col("event_type")
    activity = T.first_match([(t == "error", "debugging"), (t.isin("view", "click"), "exploring")], "implementing")
    return events(spark, d).groupBy("event_type", activity.alias("activity")).agg(F.count("*").alias("n"))


@query("auto_tune", "SELECT day, CASE WHEN errors > 0.2 THEN least(0.75 + 0.05, 0.95) ELSE 0.75 END::DOUBLE AS threshold, CASE WHEN mean > 50 THEN 80 ELSE 100 END::BIGINT AS batch FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS errors, avg(value) AS mean FROM events GROUP BY 1)")
def _(spark, d):
    m = events(spark, d).groupBy(F.expr("cast(date_trunc('day', ts) as timestamp_ntz)").alias("day")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("errors"), F.avg("value").alias("mean"))
    return m.select("day", F.when(F.col("errors") > 0.2, F.least(F.lit(0.75) + 0.05, F.lit(0.95))).otherwise(0.75).alias("threshold"), F.when(F.col("mean") > 50, 80).otherwise(100).cast("bigint").alias("batch"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    w = F.window(F.col("ts"), "1 hour")
    return events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("sliding_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS start, count(*) AS n FROM events, range(0, 3) t(k) GROUP BY ALL")
def _(spark, d):
    w = F.window(F.col("ts"), "3 hours", "1 hour")
    return events(spark, d).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("late_events", "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE ts < seen - INTERVAL 10 MINUTE")
def _(spark, d):
    e = events(spark, d)
    seen = F.max("ts").over(Window.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("seen", seen).filter("ts < seen - interval 10 minutes").select("event_id")


@query("project_patterns", "SELECT user_id % 5 AS project, event_type, count(*) AS frequency, round(ln(count(*)) / 10 + 0.3::DOUBLE * avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS confidence FROM events GROUP BY ALL HAVING count(*) >= 3 AND ln(count(*)) / 10 + 0.3::DOUBLE * avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0 END) >= 0.7")
def _(spark, d):
    c = F.log(F.count("*")) / 10 + 0.3 * F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0))
    e = events(spark, d).groupBy((F.col("user_id") % 5).alias("project"), "event_type").agg(F.count("*").alias("frequency"), c.alias("c"))
    return e.filter("frequency >= 3 and c >= 0.7").select("project", "event_type", "frequency", F.round("c", 6).alias("confidence"))


@query("pattern_recommend", "SELECT user_id, event_type, round(0.4::DOUBLE * share + 0.3::DOUBLE * ln(n) / 10, 6) AS relevance FROM (SELECT *, n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE share > 0.3")
def _(spark, d):
    n = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).filter("share > 0.3")
    return s.select("user_id", "event_type", F.round(0.4 * F.col("share") + 0.3 * F.log("n") / 10, 6).alias("relevance"))


@query("lww", "SELECT user_id AS id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark, d):
    from kronograph.operators.reconcile import last_writer

    return last_writer(events(spark, d).select(F.col("user_id").alias("id"), "value", "ts", "event_id"), ["id"], ["ts", "event_id"]).select("id", "value")


@query("conflict_by_type", "SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN arg_max(value, (ts, event_id)) ELSE arg_min(value, (ts, event_id)) END AS value FROM events GROUP BY user_id")
def _(spark, d):
    order = F.struct("ts", "event_id")
    return events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.when(F.first("user_id") % 2 == 0, F.max_by("value", order)).otherwise(F.min_by("value", order)).alias("value"))


_HIGHER = "(o.event_id % 5 > r.a OR o.event_id % 3 > r.b) AND o.event_id % 5 >= r.a AND o.event_id % 3 >= r.b"


@query(
    "vector_clock",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r AS (SELECT user_id, k, event_id AS best, event_id % 5 AS a, event_id % 3 AS b FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, CASE WHEN {_HIGHER} THEN o.event_id ELSE r.best END, CASE WHEN {_HIGHER} THEN o.event_id % 5 ELSE r.a END, CASE WHEN {_HIGHER} THEN o.event_id % 3 ELSE r.b END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
 SELECT user_id AS id, arg_max(best, k) AS event_id FROM r GROUP BY user_id""",
)
def _(spark, d):
    from kronograph.operators.reconcile import clock_winner

    clock = F.create_map(F.lit("a"), (F.col("event_id") % 5).cast("bigint"), F.lit("b"), (F.col("event_id") % 3).cast("bigint"))
    return clock_winner(events(spark, d).select(F.col("user_id").alias("id"), "event_id", clock.alias("clock")), "id", "event_id")


@query("shard_distribution", "SELECT CAST('0x'||substr(md5(user_id::VARCHAR), 1, 2) AS BIGINT) % 16 AS shard, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy(T.shard(F.col("user_id").cast("string")).alias("shard")).agg(F.count("*").alias("n"))


@query(
    "hash_ring",
    """WITH p AS (SELECT CAST('0x'||substr(md5(node||'#'||k), 1, 15) AS BIGINT) AS pos, node FROM (VALUES ('a'), ('b'), ('c')) t(node), range(150) r(k)), least_one AS (SELECT arg_min(node, pos) AS node FROM p),
 e AS (SELECT CAST('0x'||substr(md5(event_id::VARCHAR), 1, 15) AS BIGINT) AS pos FROM events)
 SELECT coalesce(p.node, (SELECT node FROM least_one)) AS node, count(*) AS n FROM e ASOF LEFT JOIN p ON e.pos <= p.pos GROUP BY 1""",
)
def _(spark, d):
    from kronograph.operators.reconcile import ring_owner

    return ring_owner(events(spark, d).select(F.col("event_id").cast("string").alias("key")), ["a", "b", "c"], 150)


@query("state_hash", "SELECT bit_xor(CAST('0x'||substr(md5(event_id||':'||user_id||':'||event_type), 1, 15) AS BIGINT)) AS hash, count(*) AS n FROM events")
def _(spark, d):
    return events(spark, d).agg(F.bit_xor(T.place(F.concat_ws(":", "event_id", "user_id", "event_type"))).alias("hash"), F.count("*").alias("n"))


@query("metrics_text", "SELECT 'events_total{type=\"'||event_type||'\"} '||count(*) AS line FROM events GROUP BY event_type")
def _(spark, d):
    n = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


@query("context_suggestions", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) FILTER (event_type = 'error') > 10 AS troubled FROM events GROUP BY user_id")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), (F.count_if(F.col("event_type") == "error") > 10).alias("troubled"))
