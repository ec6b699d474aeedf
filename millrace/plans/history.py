"""Run history over events, orders and the derived corpora."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from millrace.operators import history as hs
from millrace.plans.derived import SQL_CORPUS, from_sql, sql_corpus
from millrace.plans.registry import Tables, plan

AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"


def _as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def _mean(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({x})"


KEY = r"md5(lower(regexp_replace(sql, '^\s+|\s+$', '', 'g')))"
STORED = f"""
    SELECT * FROM (SELECT *, {KEY} AS statement_key, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY stmt_id DESC) AS rn
                   FROM ({SQL_CORPUS})) WHERE rn = 1
"""


def _results(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Stored conversions of the older half of the statements, and those of the newer."""
    corpus = sql_corpus(t)
    middle = t.orders.agg((F.max("o_orderkey") / 2).cast("bigint")).first()[0]
    return corpus.where(F.col("stmt_id") <= middle), corpus.where(F.col("stmt_id") > middle)


@plan("history_upsert", f"SELECT statement_key, stmt_id, sql FROM ({STORED})")
def history_upsert(t: Tables) -> DataFrame:
    old, new = _results(t)
    return hs.store_results(old, new, "sql", [("stmt_id", False)])


@plan(
    "history_lookup",
    f"""
    SELECT c.stmt_id, {KEY} AS statement_key, s.stored_id, s.stored_id IS NOT NULL AS hit FROM ({SQL_CORPUS}) c
    LEFT JOIN (SELECT {KEY} AS k, MAX(stmt_id) AS stored_id FROM ({SQL_CORPUS})
               WHERE stmt_id <= (SELECT CAST(floor(MAX(o_orderkey) / 2) AS BIGINT) FROM orders) GROUP BY 1) s ON {KEY} = s.k
    """,
)
def history_lookup(t: Tables) -> DataFrame:
    old, new = _results(t)
    stored = hs.store_results(old.limit(0), old, "sql", [("stmt_id", False)]).withColumnRenamed("stmt_id", "stored_id")
    found = hs.look_up(old.unionByName(new), stored, "sql", ["stored_id"])
    return found.select("stmt_id", "statement_key", "stored_id", "hit")


NEWEST = [("ts", False), ("event_id", False)]


@plan("history_recent", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def history_recent(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "value", "ts")
    return hs.recent(rows, NEWEST, 20).drop("ts")


@plan(
    "history_search",
    "SELECT doc_id, source FROM documents WHERE text ILIKE '%RC1%' OR source ILIKE '%RC1%' ORDER BY doc_id DESC LIMIT 25",
)
def history_search(t: Tables) -> DataFrame:
    found = hs.search(t.documents, ["text", "source"], "RC1", [("doc_id", False)], 25)
    return found.select("doc_id", "source")


@plan(
    "kv_context",
    """
    SELECT user_id, props AS value, CAST(props ->> '$.k' AS BIGINT) AS k FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def kv_context(t: Tables) -> DataFrame:
    latest = hs.latest_values(t.events, "user_id", "props", F.struct("ts", "event_id"))
    return latest.select("user_id", "value", F.try_variant_get("parsed", "$.k", "bigint").alias("k"))


@plan(
    "metrics_by_type",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def metrics_by_type(t: Tables) -> DataFrame:
    clicks = t.events.where(F.col("event_type") == "click")
    return hs.recent(clicks.select("event_id", "user_id", "value", "ts"), NEWEST, 50).drop("ts")


@plan(
    "effectiveness",
    f"""
    SELECT 'lic' AS pattern, {_mean('value')} AS mean, MIN(value) AS low, MAX(value) AS high, COUNT(*) AS n
    FROM events WHERE event_type ILIKE '%lic%'
    UNION ALL SELECT 'no such label', 0.0, 0.0, 0.0, COUNT(*) FILTER (event_type ILIKE '%no such label%') FROM events
    """,
)
def effectiveness(t: Tables) -> DataFrame:
    some = hs.effectiveness(t.events, "event_type", "value", "lic").withColumn("pattern", F.lit("lic"))
    none = hs.effectiveness(t.events, "event_type", "value", "no such label")
    return some.unionByName(none.withColumn("pattern", F.lit("no such label")))


CACHED = "SELECT event_id, event_type, ts + INTERVAL 24 HOUR * CAST(event_id % 30 AS INTEGER) AS expires_at FROM events"


def _cached(t: Tables) -> DataFrame:
    expires = F.timestamp_add("HOUR", (F.col("event_id") % 30 * 24).cast("int"), F.col("ts"))
    return t.events.select("event_id", "event_type", expires.alias("expires_at"))


@plan("ttl_live", f"SELECT event_id, event_type FROM ({CACHED}) WHERE expires_at > {AS_OF}")
def ttl_live(t: Tables) -> DataFrame:
    return hs.live(_cached(t), "expires_at", _as_of()).select("event_id", "event_type")


@plan(
    "ttl_expiry",
    f"""
    SELECT event_type, COUNT(*) AS total, COUNT(*) FILTER (expires_at > {AS_OF}) AS active,
           COUNT(*) FILTER (expires_at <= {AS_OF}) AS expired FROM ({CACHED}) GROUP BY event_type
    """,
)
def ttl_expiry(t: Tables) -> DataFrame:
    return hs.expiry_statistics(_cached(t), "event_type", "expires_at", _as_of())


@plan(
    "batch_summary",
    """
    WITH q AS (SELECT l_orderkey, COUNT(*) FILTER (l_returnflag <> 'R') AS n_ok, COUNT(*) FILTER (l_returnflag = 'R') AS n_failed
               FROM lineitem GROUP BY 1),
    j AS (SELECT o_custkey AS job, COUNT(*) AS total_files, COUNT(*) FILTER (o_orderstatus <> 'F') AS ok_files,
                 COUNT(*) FILTER (o_orderstatus = 'F') AS failed_files, CAST(COALESCE(SUM(n_ok), 0) AS BIGINT) AS ok_queries,
                 CAST(COALESCE(SUM(n_failed), 0) AS BIGINT) AS failed_queries FROM orders LEFT JOIN q ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT *, ok_files::DOUBLE / total_files * 100 AS file_rate,
           CASE WHEN ok_queries + failed_queries = 0 THEN 0 ELSE ok_queries::DOUBLE / (ok_queries + failed_queries) * 100 END AS query_rate,
           CASE WHEN failed_files > 0 AND ok_files = 0 THEN 'failed' ELSE 'completed' END AS status FROM j
    """,
)
def batch_summary(t: Tables) -> DataFrame:
    files = t.orders.select(
        F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("file"), (F.col("o_orderstatus") != "F").alias("ok")
    )
    queries = t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(
        F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("n_ok"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_failed"),
    )
    return hs.batch_summary(files, "job", queries, "file")


@plan(
    "batch_label_counts",
    """
    SELECT label, COUNT(*) AS n FROM (SELECT unnest([event_type, CASE WHEN value > 50 THEN 'large' ELSE 'small' END,
      'day ' || strftime(ts, '%d')]) AS label FROM events WHERE event_type <> 'error') GROUP BY label
    """,
)
def batch_label_counts(t: Tables) -> DataFrame:
    size = F.when(F.col("value") > 50, "large").otherwise("small")
    labels = F.array("event_type", size, F.concat(F.lit("day "), F.date_format("ts", "dd")))
    return hs.label_counts(t.events.where(F.col("event_type") != "error"), labels)


@plan(
    "batch_errors",
    "SELECT event_id, 'user ' || user_id || ': ' || props AS error FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 10",
)
def batch_errors(t: Tables) -> DataFrame:
    text = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(": "), F.col("props"))
    failed = t.events.where(F.col("event_type") == "error").select("event_id", "ts", text.alias("error"))
    return hs.recent(failed, [("ts", True), ("event_id", True)], 10).drop("ts")


JOBS = """
    SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'P' THEN concat('{"k": ', CAST(o_custkey AS VARCHAR(20)))
           WHEN 'F' THEN concat('{"x": ', CAST(o_custkey AS VARCHAR(20)), '}') ELSE concat('{"k": ', CAST(o_custkey AS VARCHAR(20)), '}') END AS doc,
           o_custkey, o_orderstatus
    FROM orders
"""


@plan(
    "batch_run",
    f"""
    SELECT job, CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS VARCHAR) END AS result,
           CASE o_orderstatus WHEN 'P' THEN 'JSONDecodeError' WHEN 'F' THEN 'KeyError' END AS error FROM ({JOBS})
    """,
)
def batch_run(t: Tables) -> DataFrame:
    return hs.run_each(from_sql(t, JOBS, "orders"), "job", "doc", lambda text: json.loads(text)["k"])


TIMINGS = """
    SELECT {name} AS name, value AS duration, ts AS run_at, event_type <> 'error' AS passed, user_id % 2 = 0 AS parallel,
           event_id % 3 = 0 AS cached, event_id FROM events
"""
BY_TYPE = TIMINGS.format(name="event_type")
BY_USER = TIMINGS.format(name="user_id")


@plan(
    "slowest",
    f"""
    SELECT name, {_mean('duration')} AS avg_duration, MAX(duration) AS max_duration, MIN(duration) AS min_duration, COUNT(*) AS n_runs
    FROM ({BY_USER}) WHERE run_at > {AS_OF} - INTERVAL 7 DAY AND passed GROUP BY name ORDER BY avg_duration DESC, name LIMIT 10
    """,
)
def slowest(t: Tables) -> DataFrame:
    return hs.slowest(from_sql(t, BY_USER, "events"), _as_of())


RATES = """COUNT(*) FILTER (parallel) AS n_parallel, COUNT(*) FILTER (cached) AS n_cached,
    COUNT(*) FILTER (parallel)::DOUBLE / COUNT(*) AS parallel_rate, COUNT(*) FILTER (cached)::DOUBLE / COUNT(*) AS cached_rate"""


@plan(
    "daily_trend",
    f"""
    SELECT strftime(run_at, '%Y-%m-%d') AS day, {_mean('duration')} AS avg_duration, COUNT(*) AS n_runs, {RATES}
    FROM ({BY_TYPE}) WHERE run_at > {AS_OF} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 1 DESC LIMIT 30
    """,
)
def daily_trend(t: Tables) -> DataFrame:
    return hs.daily_trend(from_sql(t, BY_TYPE, "events"), _as_of())


@plan(
    "name_history",
    f"SELECT event_id, duration, passed FROM ({BY_TYPE}) WHERE name = 'click' AND run_at > {AS_OF} - INTERVAL 30 DAY",
)
def name_history(t: Tables) -> DataFrame:
    history = hs.name_history(from_sql(t, BY_TYPE, "events"), "click", _as_of())
    return history.select("event_id", "duration", "passed")


@plan(
    "regressions",
    f"""
    WITH r AS (SELECT name, {_mean('duration')} AS recent_avg FROM ({BY_USER}) WHERE passed AND run_at > {AS_OF} - INTERVAL 7 DAY GROUP BY 1),
    h AS (SELECT name, {_mean('duration')} AS previous_avg FROM ({BY_USER}) WHERE passed
          AND run_at BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} - INTERVAL 7 DAY GROUP BY 1)
    SELECT name, recent_avg, previous_avg, recent_avg / previous_avg AS ratio, (recent_avg / previous_avg - 1) * 100 AS slowdown_percent
    FROM r JOIN h USING (name) WHERE recent_avg / previous_avg > 1.5
    """,
)
def regressions(t: Tables) -> DataFrame:
    return hs.regressions(from_sql(t, BY_USER, "events"), _as_of())


@plan(
    "summary_report",
    f"""
    SELECT COUNT(*) AS n_runs, {_mean('duration')} AS avg_duration, MAX(duration) AS max_duration, {RATES}
    FROM ({BY_TYPE}) WHERE run_at > {AS_OF} - INTERVAL 7 DAY
    """,
)
def summary_report(t: Tables) -> DataFrame:
    return hs.summary_report(from_sql(t, BY_TYPE, "events"), _as_of())


@plan(
    "flaky_names",
    """
    WITH l AS (SELECT user_id, event_type = 'error' AS failed, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    g AS (SELECT user_id, COUNT(*) AS n_runs, COUNT(*) FILTER (failed)::DOUBLE / COUNT(*) AS failure_rate,
                 string_agg(CASE WHEN failed THEN 'failed' ELSE 'passed' END, ',' ORDER BY rn DESC) FILTER (rn <= 5) AS last_results
          FROM l WHERE rn <= 10 GROUP BY 1)
    SELECT * FROM g WHERE n_runs >= 3 AND failure_rate > 0 AND failure_rate < 0.7
    """,
)
def flaky_names(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return hs.flaky_names(rows, "user_id", "failed", NEWEST)
