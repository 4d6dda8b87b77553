"""Control decisions over the test tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control
from ..session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("q58_adaptive_batch", "WITH b AS (SELECT p_partkey, p_size * 3 AS backlog FROM part), r AS (SELECT *, least(1.0, greatest(0.0, (backlog - 10) / 90.0::DOUBLE)) AS s FROM b) SELECT p_partkey, floor(1 + s * 49)::BIGINT AS batch, floor(s * 2000)::BIGINT AS delay, backlog < 100 AS accepted FROM r")
def _(s, d):
    b = table(s, d, "part").select("p_partkey", (F.col("p_size") * 3).alias("backlog"))
    return b.select("p_partkey", control.adaptive_batch(F.col("backlog")).alias("t"), control.accepts(F.col("backlog"), 100).alias("accepted")).select("p_partkey", "t.batch", "t.delay", "accepted")


@query("q59_buffer_eviction", "WITH i AS (SELECT event_id, user_id, value, date_diff('day', ts::DATE, DATE '2024-02-01') AS age FROM events), h AS (SELECT *, sum(CASE WHEN age < 20 THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY age, event_id ROWS UNBOUNDED PRECEDING) AS held FROM i) SELECT event_id, age >= 20 OR held > 2000 AS evicted FROM h")
def _(s, d):
    i = table(s, d, "events").select("event_id", "user_id", "value", F.date_diff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).alias("age"))
    return control.evicted(i, "user_id", "age", "value", order=[F.asc_nulls_last("age"), F.asc_nulls_last("event_id")], ttl=20, most=2000).select("event_id", "evicted")


@query("q60_call_stats", "SELECT event_type, count(*) AS calls, round(sum(value), 2) AS total, round(avg(value), 2) AS avg, round(min(value), 2) AS min, round(max(value), 2) AS max FROM events GROUP BY event_type")
def _(s, d):
    return control.call_stats(table(s, d, "events"), "event_type", "value")


@query("q61_schedule_due", "SELECT event_id, minute(ts) % 15 = 0 AS quarter, hour(ts) IN (3, 4) AND minute(ts) = 30 AS night, dayofweek(ts) = 0 AS sunday FROM events")
def _(s, d):
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    never = F.lit(None).cast("timestamp")
    due = lambda x: control.schedule_due(x, F.col("at"), never)
    return e.select("event_id", due("*/15 * * * *").alias("quarter"), due("30 3,4 * * *").alias("night"), due("* * * * 7").alias("sunday"))


@query("q62_transcript_status", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'skipped_by_policy' WHEN user_id % 7 = 0 THEN 'no_audio_track' WHEN user_id % 5 = 0 THEN 'no_speech' WHEN value > 300 THEN 'skipped_by_policy' WHEN user_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM events")
def _(s, d):
    u = F.col("user_id")
    return table(s, d, "events").select("event_id", control.transcript_status(F.col("event_type") != "view", u % 7 != 0, u % 5 != 0, F.col("value"), F.lit(300), 1 - u % 2).alias("status"))


@query("q63_transcription_limit", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 500 WHEN c_nationkey = 1 THEN 900 ELSE 1000 END::BIGINT AS max_ms, CASE WHEN c_nationkey = 0 THEN 'org' WHEN c_nationkey = 1 THEN 'plan' ELSE 'global' END AS source FROM customer")
def _(s, d):
    n = F.col("c_nationkey")
    org, plan = F.when(n == 0, 500).when(n == 2, 2000), F.when(n == 1, 900).when(n == 0, 800).when(n == 3, 0)
    return table(s, d, "customer").select("c_custkey", control.transcription_limit(F.lit(1000), org, plan).alias("t")).select("c_custkey", "t.max_ms", "t.source")


@query("q64_audio_windows", "WITH a AS (SELECT p_partkey, p_size * 1000 AS f, 8000 AS r FROM part), w AS (SELECT *, unnest(range(least(6, CAST(ceil(f / 4000.0) AS BIGINT)))) AS win FROM a WHERE f > 0) SELECT p_partkey, win AS window_index, floor(win * 4000 * 1000 / r)::BIGINT AS start_ms, floor(least(f, win * 4000 + 16000) * 1000 / r)::BIGINT AS end_ms FROM w")
def _(s, d):
    a = table(s, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("f"), F.lit(8000).alias("r"))
    return control.audio_windows(a, "f", "r", window_s=2.0, hop_s=0.5, most=6).select("p_partkey", F.col("window").alias("window_index"), "start_ms", "end_ms")


@query("q65_speech", "SELECT user_id, sum(CASE WHEN value >= 100 THEN 30 ELSE 0 END)::BIGINT AS speech_ms, sum(CASE WHEN value >= 100 THEN 0 ELSE 30 END)::BIGINT AS silence_ms, sum(CASE WHEN value >= 100 THEN 30 ELSE 0 END) >= 300 AS has_speech FROM events GROUP BY user_id")
def _(s, d):
    return control.speech(table(s, d, "events").withColumn("ms", F.lit(30)), "user_id", "value", "ms", silence=100.0)


@query("q66_merged_version", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'mixed' END AS lang FROM documents GROUP BY source")
def _(s, d):
    return control.merged_version(table(s, d, "documents"), "source", "lang")


@query("q67_queue_depth", "SELECT event_type, arg_max(value, ts) AS value FROM events WHERE ts > TIMESTAMP '2024-01-10' - INTERVAL 600 MINUTE AND ts <= TIMESTAMP '2024-01-10' GROUP BY event_type")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return control.latest_depth(e, "event_type", "value", "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"), 36_000).select("event_type", "value")


@query("q68_query_tier", "SELECT event_id, CASE WHEN user_id % 3 = 0 OR event_type = 'click' THEN 'gpu' ELSE 'cpu' END AS tier FROM events")
def _(s, d):
    media = F.when(F.col("event_type") == "click", F.array(F.lit("audio"))).otherwise(F.array(F.lit("text")))
    return table(s, d, "events").select("event_id", control.query_tier(F.col("user_id") % 3 == 0, media).alias("tier"))


@query("q69_hardening", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'tls' ELSE '' END || CASE WHEN s_nationkey < 10 AND s_acctbal < 0 THEN ',' ELSE '' END || CASE WHEN s_acctbal < 0 THEN 'disk' ELSE '' END AS missing FROM supplier")
def _(s, d):
    checks = {"tls": F.col("s_nationkey") >= 10, "disk": F.col("s_acctbal") >= 0}
    return table(s, d, "supplier").select("s_suppkey", F.array_join(control.missing_checks(checks), ",").alias("missing"))
