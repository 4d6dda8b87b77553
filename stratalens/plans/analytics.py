"""Reports, graph maintenance, policies and streams over the test tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, graph, policy, reports
from ..session import fresh_path, table, with_rank
from ..sources import readers
from ..streaming import folds

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def millis(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")


PCT = "round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.95), 6) AS p95, round(quantile_cont({0}, 0.99), 6) AS p99"


@query("q25_percentile_summary", f"SELECT event_type, count(*) AS n, {PCT.format('value')} FROM events GROUP BY event_type")
def _(s, d):
    return reports.summary(table(s, d, "events"), ["event_type"], "value")


@query("q26_ingest_baseline", "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS n, round(quantile_cont(k, 0.95), 6) AS p95_k, round(avg(CASE WHEN k < 5 THEN 1.0 ELSE 0.0 END), 6) AS cold_rate, round(count(DISTINCT user_id) / count(*)::DOUBLE, 6) AS instance_rate, round(quantile_cont(value, 0.95) FILTER (k < 5), 6) AS p95_cold, round(quantile_cont(value, 0.95) FILTER (k >= 5), 6) AS p95_warm FROM e GROUP BY event_type")
def _(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    cold, warm = F.when(F.col("k") < 5, F.col("value")), F.when(F.col("k") >= 5, F.col("value"))
    p95 = reports.exact_percentiles(e, ["event_type"], {"p95_k": ("k", 0.95), "p95_cold": (cold, 0.95), "p95_warm": (warm, 0.95)})
    rates = e.groupBy("event_type").agg(reports.rate(F.col("k") < 5).alias("cold_rate"), F.round(F.count_distinct("user_id") / F.count("*"), 6).alias("instance_rate"))
    return p95.join(rates, "event_type").select("event_type", "n", "p95_k", "cold_rate", "instance_rate", "p95_cold", "p95_warm")


@query("q27_quality_rules", "WITH w AS (SELECT doc_id, n_chars, len(regexp_extract_all(text, '(\\S+)', 1)) AS words FROM documents) SELECT doc_id, reason FROM (SELECT doc_id, 'short' AS reason FROM w WHERE words < 50 UNION ALL SELECT doc_id, 'long' FROM w WHERE n_chars > 10000 UNION ALL SELECT doc_id, 'long_words' FROM w WHERE n_chars > 8 * words)")
def _(s, d):
    w = table(s, d, "documents").select("doc_id", "n_chars", tx.token_count(F.col("text")).alias("words"))
    return reports.violations(w, {"short": F.col("words") < 50, "long": F.col("n_chars") > 10000, "long_words": F.col("n_chars") > 8 * F.col("words")}).select("doc_id", "reason")


@query("q28_cost_rollup", "WITH c AS (SELECT o_orderpriority AS tier, sum(l_extendedprice * (1 - l_discount)) AS cost, sum(l_extendedprice) AS gross, count(*) AS vectors FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT tier, vectors, round(cost, 2) AS cost, round((1 - cost / gross) * 100, 2) AS saved_percent FROM c")
def _(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = li.groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("vectors"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"), F.sum("l_extendedprice").alias("gross"))
    return c.select("tier", "vectors", F.round("cost", 2).alias("cost"), reports.delta_percent(F.col("gross"), F.col("cost")).alias("saved_percent"))


@query("q29_guardrail_violations", "WITH u AS (UNPIVOT (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME component VALUE value), p AS (SELECT component, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS baseline_p95 FROM u GROUP BY component) SELECT component, round(p95, 6) AS p95, round(baseline_p95, 6) AS baseline_p95 FROM p WHERE p95 > baseline_p95 * 1.85")
def _(s, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    u = reports.unpivot(table(s, d, "lineitem").select("l_orderkey", *cols), ["l_orderkey"], cols)
    both = reports.exact_percentiles(u, ["component"], {"p95": ("value", 0.95), "baseline_p95": ("value", 0.5)})
    out = reports.guardrails(both.select("component", "p95"), both.select("component", "baseline_p95"), 1.85)
    return out.select("component", F.round("p95", 6).alias("p95"), F.round("baseline_p95", 6).alias("baseline_p95"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_orderdate AS completed_at, o_orderpriority = '1-URGENT' AND o_orderkey % 500 = 0 AS is_compaction, sha256(o_orderkey::VARCHAR) AS digest FROM orders)"


def _runs(s, d) -> DataFrame:
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 500 == 0)).alias("is_compaction"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))


@query("q32_manifest_selection", f"WITH {RUNS}, k AS (SELECT * FROM runs WHERE completed_at >= coalesce((SELECT max(completed_at) FROM runs WHERE is_compaction), TIMESTAMP '1900-01-01')), b AS (SELECT substr(sha256(run_id::VARCHAR || ':' || digest), 1, 3) AS bucket, run_id::VARCHAR || ':' || digest AS line FROM k), s AS (SELECT bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM b GROUP BY bucket) SELECT (SELECT count(*) FROM k) AS n_runs, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS fingerprint FROM s")
def _(s, d):
    kept = graph.since_latest_compaction(_runs(s, d))
    return graph.manifest_fingerprint(kept, "run_id", "digest").crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_runs")))).select("n_runs", "fingerprint")


@query("q33_column_group_stitch", "SELECT doc_id, lang, n_chars, sha256(text) AS digest FROM documents")
def _(s, d):
    docs = graph.with_provenance(table(s, d, "documents")).withColumnRenamed("file_name", "group_id")
    core, text, size = docs.select("group_id", "row_number", "doc_id", "lang"), docs.select("group_id", "row_number", "text"), docs.select("group_id", "row_number", "n_chars")
    return graph.stitch(core, text, size).select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))


@query("q34_incremental_append", "SELECT o_orderkey::VARCHAR AS run_id, o_totalprice AS bytes, NULL::VARCHAR AS note FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'run-' || o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def _(s, d):
    o = table(s, d, "orders")
    base = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("bytes"))
    fresh = o.where("o_orderkey % 2 = 1").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_totalprice").alias("bytes"), F.col("o_orderstatus").alias("note"))
    return graph.append_by_name(base, fresh)


@query("q35_compaction_plan", "WITH RECURSIVE e AS (SELECT o_orderpriority AS entity, o_orderkey AS run_id, o_totalprice AS bytes, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders), f AS (SELECT entity, run_id, bytes, rn, 0::BIGINT AS batch, bytes AS total, 1 AS n FROM e WHERE rn = 1 UNION ALL SELECT entity, run_id, bytes, rn, CASE WHEN closes THEN batch + 1 ELSE batch END, CASE WHEN closes THEN bytes ELSE total + bytes END, CASE WHEN closes THEN 1 ELSE n + 1 END FROM (SELECT e.*, f.batch, f.total, f.n, f.total >= 1000000 OR f.total + e.bytes > 2000000 OR f.n >= 10 AS closes FROM f JOIN e ON e.entity = f.entity AND e.rn = f.rn + 1)) SELECT entity, run_id, bytes, batch FROM f")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("entity"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("bytes"))
    return graph.first_fit_batches(o, "entity", "run_id", "bytes", low=1_000_000.0, high=2_000_000.0, most=10)


@query("q36_gc_plan", f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY is_compaction ORDER BY completed_at DESC, run_id DESC) AS c, row_number() OVER (ORDER BY completed_at DESC, run_id DESC) AS l FROM runs), k AS (SELECT run_id FROM r WHERE completed_at >= TIMESTAMP '2024-10-01' OR (is_compaction AND c <= 2) OR l <= 5) SELECT l_orderkey AS run_id, count(*) AS files, round(sum(l_extendedprice), 2) AS bytes FROM lineitem WHERE l_orderkey NOT IN (SELECT run_id FROM k) GROUP BY l_orderkey")
def _(s, d):
    kept = graph.keep_set(_runs(s, d), since=F.lit("2024-10-01").cast("timestamp_ntz"), compactions=2, latest=5).select(F.col("run_id").alias("l_orderkey")).distinct()
    files = table(s, d, "lineitem").join(kept, "l_orderkey", "left_anti")
    return files.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("files"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"))


@query("q37_retention_tier", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN a >= 900 THEN 'delete' WHEN a >= 400 THEN 'cold' WHEN a >= 100 THEN 'warm' ELSE 'hot' END AS tier FROM (SELECT date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS a FROM orders)) GROUP BY tier")
def _(s, d):
    age = F.date_diff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(s, d, "orders").select(policy.retention_tier(age, 100, 400, 900).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("q38_successor_edges", "SELECT conv_id, turn AS src, dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL")
def _(s, d):
    return graph.successors(table(s, d, "conversations"), "conv_id", "turn", "turn")


@query("q39_dedupe_hash", "SELECT sha256(text) AS digest, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY text")
def _(s, d):
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@query("q40_audit_query", "SELECT event_id, event_type, user_id, round(value, 6) AS value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id LIMIT 100")
def _(s, d):
    e = table(s, d, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    found = readers.audit_log(e, since="2024-01-05T01:00:00+01:00", event_type="click", user_id=None, tie=["event_id"])
    return found.select("event_id", "event_type", "user_id", F.round("value", 6).alias("value"))


@query("q41_alert_match", "SELECT event_id, rule FROM events JOIN (VALUES ('high', 'purchase', 0.2), ('any', '*', 0.5), ('clicks', 'click', 0.3)) r(rule, t, m) ON (t = '*' OR t = event_type) AND value / 500 >= m")
def _(s, d):
    rules = s.createDataFrame([("high", ["purchase"], None, 0.2, None), ("any", ["*"], [], 0.5, []), ("clicks", ["click"], None, 0.3, None)], "rule string, types array<string>, modalities array<string>, min_confidence double, rule_tags array<string>")
    e = table(s, d, "events").select("event_id", "event_type", F.lit("image").alias("modality"), (F.col("value") / 500).alias("confidence"), F.array(F.lit("person")).alias("tags"))
    return policy.match_rules(e, rules).select("event_id", "rule")


@query("q42_abac", "SELECT c_custkey, NOT (c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_nationkey = 3) AND NOT c_nationkey IN (1, 2) AS allowed FROM customer")
def _(s, d):
    rules = [{"effect": "deny", "conditions": {"c_mktsegment": ["MACHINERY", "BUILDING"], "c_nationkey": 3}}, {"effect": "allow", "conditions": {"c_nationkey": [3, 4]}}, {"effect": "deny", "conditions": {"c_nationkey": [1, 2]}}]
    return table(s, d, "customer").select("c_custkey", policy.attribute_decision(table(s, d, "customer"), rules, True).alias("allowed"))


@query("q43_rbac", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN true WHEN c_nationkey % 2 = 0 THEN c_mktsegment = 'BUILDING' ELSE true END AS allowed FROM customer")
def _(s, d):
    role = F.when(F.col("c_nationkey") == 0, "admin").when(F.col("c_nationkey") % 2 == 0, "reader").otherwise("editor")
    may = policy.role_allows(F.array(role), {"reader": ["BUILDING"], "editor": ["*"]}, F.col("c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", may.alias("allowed"))


@query("q44_privacy_types", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'pii,email' ELSE 'pii' END || CASE WHEN n_nationkey < 5 THEN ',phone' ELSE '' END AS types FROM nation")
def _(s, d):
    rules = [{"types": ["pii"], "contexts": ["query"]}, {"types": ["email", "pii"], "org_id": "1"}, {"types": ["phone"], "modalities": ["low"]}, {"types": ["ssn"], "enabled": False}, {"types": ["ssn"], "contexts": ["export"]}]
    modality = F.when(F.col("n_nationkey") < 5, "low").otherwise("high")
    return table(s, d, "nation").select("n_name", F.array_join(policy.redaction_types(rules, modality, F.col("n_regionkey").cast("string"), "query"), ",").alias("types"))


@query("q45_rate_limit_tumbling", "WITH w AS (SELECT event_id, event_type, epoch_us(ts) // 60000000 * 60 AS window_start, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 60000000 ORDER BY ts, event_id) AS nth FROM events) SELECT event_id, window_start, nth, nth <= 2 AS allowed FROM w")
def _(s, d):
    return folds.tumbling_limit(table(s, d, "events"), ["event_type"], "ts", 2).select("event_id", "window_start", F.col("nth").cast("long"), "allowed")


@query("q46_hopping_windows", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 3600000000 * 3600, epoch_us(ts) // 3600000000 * 3600 - 3600]) AS w FROM events) GROUP BY w")
def _(s, d):
    return folds.hopping(table(s, d, "events"), "ts", "2 hours", "1 hour")


def _timed(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", millis().alias("at"), F.when(F.col("value") > 400, "ok").when(F.col("value") > 200, "failed").otherwise("running").alias("outcome"))


TIMED = "e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS \"at\", CASE WHEN value > 400 THEN 'ok' WHEN value > 200 THEN 'failed' ELSE 'running' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events)"


@query("q47_idempotency_fold", f"WITH RECURSIVE {TIMED}, f AS (SELECT e.*, 'start' AS action, CASE outcome WHEN 'ok' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'running' END AS state, \"at\" AS since, 1 AS tries FROM e WHERE rn = 1 UNION ALL SELECT event_id, user_id, \"at\", outcome, rn, action, CASE action WHEN 'start' THEN CASE outcome WHEN 'ok' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'running' END WHEN 'dead' THEN 'dead' ELSE state END, CASE action WHEN 'start' THEN \"at\" ELSE since END, CASE action WHEN 'start' THEN tries + 1 ELSE tries END FROM (SELECT e.*, f.state, f.since, f.tries, CASE WHEN f.state IN ('done', 'dead') THEN 'skip_done' WHEN f.state = 'running' AND e.\"at\" - f.since < 86400000 THEN 'skip_running' WHEN f.tries >= 5 THEN 'dead' ELSE 'start' END AS action FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)) SELECT event_id, user_id, \"at\", outcome, action FROM f")
def _(s, d):
    return folds.idempotency(_timed(s, d), "user_id", "at", "outcome", ttl_ms=86_400_000, attempts=5)


TYPES = ["click", "purchase", "view"]


@query("q48_stage_timings", "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{t}'), 0), 6) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY user_id")
def _(s, d):
    out = reports.stage_timings(table(s, d, "events"), ["user_id"], "event_type", "value", TYPES)
    return out.select("user_id", *[F.round(t, 6).alias(t) for t in TYPES])


@query("q49_rollout_stages", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN rn <= ceil(10 * n / 100.0) THEN 1 WHEN rn <= ceil(50 * n / 100.0) THEN 2 ELSE 3 END::BIGINT AS stage FROM r")
def _(s, d):
    return graph.rollout_stages(table(s, d, "supplier").select("s_suppkey"), "s_suppkey")


@query("q50_row_to_text", "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', r_name: ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    both = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", tx.row_to_text(both, ["n_nationkey", "n_name", "r_name"]).alias("text"))


@query("q51_even_sampling", "WITH n AS (SELECT count(*) AS n FROM part), p AS (SELECT DISTINCT round_even(i * (n - 1) / 24.0, 0)::BIGINT AS pos FROM n, range(25) t(i)), o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT pos, p_partkey FROM o JOIN p USING (pos)")
def _(s, d):
    part = table(s, d, "part").select("p_partkey")
    at = with_rank(part, "p_partkey", name="pos").withColumn("pos", F.col("pos") - 1)
    return at.where(F.col("pos").isin(graph.even_positions(part.count(), 25))).select("pos", "p_partkey")


@query("q52_last_run", "SELECT o_custkey, max(o_orderdate)::VARCHAR AS last_run, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, bool_or(o_orderstatus = 'O') AS active FROM orders GROUP BY o_custkey")
def _(s, d):
    o = table(s, d, "orders")
    return o.groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("last_run"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"), F.bool_or(F.col("o_orderstatus") == "O").alias("active"))


@query("q53_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    """A stream over the events table, read once and written to a table; deduplicated by user and type in a watermark."""
    source = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    target = fresh_path(s, "stream_dedupe")
    out = folds.dedupe_stream(source, ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")
    run = out.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{target}/out")


@query("q54_batch_flush", f"WITH RECURSIVE {TIMED}, f AS (SELECT e.*, 0::BIGINT AS batch, 1 AS n, \"at\" AS oldest FROM e WHERE rn = 1 UNION ALL SELECT event_id, user_id, \"at\", outcome, rn, CASE WHEN closes THEN batch + 1 ELSE batch END, CASE WHEN closes THEN 1 ELSE n + 1 END, CASE WHEN closes THEN \"at\" ELSE oldest END FROM (SELECT e.*, f.batch, f.n, f.oldest, f.n >= 50 OR e.\"at\" - f.oldest >= 3600000 AS closes FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)) SELECT event_id, user_id, \"at\", batch FROM f")
def _(s, d):
    return folds.flush_batches(_timed(s, d).select("event_id", "user_id", "at"), "user_id", "at", most=50, latency_ms=3_600_000)


@query("q55_token_bucket", f"WITH RECURSIVE {TIMED}, f AS (SELECT e.*, true AS allowed, 0.0::DOUBLE AS remains FROM e WHERE rn = 1 UNION ALL SELECT event_id, user_id, \"at\", outcome, rn, filled >= 1, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END FROM (SELECT e.*, least(1.0::DOUBLE, f.remains + (e.\"at\" - f.\"at\") * 1 / 60000::DOUBLE) AS filled FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)) SELECT event_id, user_id, \"at\", allowed FROM f")
def _(s, d):
    return folds.token_bucket(_timed(s, d).select("event_id", "user_id", "at"), "user_id", "at", per_minute=1)


@query("q56_confident_top", "WITH x AS (SELECT user_id, value / 500 AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events), l AS (SELECT *, lead(score) OVER (PARTITION BY user_id ORDER BY rn) AS nxt FROM x) SELECT user_id, round(score, 6) AS score, round(score - nxt, 6) AS gap, score - nxt >= 0.01 AND score >= 0.9 AS confident FROM l WHERE rn = 1")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = table(s, d, "events").withColumn("score", F.col("value") / 500).withColumn("rn", F.row_number().over(w)).withColumn("nxt", F.lead("score").over(w)).where("rn = 1")
    gap = F.col("score") - F.col("nxt")
    return e.select("user_id", F.round("score", 6).alias("score"), F.round(gap, 6).alias("gap"), ((gap >= 0.01) & (F.col("score") >= 0.9)).alias("confident"))


@query("q57_evidence_bundle", "SELECT conv_id AS asset_id, 'transcript' AS kind, turn AS at FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 8 UNION ALL SELECT doc_id, 'document', n_chars FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)")
def _(s, d):
    talk = fusion.group_moments(table(s, d, "conversations").withColumn("score", F.lit(1.0)), "conv_id", order=[F.col("turn")], keep=8)
    docs = table(s, d, "documents").join(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return talk.select(F.col("conv_id").alias("asset_id"), F.lit("transcript").alias("kind"), F.col("turn").alias("at")).unionAll(docs.select("doc_id", F.lit("document"), "n_chars"))
