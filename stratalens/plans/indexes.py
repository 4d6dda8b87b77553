"""Queries over indexes and versioned snapshots that are built from the test tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, index, maintenance, registry, terms
from ..session import fresh_path, materialize, table
from ..sources import records
from ..sources.groups import ColumnGroups
from ..sources.snapshots import SnapshotLog
from ..streaming import consumer, folds
from . import more
from .retrieval import BM25, SEGMENTS, r6, segments

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(
    "q107_vector_index_exact",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, 1 - list_cosine_similarity(v.e, q.e) AS distance FROM v, v q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM p)
SELECT query_id, vec_id, rn::INTEGER AS rank, round(distance, 6) + 0.0 AS distance FROM r WHERE rn <= 10""",
)
def _(s, d):
    """The ten nearest of every vector whose id is divisible by 50, by the quantised index, none missed."""
    path = fresh_path(s, "indexes")
    index.build_index(_vectors(s, d), path, rounds=3)
    asked = _vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    found = index.search_many(s, path, asked, 10, exact=True)
    return found.select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), "rank", (r6("distance") + 0.0).alias("distance"))


@query("q108_vector_index_recall")
def _(s, d):
    """How many of the ten nearest the index finds without going back, of every vector whose id is divisible by 50."""
    path = fresh_path(s, "indexes")
    index.build_index(_vectors(s, d), path, rounds=3)
    asked = _vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    fast = index.search_many(s, path, asked, 10).select("qid", "id", F.lit(1).alias("hit"))
    sure = index.search_many(s, path, asked, 10, exact=True).select("qid", "id")
    return sure.join(fast, ["qid", "id"], "left").groupBy(F.col("qid").alias("query_id")).agg(F.count("*").alias("nearest"), F.count("hit").alias("found"))


@query("q109_term_index_topk", f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25 DESC, doc_id LIMIT 20")
def _(s, d):
    """q10's search, by the blocks of an index."""
    path = fresh_path(s, "indexes")
    terms.build_terms(table(s, d, "documents"), path, size=256)
    found = terms.search_terms(s, path, "the public license", 20)
    return found.hits.select(F.col("key").alias("doc_id"), r6("score").alias("bm25"))


@query(
    "q110_snapshot_versions",
    """WITH v AS (SELECT unnest(range(3)) AS version), o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS since FROM orders)
SELECT version, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(CASE WHEN since > 0 THEN o_orderpriority END) AS n_priorities, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM v JOIN o ON since <= version GROUP BY version""",
)
def _(s, d):
    """Orders taken in manifest by manifest, a column more from the second on; every version is read again."""
    orders = table(s, d, "orders").withColumn("_manifest", F.col("o_orderstatus"))
    log = SnapshotLog(s, fresh_path(s, "snapshots"))
    log.append({"orders": orders.drop("o_orderpriority")}, ["F"])
    log.append({"orders": orders}, ["F", "O"])
    log.append({"orders": orders}, ["P", "O", "F"])
    out = None
    for version in range(3):
        rows = log.read("orders", version)
        priorities = F.count("o_orderpriority") if "o_orderpriority" in rows.columns else F.lit(0).cast("long")
        one = rows.agg(F.lit(version).cast("long").alias("version"), F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), priorities.alias("n_priorities"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "q111_consumer_claims",
    """WITH p AS (SELECT user_id, user_id % 4 <> 0 AS ok, max((event_id % 3 = 0)::INT) AS a, max((event_id % 3 = 1)::INT) AS b, max((event_id % 3 = 2)::INT) AS c FROM events GROUP BY user_id),
f AS (SELECT *, a + 2 * b AS tried FROM p)
SELECT user_id, CASE WHEN ok THEN 'COMPLETED' WHEN c = 1 AND tried >= 3 THEN 'DLQ' ELSE 'FAILED' END AS status, CASE WHEN ok THEN CASE WHEN a = 1 THEN 1 WHEN b = 1 THEN 2 ELSE 1 END WHEN tried >= 3 THEN 3 ELSE tried + c END::BIGINT AS attempts FROM f""",
)
def _(s, d):
    """Three batches of events; the second one crashes after its claims and is run again; state is compacted after it."""
    e = table(s, d, "events").select("event_id", "user_id")
    one = F.struct(F.lit("b").alias("bucket"), F.col("user_id").cast("string").alias("name"), F.lit("1").alias("generation"), F.lit("s").alias("stream_id"))
    messages = e.select("event_id", F.to_json(F.struct(F.array(one).alias("events"))).alias("value"))
    path = fresh_path(s, "consumers")

    def work(events):
        return events.select("key", (F.col("name").cast("long") % 4 != 0).alias("ok"), F.lit(None).cast("string").alias("digest"))

    def crash(events):
        raise InterruptedError("the first run of the second batch ends here")

    for batch in range(3):
        own = messages.where(F.col("event_id") % 3 == batch).select("value")
        if batch == 1:
            try:
                consumer.consume(own, batch, path, crash, attempts=3)
            except InterruptedError:
                pass  # what is registered is what comes after
        consumer.consume(own, batch, path, work, attempts=3, compact_every=2)
    users = e.select("user_id").distinct().select("user_id", F.lit("b").alias("bucket"), F.col("user_id").cast("string").alias("name"), F.lit("1").alias("generation"))
    return users.withColumn("key", consumer.event_key()).join(consumer.latest_state(s, path), "key").select("user_id", "status", "attempts")


PAGES = 5


@query(
    "q112_keyset_pages",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(value, 0) END AS score, CASE WHEN event_id % 5 <> 0 THEN user_id % 10 END AS asset FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, asset NULLS FIRST, event_id) AS n, count(*) OVER () AS total FROM e)
SELECT event_id, ((n - 1) // ((total + {PAGES} - 1) // {PAGES}))::INTEGER AS page FROM r""",
)
def _(s, d):
    """All events in five pages, each found from the last row of the one before; scores and assets are tied and null."""
    e = table(s, d, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.round("value", 0))
    rows = e.select("event_id", value.alias("score"), F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 10).alias("asset"))
    keys = [fusion.SortKey("score", descending=True), fusion.SortKey("asset"), fusion.SortKey("event_id")]
    limit = -(-rows.count() // PAGES)
    out, cursor, number = None, None, 0
    while number == 0 or cursor:
        page = materialize(fusion.keyset_page(rows, {"q": "all"}, keys, limit, cursor))
        last = page.orderBy(*[k.order() for k in keys]).tail(1) if page.count() == limit else None
        cursor = fusion.keyset_cursor({"q": "all"}, "", keys, last[0]) if last else None
        one = page.select("event_id", F.lit(number).alias("page"))
        out, number = one if out is None else out.unionAll(one), number + 1
    return out


@query(
    "q113_one_long_key",
    """WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS "at", row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
nx AS MATERIALIZED (SELECT rn, least(rn + 50, 1 + count(*) OVER (ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 3599999 FOLLOWING)) AS nxt FROM e),
s AS (SELECT 1::BIGINT AS rn UNION ALL SELECT nxt FROM s JOIN nx USING (rn) WHERE nxt <= (SELECT max(rn) FROM e))
SELECT event_id, (sum(CASE WHEN s.rn IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY e.rn))::BIGINT - 1 AS batch FROM e LEFT JOIN s ON s.rn = e.rn""",
)
def _(s, d):
    """All events under one key, folded in ranges: batches of fifty, or of an hour."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    e = table(s, d, "events").select("event_id", F.lit("all").alias("key"), at.alias("at"))
    rows = max(1, e.count() // 8)
    return folds.flush_batches(e, "key", "at", latency_ms=3_600_000, longest=rows).select("event_id", "batch")


@query(
    "q114_one_long_asset",
    f"""WITH {SEGMENTS}, o AS (SELECT *, max(end_ms) OVER (ORDER BY start_ms, end_ms, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (ORDER BY start_ms, end_ms, evidence_id) AS rn FROM segments),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms > before + 20000 THEN 1 ELSE 0 END) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged, round(max(score), 6) AS score FROM i GROUP BY island""",
)
def _(s, d):
    """All segments as those of one asset, merged in ranges."""
    one = segments(s, d).withColumn("asset_id", F.lit(1))
    merged = fusion.merge_intervals(one, ["asset_id"], 20_000, tie=("evidence_id",), longest=max(1, one.count() // 8))
    return merged.select("start_ms", "end_ms", "n_merged", r6("score").alias("score"))


@query("q115_registry_lookup", more.SQL["q90_dedupe_lookup"])
def _(s, d):
    """q90's lookup over a registry of two generations, of which only buckets that may hold a digest are read."""
    incoming, done = more.lookup_tables(s, d)
    own = registry.Registry.create(s, fresh_path(s, "registries"), done.schema, ["digest"], buckets=16)
    english = F.col("pipeline_version") == "en"
    own.append(done.where(english))
    own.append(done.where(~english | english.isNull()))
    return maintenance.find_completed(incoming, own.matching(incoming)).select("id", "found", "cache_hit")


@query("q116_registry_unseen", "SELECT conv_id, turn FROM conversations WHERE text IS NULL OR text NOT IN (SELECT text FROM conversations WHERE turn = 0 AND text IS NOT NULL)")
def _(s, d):
    """Turns whose text no conversation begins with."""
    turns = table(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    begins = turns.where("turn = 0").select("digest")
    own = registry.Registry.create(s, fresh_path(s, "registries"), begins.schema, ["digest"], buckets=16)
    own.append(begins)
    return own.unseen(turns).select("conv_id", "turn")


@query("q117_bucketed_stitch", "SELECT doc_id, lang, n_chars, sha256(text) AS digest FROM documents")
def _(s, d):
    """q33's groups, written in matching buckets and joined where they lie."""
    docs = table(s, d, "documents").select("*", F.col("_metadata.file_name").alias("group_id"), F.col("_metadata.row_index").alias("row_number"))
    groups = ColumnGroups.create(s, fresh_path(s, "groups"), buckets=8)
    for name, columns in {"core": ["doc_id", "lang"], "body": ["text"], "size": ["n_chars"]}.items():
        groups.write(name, docs.select("group_id", "row_number", *columns))
    return groups.stitch("core", "body", "size").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))


@query(
    "q118_message_parts",
    """WITH e AS (SELECT user_id AS batch, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id::VARCHAR) - 1 AS n FROM events)
SELECT batch, min(n) AS first, count(*)::INTEGER AS n, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_type, event_id::VARCHAR)) AS digest FROM e GROUP BY batch, n // 7""",
)
def _(s, d):
    """Events of a user in messages of seven."""
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("generation"))
    sent = records.as_messages(e, F.col("user_id"), ["name", "generation"], most=7)
    ids = F.from_json("value", "events array<struct<name: string, generation: string>>")["events"]["generation"]
    return sent.select("batch", "first", F.size(ids).alias("n"), F.sha2(F.array_join(ids, ","), 256).alias("digest"))
