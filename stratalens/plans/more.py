"""Whole searches, ingest, upkeep, records and consumers over the test tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import decibels
from ..operators import compose, control, fusion, graph, maintenance, reports, search
from ..session import table
from ..sources import files, readers, records
from ..streaming import consumer

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- searches: an asset is what a source has in a language; English and German texts are chunks, a quarter of them
# read off pages; French ones are images, Spanish ones sound segments


def snapshot(s: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = table(s, d, "documents")
    asset = F.concat_ws("-", "source", "lang").alias("media_asset_id")
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    own = lambda langs, *cols: docs.where(F.col("lang").isin(langs)).select(F.col("doc_id").alias("id"), asset, *cols).join(vectors, "id")
    start = F.col("doc_id") * 1000
    return {
        "media_assets": docs.groupBy("source", "lang").agg(F.first("lang").alias("media_type")).select(F.concat_ws("-", "source", "lang").alias("id"), F.concat(F.lit("src://"), F.col("source"), F.lit("/"), F.col("lang")).alias("uri"), "media_type", F.col("source").alias("org_id")),
        "doc_chunks": own(["en", "de"], F.col("text").alias("content"), F.when(F.col("doc_id") % 4 == 0, "pdf_page").otherwise("text").alias("source_type"), F.col("n_chars").alias("source_time_ms")),
        "image_assets": own(["fr"], F.col("n_chars").alias("timestamp_ms")),
        "audio_segments": own(["es"], start.alias("start_ms"), (start + 5000).alias("end_ms")),
    }


def first_vector(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id = 0").select("embedding")


FOUND = """qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
al AS (SELECT doc_id, source || '-' || lang AS asset_id, lang, text, n_chars, greatest(0, least(1, 1 - distance)) AS score, distance FROM (SELECT d.*, 1 - list_cosine_similarity(e.embedding::DOUBLE[], (SELECT q FROM qv)) AS distance FROM documents d JOIN embeddings e ON vec_id = doc_id)),
dc AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'ocr' ELSE 'document' END AS modality, doc_id, asset_id, lang, CASE WHEN doc_id % 4 = 0 THEN n_chars END AS start_ms, CASE WHEN doc_id % 4 = 0 THEN n_chars END AS end_ms, text AS snippet, score, 0 AS branch_ord, 1 AS refs FROM (SELECT * FROM al WHERE lang IN ('en', 'de') ORDER BY distance, doc_id LIMIT 20)),
im AS (SELECT 'image' AS modality, doc_id, asset_id, lang, n_chars AS start_ms, n_chars AS end_ms, NULL AS snippet, least(1, score * 1.05) AS score, 1 AS branch_ord, 1 AS refs FROM (SELECT * FROM al WHERE lang = 'fr' ORDER BY distance, doc_id LIMIT 20)),
a0 AS (SELECT doc_id, asset_id, lang, doc_id * 1000 AS start_ms, doc_id * 1000 + 5000 AS end_ms, least(1, score * 1.05) AS score FROM (SELECT * FROM al WHERE lang = 'es' ORDER BY distance, doc_id LIMIT 20)),
a1 AS (SELECT *, max(end_ms) OVER (PARTITION BY asset_id ORDER BY start_ms, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a0),
a2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms > pe + 200000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY start_ms, doc_id ROWS UNBOUNDED PRECEDING) AS island FROM a1),
au AS (SELECT 'audio' AS modality, arg_max(doc_id, (score, -start_ms)) AS doc_id, asset_id, min(lang) AS lang, min(start_ms) AS start_ms, max(end_ms) AS end_ms, NULL AS snippet, max(score) AS score, 2 AS branch_ord, count(*) AS refs FROM a2 GROUP BY asset_id, island),
hits AS (SELECT * FROM (SELECT * FROM dc UNION ALL SELECT * FROM im UNION ALL SELECT * FROM au) u ORDER BY u.score DESC, branch_ord, doc_id::VARCHAR LIMIT 20)"""

FUSED = f"""{FOUND}, rk AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM hits WHERE lang <> 'de'),
fu AS (SELECT *, CASE modality WHEN 'image' THEN 0.8::DOUBLE WHEN 'audio' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank) AS f FROM rk),
fs AS (SELECT * EXCLUDE (score), f / max(f) OVER () AS score FROM fu),
cd AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR) AS rn FROM fs WHERE modality IN ('document', 'ocr') AND length(snippet) > 0),
ok AS (SELECT count(*) >= 2 AND NOT (max(score) FILTER (rn = 1) >= 0.9 AND max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2) >= 0.5) AS yes FROM cd WHERE rn <= 20),
rw AS (SELECT doc_id, modality, list_distinct(regexp_extract_all(lower(snippet), '([a-z0-9]+)', 1)) AS ws FROM cd WHERE rn <= 20),
sc AS (SELECT doc_id, modality, CASE WHEN len(list_intersect(ws, ['the', 'public', 'license'])) = 0 THEN 0 ELSE 2.0 * len(list_intersect(ws, ['the', 'public', 'license'])) / (len(ws) + 3) END::DOUBLE AS r FROM rw),
res AS (SELECT fs.* EXCLUDE (score), CASE WHEN r IS NOT NULL AND (SELECT yes FROM ok) THEN 0.5 * score + 0.5 * r ELSE score END AS score FROM fs LEFT JOIN sc USING (doc_id, modality))"""


def _request(**more) -> compose.Request:
    return compose.Request(query="the public license", filters={"not": {"field": "asset_type", "op": "eq", "value": "de"}}, top_k=20, **more)


def _searched(s: SparkSession, d: str, request: compose.Request) -> DataFrame:
    q = first_vector(s, d)
    asked = compose.Request(**{**request.__dict__, "vectors": {"text": q, "clip": q, "clap": q}})
    return compose.run_query(snapshot(s, d), asked, rerank=True, gap_ms=200_000, min_candidates=2, skip_gap=0.5, budget=0)


POLICIES = [{"types": ["email", "phone"], "modalities": ["ocr"], "contexts": ["query"]}, {"types": ["ssn"], "contexts": ["export"]}]
EMAIL, PHONE = tx.PII["email"].removeprefix("(?i)"), tx.PII["phone"]


@query("q71_search_response", f"WITH {FUSED}, o AS (SELECT *, CASE modality WHEN 'image' THEN 'vision' WHEN 'document' THEN 'text' ELSE modality END AS kind, CASE WHEN modality = 'ocr' THEN regexp_replace(regexp_replace(snippet, '{EMAIL}', '[REDACTED]', 'gi'), '{PHONE}', '[REDACTED]', 'g') ELSE snippet END AS shown FROM res), p AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, asset_id, coalesce(start_ms, -1), doc_id::VARCHAR) AS place, count(*) OVER () AS total FROM o) SELECT place, total, asset_id, lang AS asset_type, kind AS modality, start_ms, end_ms, round(score, 6) AS score, doc_id::VARCHAR AS evidence_id, refs::BIGINT AS n_refs, sha256(shown) AS digest FROM p WHERE place BETWEEN 3 AND 10")
def _(s, d):
    """The second page of a search by text, with filters, fusion, reranking and redaction."""
    request = _request(page_limit=8, offset=2)
    out = compose.respond(_searched(s, d, request), request, POLICIES)
    return out.select("place", "total", "asset_id", "asset_type", "modality", "start_ms", "end_ms", "score", F.col("primary_evidence_id").alias("evidence_id"), F.size("evidence_refs").cast("long").alias("n_refs"), F.sha2("snippet", 256).alias("digest"))


@query("q72_search_groups", f"WITH {FUSED}, g AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS clip_count, max(round(score, 6)) OVER (PARTITION BY asset_id) AS best_score FROM res), p AS (SELECT *, dense_rank() OVER (ORDER BY clip_count DESC, asset_id, best_score DESC) AS place FROM g) SELECT place, asset_id, clip_count, best_score, doc_id::VARCHAR AS evidence_id, row_number() OVER (PARTITION BY asset_id ORDER BY round(score, 6) DESC, coalesce(start_ms, -1), doc_id::VARCHAR) AS moment FROM p WHERE place <= 3")
def _(s, d):
    """The first page of the same search, by asset, those with most hits first."""
    request = _request(page_limit=3, group_by="video", sort_by="clip_count")
    out = compose.respond(_searched(s, d, request), request)
    return out.select("place", "asset_id", "clip_count", "best_score", F.col("primary_evidence_id").alias("evidence_id"), "moment")


@query("q73_image_union", f"WITH {FOUND}, sh AS (SELECT 'image' AS modality, doc_id, asset_id, score FROM al WHERE lang = 'fr' ORDER BY distance, doc_id LIMIT 20), u AS (SELECT modality, doc_id, asset_id, score FROM hits UNION ALL SELECT * FROM sh), rk AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM u), f AS (SELECT asset_id, modality, doc_id, sum(CASE WHEN modality IN ('image', 'audio') THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)) AS f, count(*) AS n_hits FROM rk GROUP BY ALL) SELECT asset_id, modality, doc_id::VARCHAR AS evidence_id, n_hits, round(f / (SELECT max(f) FROM f), 6) AS score FROM f")
def _(s, d):
    """A search by a text and an image at once: hits of both branches are one."""
    q = first_vector(s, d)
    request = compose.Request(query="the public license", vectors={"text": q, "clip": q, "clap": q}, image={"v1": q}, top_k=20)
    return compose.run_query(snapshot(s, d), request, gap_ms=200_000).select("asset_id", "modality", "evidence_id", "n_hits", r6("score").alias("score"))


@query("q74_keyword_search", "WITH c AS (SELECT 'document' AS modality, doc_id AS id, source || '-' || lang AS asset_id FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang IN ('en', 'de') AND source = 'src1' AND text ILIKE '%license%' ORDER BY doc_id LIMIT 15), m AS (SELECT 'metadata' AS modality, id, id AS asset_id FROM (SELECT DISTINCT source || '-' || lang AS id, lang FROM documents) WHERE lang = 'fr' ORDER BY id LIMIT 5) SELECT modality, id::VARCHAR AS evidence_id, asset_id, 1.0::DOUBLE AS score FROM c UNION ALL SELECT * , 1.0::DOUBLE FROM m")
def _(s, d):
    """A scoped keyword search, and a metadata search by a filter of the older kind."""
    snap = snapshot(s, d)
    words = compose.search_by_keyword(snap, " license ", top_k=15, scope={"org_id": "src1"})
    kinds = compose.run_query(snap, compose.Request(kind="metadata", filters={"field": "asset_type", "op": "eq", "value": "fr"}, top_k=5))
    return words.select("modality", "evidence_id", F.col("media_asset_id").alias("asset_id"), "score").unionAll(kinds.select("modality", "evidence_id", "asset_id", F.lit(1.0)))


@query("q75_identifier_search", "WITH t AS (SELECT doc_id, source || '-' || lang AS asset_id, regexp_extract_all(lower(text), '([a-z]+)', 1) AS w FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang IN ('en', 'de') AND doc_id % 4 = 0), l AS (SELECT doc_id, asset_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'mit')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM t), g AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM l), bm AS (SELECT doc_id, asset_id, " + " + ".join(f"ln((n - {x} + 0.5) / ({x} + 0.5) + 1) * {y} * 2.2 / ({y} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for x, y in (("da", "a"), ("db", "b"))) + " AS s FROM l, g WHERE a + b > 0) SELECT 'fts' AS modality, doc_id::VARCHAR AS evidence_id, asset_id, round(s / (s + 1), 6) AS score FROM bm ORDER BY bm.s DESC, doc_id LIMIT 10")
def _(s, d):
    """A query that looks like an identifier also goes to the full text of what was read off pages."""
    snap = snapshot(s, d)
    hits = compose.search_by_text(snap, "mit-license", {}, top_k=10, modalities=["ocr"])
    return hits.select("modality", "evidence_id", F.col("media_asset_id").alias("asset_id"), r6("score").alias("score"))


@query("q105_evidence", "WITH d AS (SELECT doc_id, text, n_chars, source || '-' || lang AS asset FROM documents JOIN embeddings ON vec_id = doc_id), f AS (SELECT 'frame' AS kind, n_chars AS at_ms, NULL AS digest FROM d WHERE asset = 'src1-fr' ORDER BY n_chars, doc_id LIMIT 12), t AS (SELECT 'document' AS kind, NULL::BIGINT AS at_ms, sha256(text) AS digest FROM d WHERE asset = 'src1-en' ORDER BY doc_id LIMIT 6) SELECT 'a' AS of, kind, at_ms, digest, 'ready' AS status FROM f UNION ALL SELECT 'b', kind, at_ms, digest, 'ready' FROM t UNION ALL SELECT 'a', NULL, NULL, NULL, 'pending' WHERE NOT EXISTS (SELECT 1 FROM f) UNION ALL SELECT 'b', NULL, NULL, NULL, 'pending' WHERE NOT EXISTS (SELECT 1 FROM t) UNION ALL SELECT 'c', NULL, NULL, NULL, 'pending'")
def _(s, d):
    """Evidence of a French asset (frames), of an English one (texts), and of one that isn't known."""
    snap = snapshot(s, d)
    parts = [compose.evidence(snap, **who).withColumn("of", F.lit(of)) for of, who in (("a", {"uri": "src://src1/fr"}), ("b", {"asset_id": "src1-en"}), ("c", {"uri": "nowhere"}))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("of", "kind", F.col("at").alias("at_ms"), F.sha2("text", 256).alias("digest"), "status")


@query("q76_hit_trace", "WITH qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), t AS (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS d FROM embeddings, qv ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 5) SELECT count(*) AS n, string_agg('vec://' || vec_id, ',' ORDER BY d) AS uris FROM t")
def _(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("vec://"), F.col("vec_id").cast("string")).alias("uri"))
    from ..functions.vectors import cosine_distance

    hits = v.crossJoin(F.broadcast(first_vector(s, d).select(F.col("embedding").alias("q")))).withColumn("distance", cosine_distance("embedding", F.col("q")))
    items = F.from_json("trace", "array<struct<distance:double, uri:string, score:double>>")
    return compose.hit_trace(hits).select(items.alias("i")).select(F.size("i").cast("long").alias("n"), F.array_join(F.transform("i", lambda x: x["uri"]), ",").alias("uris"))


@query("q77_evidence_refs", "SELECT event_id, CASE event_type WHEN 'click' THEN 'doc_chunk_id' WHEN 'view' THEN 'image_asset_id' WHEN 'purchase' THEN 'transcript_segment_id' END AS kind, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_id::VARCHAR END AS ref FROM events")
def _(s, d):
    kind = F.when(F.col("event_type") == "click", "ocr").when(F.col("event_type") == "view", "image").when(F.col("event_type") == "purchase", "transcript").otherwise("metadata")
    refs = compose.evidence_refs(kind, F.col("event_id").cast("string"))
    one = table(s, d, "events").select("event_id", F.get(refs, F.lit(0)).alias("r"))
    return one.select("event_id", F.get(F.map_keys("r"), F.lit(0)).alias("kind"), F.get(F.map_values("r"), F.lit(0)).alias("ref"))


# --- ingest


@query("q78_chunk_offsets", "WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '(\\s*\\S+)', 1) AS p FROM documents), l AS (SELECT doc_id, text, p, list_transform(p, lambda x: length(x)) AS n FROM t WHERE len(p) > 0), c AS (SELECT *, unnest(range(0, len(p), 112)) AS token_start FROM l), e AS (SELECT doc_id, text, token_start, least(token_start + 128, len(p)) AS token_end, list_sum(n[1:least(token_start + 128, len(p))])::BIGINT AS char_end, (list_sum(n[1:token_start + 1]) - length(regexp_replace(p[token_start + 1], '^\\s+', '')))::BIGINT AS char_start FROM c) SELECT doc_id, token_start // 112 AS chunk_index, char_start, char_end, token_start, token_end, sha256(text[char_start + 1:char_end]) AS digest FROM e")
def _(s, d):
    chunks = files.chunk_texts(table(s, d, "documents"), keep=["doc_id"])
    return chunks.select("doc_id", "chunk_index", "char_start", "char_end", "token_start", "token_end", F.sha2("chunk", 256).alias("digest"))


@query("q79_ascii_fold", "SELECT doc_id, sha256(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(tx.ascii_fold(F.col("text")), 256).alias("digest"))


@query("q80_base64url", "SELECT page_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS token, url AS back FROM pages")
def _(s, d):
    token = tx.base64url(F.col("url").cast("binary"))
    return table(s, d, "pages").select("page_id", token.alias("token")).withColumn("back", tx.from_base64url(F.col("token")).cast("string"))


@query("q81_path_rules", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' END AS modality, CASE page_id % 5 WHEN 0 THEN 'docs' WHEN 1 THEN 'images' WHEN 2 THEN 'audio' WHEN 3 THEN 'videos' ELSE 'other' END AS stage, 'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.exe' END AS file, CASE WHEN page_id % 3 = 2 THEN 'extension' WHEN page_id % 3 = 1 THEN 'content_type' END AS refused FROM pages")
def _(s, d):
    folder = F.element_at(F.array(*[F.lit(x) for x in ("docs", "images", "audio", "videos", "other")]), (F.col("page_id") % 5 + 1).cast("int"))
    end = F.element_at(F.array(F.lit(".pdf"), F.lit(".png"), F.lit(".exe")), (F.col("page_id") % 3 + 1).cast("int"))
    p = table(s, d, "pages").select("page_id", F.concat(F.lit("raw/"), folder, F.lit("/f"), F.col("page_id").cast("string"), end).alias("name"))
    uri = F.concat(F.lit("store://b/"), F.col("name"), F.lit("?sig=12"))
    return p.select("page_id", readers.modality_of_path(F.col("name")).alias("modality"), control.stage_of_path(F.concat(F.lit("store://b/"), F.col("name"))).alias("stage"), readers.base_name(uri).alias("file"), readers.admission(F.col("name"), F.lit("application/pdf; charset=x")).alias("refused"))


@query("q82_text_off_images", "WITH t AS (SELECT conv_id, list(struct_pack(turn := turn, text := trim(CASE WHEN turn % 3 = 2 THEN ' ' ELSE role END, ' '), conf := (turn * 37 + conv_id) % 100 + 0.5) ORDER BY turn) AS l FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, list_filter(l, lambda x: x.text <> '') AS seen FROM t), k AS (SELECT conv_id, len(seen) AS raw_tokens, list_filter(seen, lambda x: x.conf >= 40) AS kept FROM f), s AS (SELECT *, array_to_string(list_transform(kept, lambda x: x.text), ' ') AS text FROM k) SELECT conv_id, CASE WHEN length(text) < 5 THEN '' ELSE text END AS text, CASE WHEN length(text) >= 5 THEN round_even(list_avg(list_transform(kept, lambda x: x.conf)), 2) END::DOUBLE AS confidence, CASE WHEN length(text) < 5 THEN 0 ELSE len(kept) END AS kept_tokens, raw_tokens FROM s")
def _(s, d):
    token = F.struct("turn", F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("role")).alias("text"), ((F.col("turn") * 37 + F.col("conv_id")) % 100 + 0.5).cast("double").alias("conf"))
    each = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return each.select("conv_id", files.read_off(F.col("tokens"), min_confidence=40, min_length=5).alias("r")).select("conv_id", "r.*")


@query("q83_media_rules", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'unsupported_modality' WHEN p_size % 4 = 2 AND p_size % 3 <> 0 THEN 'no_types' WHEN p_size % 4 = 2 THEN 'stub' WHEN p_size % 3 = 1 THEN 'no_types' ELSE 'stub' END AS reason, CASE WHEN p_size % 4 = 3 THEN '' WHEN p_size % 4 = 2 THEN CASE WHEN p_size % 3 = 0 THEN 'voice' ELSE '' END WHEN p_size % 3 = 0 THEN 'faces,plates' WHEN p_size % 3 = 2 THEN 'plates' ELSE '' END AS resolved, round(1 / least(p_retailprice, greatest(2.0, p_retailprice / 400)), 6) AS fps FROM part")
def _(s, d):
    kind = F.element_at(F.array(F.lit("image"), F.lit("Video "), F.lit("audio"), F.lit("text")), (F.col("p_size") % 4 + 1).cast("int"))
    wanted = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("ALL"))).when(F.col("p_size") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("plates"), F.lit("noise")))
    p = table(s, d, "part").select("p_partkey", control.media_redaction(kind, wanted, True).alias("m"), control.sampling_rate(F.col("p_retailprice"), interval_s=2.0, most=400).alias("fps"))
    return p.select("p_partkey", "m.reason", F.array_join("m.resolved", ",").alias("resolved"), r6("fps").alias("fps"))


@query("q84_silence_gate", "WITH a AS (SELECT p_partkey, p_size * 1000 AS f, 8000 AS r FROM part), w AS (SELECT *, unnest(range(least(6, CAST(ceil(f / 4000.0) AS BIGINT)))) AS win FROM a WHERE f > 0), l AS (SELECT *, CASE WHEN (win + p_partkey) % 4 = 0 THEN '-inf'::DOUBLE ELSE 20 * log10(((win + p_partkey) % 4) / 10.0) END AS db FROM w) SELECT p_partkey, win AS window_index, floor(win * 4000 * 1000 / r)::BIGINT AS start_ms, round(db, 6) AS level_db FROM l WHERE db >= -15")
def _(s, d):
    a = table(s, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("f"), F.lit(8000).alias("r"))
    level = lambda w: decibels(((w + F.col("p_partkey")) % 4) / 10.0)
    out = control.audio_windows(a, "f", "r", window_s=2.0, hop_s=0.5, most=6, level=level, silence_db=-15.0)
    return out.select("p_partkey", F.col("window").alias("window_index"), "start_ms", r6("level_db").alias("level_db"))


@query("q106_key_frames", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS at_ms, value > 430 AS cut FROM events), w AS (SELECT *, sum(cut::BIGINT) OVER (PARTITION BY user_id) AS cuts, row_number() OVER (PARTITION BY user_id, at_ms // 86400000 ORDER BY at_ms, event_id) AS nth FROM e) SELECT event_id, user_id, CASE WHEN cuts >= 5 THEN 'scene' ELSE 'rate' END AS reason FROM w WHERE CASE WHEN cuts >= 5 THEN cut ELSE nth = 1 END")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"), "value")
    return control.key_frames(e, "user_id", "at_ms", "value", threshold=430.0, least=5, fps=1 / 86_400, tie=("event_id",)).select("event_id", "user_id", "reason")


# --- upkeep: orders are runs, their line items the files


KINDS = {"VertexA": ("core", "text"), "EdgeB": ("adj_list",)}
FILES = "files AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'EdgeB' ELSE 'VertexA' END AS entity, l_orderkey AS run_id, CASE WHEN l_orderkey % 7 = 0 THEN 'adj_list' WHEN l_linenumber % 2 = 0 THEN 'text' ELSE 'core' END AS kind, l_extendedprice AS bytes, l_quantity::BIGINT AS rows FROM lineitem)"
PLANNED = f"{FILES}, pk AS (SELECT entity, run_id, kind, sum(bytes) AS bytes FROM files GROUP BY ALL), gr AS (SELECT entity, run_id, max(bytes) AS size, row_number() OVER (PARTITION BY entity ORDER BY run_id) AS rn FROM pk GROUP BY entity, run_id HAVING count(*) = CASE entity WHEN 'EdgeB' THEN 1 ELSE 2 END), fo AS (SELECT entity, run_id, rn, size, 0::BIGINT AS batch, size AS total, 1 AS n FROM gr WHERE rn = 1 UNION ALL SELECT entity, run_id, rn, size, CASE WHEN closes THEN batch + 1 ELSE batch END, CASE WHEN closes THEN size ELSE total + size END, CASE WHEN closes THEN 1 ELSE n + 1 END FROM (SELECT gr.*, fo.batch, fo.total, fo.n, fo.total >= 500000 OR fo.total + gr.size > 900000 OR fo.n >= 12 AS closes FROM fo JOIN gr ON gr.entity = fo.entity AND gr.rn = fo.rn + 1))"


def _files(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    edge = F.col("l_orderkey") % 7 == 0
    return li.select(F.when(edge, "EdgeB").otherwise("VertexA").alias("entity"), F.col("l_orderkey").alias("run_id"), F.when(edge, "adj_list").when(F.col("l_linenumber") % 2 == 0, "text").otherwise("core").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uri"), F.col("l_quantity").cast("long").alias("rows"), F.col("l_extendedprice").alias("bytes"))


@query("q85_compaction_batches", f"WITH RECURSIVE {PLANNED} SELECT entity, batch, kind, count(*) AS files, round(sum(bytes), 2) AS bytes, sum(rows)::BIGINT AS rows FROM files JOIN fo USING (entity, run_id) GROUP BY ALL")
def _(s, d):
    f = _files(s, d)
    plan = maintenance.plan_compaction(f, KINDS, low=500_000.0, high=900_000.0, most=12)
    return maintenance.batch_totals(f, plan).select("entity", "batch", "kind", "files", F.round("bytes", 2).alias("bytes"), "rows")


@query("q86_compaction_counts", f"WITH RECURSIVE {PLANNED} SELECT entity, sum(rows)::BIGINT AS rows FROM files JOIN fo USING (entity, run_id) WHERE kind IN ('core', 'adj_list') GROUP BY entity")
def _(s, d):
    f = _files(s, d)
    plan = maintenance.plan_compaction(f, KINDS, low=500_000.0, high=900_000.0, most=12)
    return maintenance.counts_by_entity(maintenance.batch_totals(f, plan))


@query("q87_audit_batches", "WITH RECURSIVE e AS (SELECT event_type AS log, event_id, epoch_us(ts) // 1000000 AS mtime, floor(value)::BIGINT AS bytes FROM events WHERE epoch_us(ts) // 1000000 <= 1706000000), o AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY mtime, bytes, event_id::VARCHAR) AS rn FROM e), f AS (SELECT log, event_id, rn, bytes, 0::BIGINT AS b, bytes AS total, 1 AS n FROM o WHERE rn = 1 UNION ALL SELECT log, event_id, rn, bytes, CASE WHEN closes THEN b + 1 ELSE b END, CASE WHEN closes THEN bytes ELSE total + bytes END, CASE WHEN closes THEN 1 ELSE n + 1 END FROM (SELECT o.*, f.b, f.total, f.n, f.total >= 700 OR f.total + o.bytes > 900 OR f.n >= 6 AS closes FROM f JOIN o ON o.log = f.log AND o.rn = f.rn + 1)), k AS (SELECT log, b, row_number() OVER (PARTITION BY log ORDER BY b) - 1 AS batch FROM f GROUP BY log, b HAVING count(*) > 1) SELECT log, batch, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f JOIN k USING (log, b) WHERE batch < 20 GROUP BY log, batch")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("log"), F.col("event_id").cast("string").alias("uri"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double").alias("mtime"), F.floor("value").cast("long").alias("bytes"))
    cut = maintenance.audit_batches(e, by="log", min_age_s=1000.0, now=1_706_001_000.0, low=700, high=900, most_files=6, most_batches=20)
    return cut.groupBy("log", "batch").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("q88_snapshot_change", "WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 5 = 0 AS fresh FROM orders), t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'doc_chunks' WHEN 'O' THEN 'image_assets' ELSE 'transcripts' END AS name, count(*) FILTER (NOT fresh) AS b, count(*) FILTER (fresh) AS a, count(*) FILTER (fresh AND o_orderkey % 2 = 0) AS v FROM r GROUP BY 1) SELECT coalesce(name, 'all') AS \"table\", (sum(b) + sum(a))::BIGINT AS total_rows, sum(a)::BIGINT AS rows_added, sum(v)::BIGINT AS vectors_added, round(100.0 * sum(a) / (sum(b) + sum(a)), 2)::DOUBLE AS percent_changed FROM t GROUP BY ROLLUP (name)")
def _(s, d):
    o = table(s, d, "orders")
    name = F.when(F.col("o_orderstatus") == "F", "DocChunk").when(F.col("o_orderstatus") == "O", "ImageAsset").otherwise("Transcript")
    runs = o.select(name.alias("vertex"), F.lit("core").alias("kind"), F.lit(1).cast("long").alias("rows"), F.col("o_orderkey").alias("run_id"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("uri"))
    tables = {"DocChunk": "doc_chunks", "ImageAsset": "image_assets", "Transcript": "transcripts"}
    fresh = maintenance.new_manifests(runs, runs.where("run_id % 5 <> 0"))
    added = maintenance.rows_added(fresh, tables)
    vectors = maintenance.rows_added(fresh.where("run_id % 2 = 0"), tables).withColumnRenamed("rows_added", "vectors_added")
    base = maintenance.rows_added(runs.where("run_id % 5 <> 0"), tables).withColumnRenamed("rows_added", "base_rows")
    return maintenance.change_report(base.join(added, "table", "left").join(vectors, "table", "left").fillna(0))


@query("q89_compaction_metrics", "SELECT count(*) AS compactions, arg_max(l, (o_orderdate, o_orderkey)) AS latest_seconds FROM (SELECT o_orderdate, o_orderkey, round(o_totalprice / 1000, 2) AS l FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    done = F.col("o_orderdate").cast("timestamp")
    runs = table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_compaction"), done.alias("completed_at"), F.timestamp_micros(F.unix_micros(done) - F.round(F.col("o_totalprice") / 1000 * 1_000_000).cast("long")).alias("started_at"))
    return maintenance.compaction_metrics(runs)


def lookup_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Incoming objects and those that were completed before."""
    docs = table(s, d, "documents")
    k = F.col("doc_id")
    shared = [F.sha2("text", 256).alias("digest"), F.col("source").alias("scope")]
    none = F.lit(None).cast("string")
    incoming = docs.select(k.alias("id"), *shared, F.when(k % 3 == 0, F.col("n_chars")).alias("size_bytes"), F.when(k % 2 == 0, "text/plain").alias("content_type"), F.when(k % 5 == 0, F.col("lang")).alias("pipeline_version"), none.alias("bucket"), none.alias("name"), F.lit(None).cast("long").alias("duration_ms"))
    done = docs.where(k % 6 != 5).select(F.lpad(k.cast("string"), 8, "0").alias("doc_id"), *shared, F.when(k % 4 != 0, F.col("n_chars")).alias("size_bytes"), F.when(k % 7 == 0, "image/png").otherwise("Text/Plain; charset=x").alias("content_type"), F.col("lang").alias("pipeline_version"), F.lit("b").alias("bucket"), F.lit("n").alias("name"), F.lit(1).cast("long").alias("duration_ms"), (k % 11 == 0).alias("has_metrics"), F.lit("COMPLETED").alias("status"))
    return incoming, done


@query("q90_dedupe_lookup", "WITH i AS (SELECT doc_id AS id, sha256(text) AS digest, source AS scope, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS size_bytes, CASE WHEN doc_id % 2 = 0 THEN 'text/plain' END AS content_type, CASE WHEN doc_id % 5 = 0 THEN lang END AS pipeline_version FROM documents), dn AS (SELECT printf('%08d', doc_id) AS doc_id, sha256(text) AS digest, source AS scope, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS size_bytes, CASE WHEN doc_id % 7 = 0 THEN 'image/png' ELSE 'Text/Plain; charset=x' END AS content_type, lang AS pipeline_version, doc_id % 11 = 0 AS m FROM documents WHERE doc_id % 6 <> 5), p AS (SELECT i.id, dn.doc_id, m, row_number() OVER (PARTITION BY i.id ORDER BY dn.doc_id) AS n FROM i JOIN dn ON i.digest = dn.digest AND i.scope = dn.scope WHERE (i.pipeline_version IS NULL OR i.pipeline_version = dn.pipeline_version) AND (i.size_bytes IS NULL OR dn.size_bytes IS NULL OR i.size_bytes = dn.size_bytes) AND (i.content_type IS NULL OR lower(split_part(dn.content_type, ';', 1)) = i.content_type)), b AS (SELECT id, arg_min(doc_id, (NOT m, doc_id)) AS found FROM p WHERE n <= 20 GROUP BY id) SELECT i.id, found, found IS NOT NULL AS cache_hit FROM i LEFT JOIN b USING (id)")
def _(s, d):
    return maintenance.find_completed(*lookup_tables(s, d)).select("id", "found", "cache_hit")


@query("q91_group_map", "WITH c AS (SELECT l_orderkey AS run_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_orderkey || '-' || l_linenumber, l_linenumber) AS nth, l_linenumber % 2 AS k FROM lineitem) SELECT run_id, nth, max(CASE WHEN k = 1 THEN run_id || '-' || l_linenumber END) AS core, max(CASE WHEN k = 0 THEN run_id || '-' || l_linenumber END) AS text FROM c GROUP BY run_id, nth")
def _(s, d):
    li = table(s, d, "lineitem")
    f = li.select(F.col("l_orderkey").alias("run_id"), F.lit("V").alias("vertex"), F.when(F.col("l_linenumber") % 2 == 1, "core").otherwise("text").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uri"))
    return readers.file_groups(f).select("run_id", F.col("nth").cast("long").alias("nth"), "core", "text")


# --- reports


@query("q92_stage_p95", "WITH e AS (SELECT unnest(['decode_' || event_type, CASE WHEN user_id % 2 = 0 THEN 'embed' ELSE 'write' END]) AS stage, unnest([value, CASE WHEN value > 100 THEN value / 2 END]) AS v FROM events) SELECT stage, count(*) AS n, round(quantile_cont(v, 0.95), 6) AS p95 FROM e WHERE v IS NOT NULL GROUP BY stage")
def _(s, d):
    pair = F.create_map(F.concat(F.lit("decode_"), F.col("event_type")), F.col("value"), F.when(F.col("user_id") % 2 == 0, "embed").otherwise("write"), F.when(F.col("value") > 100, F.col("value") / 2))
    return reports.stage_percentiles(table(s, d, "events").select(pair.alias("m")), "m")


@query("q93_derived_bytes", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS bp, CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 2 = 0 THEN l_tax END AS bf, CASE WHEN l_linenumber % 3 <> 2 THEN l_extendedprice / 1000 END AS t, l_quantity / 2 AS fp, l_discount AS fm FROM lineitem), r AS (SELECT *, coalesce(bp, bf) IS NOT NULL AS said FROM p), c AS (SELECT *, CASE WHEN said THEN bp ELSE fp END AS parquet_b, CASE WHEN said THEN bf END AS frames_b, fm AS manifest_b FROM r), o AS (SELECT *, coalesce(t, CASE WHEN coalesce(parquet_b, frames_b) IS NOT NULL THEN coalesce(parquet_b, 0) + coalesce(frames_b, 0) END) AS derived_total FROM c) SELECT count(*) AS n, round(sum(parquet_b), 4) AS parquet_b, round(sum(frames_b), 4) AS frames_b, round(sum(manifest_b), 4) AS manifest_b, round(sum(derived_total), 4) AS derived_total, round(sum(greatest(0.0, derived_total - coalesce(parquet_b, 0) - coalesce(frames_b, 0))), 4) AS other_b FROM o")
def _(s, d):
    third = F.col("l_linenumber") % 3
    parts = reports.derived_bytes(
        {"parquet_b": F.when(third == 0, F.col("l_quantity")), "frames_b": F.when((third == 0) & (F.col("l_partkey") % 2 == 0), F.col("l_tax"))}, {"parquet_b": F.col("l_quantity") / 2, "manifest_b": F.col("l_discount")}, [F.when(third != 2, F.col("l_extendedprice") / 1000)],
    )
    each = table(s, d, "lineitem").select(*[c.alias(n) for n, c in parts.items()])
    return each.agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in ("parquet_b", "frames_b", "manifest_b", "derived_total", "other_b")])


@query("q94_asset_costs", "SELECT l_orderkey, l_linenumber, round_even(l_tax + l_discount, 4) AS cost_cpu_seconds, round_even((l_quantity * 3 + CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) / 1000, 4) AS cost_model_seconds, l_extendedprice AS cost_raw_bytes, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END, l_quantity * 2) AS cost_derived_bytes, round_even((l_linenumber + l_partkey % 5) * 0.0025, 4)::DOUBLE AS cost_index_seconds_est, (l_linenumber + l_partkey % 5)::BIGINT AS vector_count FROM lineitem")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    q = F.col("l_quantity").cast("double")
    even = F.col("l_linenumber") % 2 == 0
    out = reports.asset_costs(li, cpu=[F.col("l_tax"), F.col("l_discount")], model_ms=F.create_map(F.lit("text"), q * 3, F.lit("image"), F.when(even, q)), vectors=[F.col("l_linenumber"), F.col("l_partkey") % 5], raw=F.col("l_extendedprice"), derived=[F.when(F.col("l_linenumber") % 3 == 0, q), q * 2], seconds_per_vector=0.0025)
    return out.select("l_orderkey", "l_linenumber", "cost_cpu_seconds", "cost_model_seconds", "cost_raw_bytes", "cost_derived_bytes", "cost_index_seconds_est", "vector_count")


@query("q95_overlap", "WITH t AS (SELECT conv_id, list(role || turn ORDER BY turn) AS found FROM conversations GROUP BY conv_id) SELECT conv_id, round(len(list_intersect(found[1:3], ['user0', 'assistant3', 'user4', 'tool2'])) / 4.0, 6)::DOUBLE AS overlap, least(nullif(list_position(found, 'assistant3'), 0), nullif(list_position(found, 'user4'), 0), nullif(list_position(found, 'tool2'), 0)) AS rank FROM t")
def _(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("found"))
    wanted = lambda *names: F.array(*[F.lit(n) for n in names])
    return t.select("conv_id", r6(reports.overlap_at(F.col("found"), wanted("user0", "assistant3", "user4", "tool2", ""), 3)).alias("overlap"), reports.rank_of_expected(F.col("found"), wanted("assistant3", "user4", "tool2")).alias("rank"))


# --- records and consumers


@query("q96_registry", "WITH r AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'src' || s_suppkey % 3 END AS org_id, ['csv', CASE WHEN s_nationkey % 2 = 0 THEN 'audio' ELSE 'video' END] AS modalities FROM supplier) SELECT s_suppkey FROM (SELECT s_suppkey FROM r WHERE s_nationkey < 12 AND list_contains(modalities, 'audio') AND (org_id IS NULL OR org_id = 'src1') ORDER BY s_suppkey DESC LIMIT 5)")
def _(s, d):
    r = table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") < 12).alias("streaming"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("src"), (F.col("s_suppkey") % 3).cast("string"))).alias("org_id"), F.array(F.lit("csv"), F.when(F.col("s_nationkey") % 2 == 0, "audio").otherwise("video")).alias("modalities"))
    return records.last_entries(records.scoped_entries(r, org_id="src1", site_id=None), "s_suppkey", 5, streaming=True, modalities="audio", edition=None).select("s_suppkey")


@query("q97_consumer_decisions", "WITH e AS (SELECT event_id, user_id, sha256('b/' || user_id || '#' || event_id % 3) AS key, ts FROM events), s AS (SELECT DISTINCT sha256('b/' || user_id || '#' || g) AS key, CASE user_id % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' ELSE 'DLQ' END AS status, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 4 END AS n, CASE WHEN user_id % 3 = 0 THEN 100 ELSE 9000 END AS age FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 <> 4), range(2) t(g)) SELECT event_id, CASE WHEN status IN ('COMPLETED', 'DLQ') THEN 'skip_done' WHEN status = 'PROCESSING' AND age < 3600 THEN 'skip_running' WHEN coalesce(n, 0) >= 4 THEN 'dead' ELSE 'start' END AS action, (coalesce(n, 0) + CASE WHEN status IN ('COMPLETED', 'DLQ') OR (status = 'PROCESSING' AND age < 3600) OR coalesce(n, 0) >= 4 THEN 0 ELSE 1 END)::BIGINT AS attempt FROM e LEFT JOIN s USING (key)")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.lit("b").alias("bucket"), F.col("user_id").cast("string").alias("name"), (F.col("event_id") % 3).cast("string").alias("generation"))
    u = F.col("user_id")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    held = table(s, d, "events").where(u % 5 != 4).select("user_id").distinct().select(F.lit("b").alias("bucket"), u.cast("string").alias("name"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("generation"), "user_id")
    status = F.when(u % 5 == 0, "COMPLETED").when(u % 5 == 1, "PROCESSING").when(u % 5 == 2, "FAILED").otherwise("DLQ")
    state = held.select(consumer.event_key().alias("key"), status.alias("status"), F.when(u % 2 == 0, 1).otherwise(4).cast("long").alias("attempts"), F.timestamp_seconds(F.unix_seconds(now) - F.when(u % 3 == 0, 100).otherwise(9000)).alias("updated_at"))
    return consumer.decide(e.withColumn("key", consumer.event_key()), state, now=now, ttl_s=3600, attempts=4).select("event_id", "action", F.col("attempt").cast("long").alias("attempt"))


@query("q98_workflow_tick", "WITH l AS (SELECT o_custkey, max(o_orderdate) AS last, bool_or(o_orderkey % 9 = 0) AS active FROM orders GROUP BY o_custkey) SELECT c_custkey AS workflow_id, CASE c_custkey % 3 WHEN 0 THEN '@daily' WHEN 1 THEN '30 6 * * *' ELSE 'every 9000d' END AS schedule FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE c_nationkey > 4 AND NOT coalesce(active, false) AND (c_custkey % 3 <= 1 OR last IS NULL OR last <= TIMESTAMP '2024-05-06 06:30:10' - INTERVAL 9000 DAY)")
def _(s, d):
    k = F.col("c_custkey")
    w = table(s, d, "customer").select(k.alias("workflow_id"), F.when(k % 3 == 0, "@daily").when(k % 3 == 1, "30 6 * * *").otherwise("every 9000d").alias("schedule"), (F.col("c_nationkey") > 4).alias("enabled"))
    runs = table(s, d, "orders").select(F.col("o_custkey").alias("workflow_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(F.col("o_orderkey") % 9 == 0, "running").otherwise("done").alias("status"))
    now = F.lit("2024-05-06 06:30:10").cast("timestamp")
    return consumer.due_workflows(w, runs, control.schedule_due, ["@daily", "30 6 * * *", "every 9000d"], now).select("workflow_id", "schedule")


@query("q99_messages", "SELECT user_id AS batch, count(*) AS n, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def _(s, d):
    """Events to envelopes and back."""
    e = table(s, d, "events").select("event_id", "user_id", F.lit("b").alias("bucket"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("generation"), F.lit("s").alias("stream_id"))
    sent = consumer_messages(e)
    back = readers.decode_batches(sent)
    got = back.select(F.col("org_id").cast("long").alias("batch"), F.col("generation").cast("long").alias("id")).groupBy("batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return got.select("batch", "n", F.sha2(F.array_join("ids", ","), 256).alias("digest"))


def consumer_messages(events: DataFrame) -> DataFrame:
    return records.as_messages(events.withColumn("org_id", F.col("user_id").cast("string")), F.col("user_id"), ["bucket", "name", "generation", "stream_id", "org_id"])


@query("q100_scope_defaults", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, 'home') AS org_id, 'main' AS site_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR || 'x' WHEN c_custkey % 3 = 1 THEN c_custkey::VARCHAR END, '') AS raw, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS number FROM customer")
def _(s, d):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit("x"))).when(F.col("c_custkey") % 3 == 1, k)
    named = F.create_map(F.lit("org"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")))
    c = table(s, d, "customer").select("c_custkey", control.first_of(named, ("org_id", "org")).alias("org_id"), F.coalesce(raw, F.lit("")).alias("raw"))
    return search.with_scope_defaults(c, {"org_id": "home", "site_id": "main"}).withColumn("number", control.digits_to_long(F.col("raw")))


@query("q101_export_redacted", f"SELECT count(*) AS n, sum(('0x' || substr(sha256(conv_id || ':' || turn || ':' || t), 1, 10))::BIGINT)::BIGINT AS digest FROM (SELECT conv_id, turn, regexp_replace(text, '{EMAIL}', '[REDACTED]', 'gi') AS t FROM conversations)")
def _(s, d):
    """Rows exported as JSON lines, with their addresses redacted, and read again."""
    from ..session import fresh_path
    from ..sources import writers

    path = fresh_path(s, "exports")
    writers.export(table(s, d, "conversations").select("conv_id", "turn", "text"), path, "jsonl", redacted=["text"], kinds=("email",))
    back = s.read.schema("conv_id long, turn long, text string").json(path)
    own = F.sha2(F.concat_ws(":", "conv_id", "turn", "text"), 256)  # a row each, added up
    return back.agg(F.count("*").alias("n"), F.sum(F.conv(F.substr(own, F.lit(1), F.lit(10)), 16, 10).cast("long")).alias("digest"))


@query("q102_buffer_stats", "SELECT user_id, count(*) AS count, round(sum(value), 4) AS bytes, max(age) AS oldest, min(age) AS newest, count(*) + 40 > 100 AS rejected FROM (SELECT user_id, value, date_diff('day', ts::DATE, DATE '2024-02-01') AS age FROM events) GROUP BY user_id")
def _(s, d):
    i = table(s, d, "events").select("user_id", "value", F.date_diff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).alias("age"))
    stats = control.buffer_stats(i, "user_id", "value", "age")
    return stats.select("user_id", "count", F.round("bytes", 4).alias("bytes"), "oldest", "newest", (~control.accepts(F.col("count") + 39, 100, 1000)).alias("rejected"))


@query("q103_frames_by_time", "SELECT asset_id, \"at\", rn FROM (SELECT user_id AS asset_id, epoch_us(ts) // 1000 AS \"at\", row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) END NULLS LAST, event_id) AS rn FROM events) WHERE rn <= 12")
def _(s, d):
    """The first twelve frames of an asset by time, those without a time last."""
    e = table(s, d, "events").withColumn("score", F.lit(1.0)).withColumn("t", F.when(F.col("event_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp"))))
    out = fusion.group_moments(e, "user_id", order=[F.asc_nulls_last("t"), F.col("event_id")], keep=12)
    return out.select(F.col("user_id").alias("asset_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), F.col("moment").cast("long").alias("rn"))


@query("q104_frame_times", "SELECT p_partkey, p_size * 1000 + 250 AS first_ms, p_size * 2000 AS second_ms, array_to_string(list_slice(string_split(p_name || ' ' || p_type, ' '), 1, 2), ' ') AS words FROM part")
def _(s, d):
    log = F.concat(F.lit("n:0 pts_time:"), (F.col("p_size") + 0.25).cast("decimal(10,2)").cast("string"), F.lit(" x pts_time:"), (F.col("p_size") * 2).cast("string"), F.lit(" end"))
    p = table(s, d, "part").select("p_partkey", control.frame_times(log).alias("t"), tx.first_tokens(F.concat_ws(" ", "p_name", "p_type"), 2).alias("words"))
    return p.select("p_partkey", F.get("t", F.lit(0)).alias("first_ms"), F.get("t", F.lit(1)).alias("second_ms"), "words")
