"""Whole searches: branches by modality, filters, fusion, reranking, responses.

A snapshot maps names to tables:

    media_assets    id, uri, media_type and scope columns
    doc_chunks      id, media_asset_id, content, source_type, source_time_ms, vector
    transcripts     id, media_asset_id, content, start_ms, end_ms, vector
    image_assets    id, media_asset_id, timestamp_ms, vector, vector_v2
    audio_segments  id, media_asset_id, start_ms, end_ms, vector
    audio_clips     the same

Tables and columns may be missing; a branch without a table, or without a
vector column, has no hits.  Hits are cut to k a branch before anything wide
is joined to them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as _Late
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine_distance, score_of_bm25, score_of_distance
from ..plans.filters import apply_filter, legacy_filters
from . import fusion, search
from .control import check_request, retrieval_modalities
from .policy import redaction_types

Snapshot = Mapping[str, DataFrame]

# What a hit's evidence is called, by its modality.
REFERENCES = {"document": "doc_chunk_id", "ocr": "doc_chunk_id", "fts": "doc_chunk_id", "transcript": "transcript_segment_id", "image": "image_asset_id", "audio": "audio_segment_id", "video": "video_clip_id"}
HIT = ["modality", "evidence_id", "media_asset_id", "source_type", "start_ms", "end_ms", "snippet", "score", "evidence_refs", "note"]


@dataclass(frozen=True)
class Request:
    """A search: a text, the vectors of it (by kind of table), an image's vectors, and how results come back."""

    query: str | None = None
    vectors: Mapping[str, Sequence[float]] = field(default_factory=dict)
    image: Mapping[str, Sequence[float]] = field(default_factory=dict)
    metadata: Mapping[str, str] | None = None
    kind: str = "vector"
    top_k: int = 20
    modalities: Sequence[str] | None = None
    filters: dict | None = None
    scope: Mapping[str, str] = field(default_factory=dict)
    group_by: str | None = None
    sort_by: str = "score"
    page_limit: int | None = None
    offset: int = 0


class InferenceTimeout(RuntimeError):
    """A model that took longer than it may."""


def with_timeout(work: Callable[[], object], seconds: float | None) -> object:
    """work(), in a thread of its own if it has a limit."""
    if not seconds:
        return work()
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(work).result(timeout=seconds)
    except _Late as e:
        raise InferenceTimeout(f"no answer within {seconds} s") from e
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def memo(encode: Callable[[str], Sequence[float]], size: int = 256) -> Callable[[str], tuple[float, ...]]:
    """An encoder that remembers its last texts."""
    return lru_cache(maxsize=size)(lambda text: tuple(encode(text)))


def has_columns(snapshot: Snapshot, table: str, *columns: str) -> bool:
    """Whether a table of a snapshot is there and has these columns."""
    return table in snapshot and not set(columns) - set(snapshot[table].columns)


def evidence_refs(modality: Column, evidence_id: Column) -> Column:
    """[{kind of reference: id}], empty for a modality without evidence of its own."""
    kind = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])
    named = F.try_element_at(kind, modality)
    return F.when(named.isNotNull(), F.array(F.create_map(named, evidence_id))).otherwise(F.array().cast("array<map<string,string>>"))


def _hits(df: DataFrame, *, modality: Column | str, score: Column, start: Column | None = None, end: Column | None = None, snippet: Column | None = None, source: Column | None = None, note: Column | None = None, refs: Column | None = None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    kind = F.lit(modality) if isinstance(modality, str) else modality
    own = df.withColumn("_m", kind)
    evidence = F.col("id").cast("string")
    return own.select(
        F.col("_m").alias("modality"), evidence.alias("evidence_id"), F.col("media_asset_id").cast("string").alias("media_asset_id"), (source if source is not None else none("string")).alias("source_type"),
        (start if start is not None else none("long")).cast("long").alias("start_ms"), (end if end is not None else none("long")).cast("long").alias("end_ms"),
        (snippet if snippet is not None else none("string")).alias("snippet"), score.cast("double").alias("score"),
        (refs if refs is not None else evidence_refs(F.col("_m"), evidence)).alias("evidence_refs"), (note if note is not None else none("string")).alias("note"),
    )


def in_scope(snapshot: Snapshot, table: str, scope: Mapping[str, str]) -> DataFrame:
    """A table's rows that have an asset in scope; rows without an asset go."""
    assets = search.scoped(snapshot["media_assets"], **scope).select(F.col("id").alias("_asset"))
    return snapshot[table].join(assets, F.col("media_asset_id") == F.col("_asset"), "left_semi")


def _nearest(df: DataFrame, vector: str, query: Sequence[float] | Column, k: int) -> DataFrame:
    ranked = df.where(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(vector, query))
    return ranked.orderBy(F.asc_nulls_last("distance"), "id").limit(k).withColumn("score", score_of_distance(F.col("distance")))


def _asked(query: Sequence[float] | DataFrame, df: DataFrame) -> tuple[DataFrame, Sequence[float] | Column]:
    """A query vector given as numbers, or as a table of one row that is broadcast."""
    if isinstance(query, DataFrame):
        return df.crossJoin(F.broadcast(query.select(F.col(query.columns[0]).alias("_q")).limit(1))), F.col("_q")
    return df, query


def _vector_branch(snapshot: Snapshot, table: str, query, k: int, scope, vector: str = "vector") -> DataFrame | None:
    if query is None or not has_columns(snapshot, table, vector):
        return None
    df, q = _asked(query, in_scope(snapshot, table, scope))
    return _nearest(df, vector, q, k)


def _document_hits(found: DataFrame, query: str) -> DataFrame:
    kind = search.modality_of(F.col("source_type"))
    at = F.when(kind == "ocr", F.col("source_time_ms"))
    return _hits(found, modality=kind, score=search.boost(F.col("score"), "document", query), start=at, end=at, snippet=F.col("content"), source=F.col("source_type"))


def _identifier_hits(snapshot: Snapshot, query: str, k: int, scope) -> DataFrame:
    """Full text over what was read off images, for queries that look like identifiers."""
    read = in_scope(snapshot, "doc_chunks", scope).where(F.col("source_type").isin(*search.OCR_SOURCES))
    best = search.bm25(read, "id", "content", query).orderBy(F.desc("score"), "id").limit(k).withColumnRenamed("score", "bm25")
    return _hits(read.join(best, "id"), modality="fts", score=score_of_bm25(F.col("bm25")), start=F.col("source_time_ms"), end=F.col("source_time_ms"), snippet=F.col("content"), source=F.col("source_type"))


def _audio_hits(snapshot: Snapshot, query_vector, query: str, k: int, scope, gap: int) -> DataFrame | None:
    """Segments, merged where they touch, and clips of assets that have none, k at most."""
    parts = []
    for name in ("audio_segments", "audio_clips"):
        found = _vector_branch(snapshot, name, query_vector, k, scope)
        if found is not None:
            rows = _hits(found, modality="audio", score=search.boost(F.col("score"), "audio", query), start=F.col("start_ms"), end=F.col("end_ms"), source=F.lit(name))
            if name == "audio_segments":
                merged = fusion.merge_intervals(rows, ["media_asset_id"], gap, carry=("modality", "evidence_id", "source_type", "snippet"), refs="evidence_refs", tie=("evidence_id",))
                rows = merged.select(*HIT)
            parts.append(rows)
    if len(parts) == 2:
        return fusion.backfill(*parts, "media_asset_id", k, order=[F.desc("score"), F.col("evidence_id")]).drop("tier")
    return parts[0].orderBy(F.desc("score"), "evidence_id").limit(k) if parts else None


def search_by_text(snapshot: Snapshot, query: str, vectors: Mapping[str, Sequence[float] | DataFrame], *, top_k: int = 20, modalities: Sequence[str] | None = None, scope: Mapping[str, str] = {}, gap_ms: int = 250) -> DataFrame:
    """Hits of the branches that the modalities ask for, each cut to top_k, boosted, together cut to top_k."""
    wanted = retrieval_modalities(modalities)
    branches: list[DataFrame | None] = []
    if "document" in wanted:
        found = _vector_branch(snapshot, "doc_chunks", vectors.get("text"), top_k, scope)
        branches.append(None if found is None else _document_hits(found, query))
        if looks_like_id(query) and has_columns(snapshot, "doc_chunks", "content", "source_type"):
            branches.append(_identifier_hits(snapshot, query, top_k, scope))
    if "transcript" in wanted:
        found = _vector_branch(snapshot, "transcripts", vectors.get("text"), top_k, scope)
        branches.append(None if found is None else _hits(found, modality="transcript", score=search.boost(F.col("score"), "transcript", query), start=F.col("start_ms"), end=F.col("end_ms"), snippet=F.col("content")))
    if "image" in wanted:
        branches += _image_branches(snapshot, {"v1": vectors.get("clip"), "v2": vectors.get("vision")}, top_k, scope, query)
    if "audio" in wanted:
        branches.append(_audio_hits(snapshot, vectors.get("clap"), query, top_k, scope, gap_ms))
    return _cut(snapshot, branches, top_k)


def _image_branches(snapshot: Snapshot, vectors: Mapping[str, object], k: int, scope, query: str | None = None) -> list[DataFrame | None]:
    out = []
    for version, column in (("v1", "vector"), ("v2", "vector_v2")):
        found = _vector_branch(snapshot, "image_assets", vectors.get(version), k, scope, column)
        score = F.col("score") if query is None else search.boost(F.col("score"), "image", query)
        out.append(None if found is None else _hits(found, modality="image", score=score, start=F.col("timestamp_ms"), end=F.col("timestamp_ms"), source=F.lit(version)))
    return out


def search_by_image(snapshot: Snapshot, vectors: Mapping[str, Sequence[float] | DataFrame], *, top_k: int = 20, scope: Mapping[str, str] = {}) -> DataFrame:
    """Hits of the image branches, not boosted."""
    return _cut(snapshot, _image_branches(snapshot, vectors, top_k, scope), top_k)


def search_by_keyword(snapshot: Snapshot, query: str, *, top_k: int = 20, scope: Mapping[str, str] = {}) -> DataFrame:
    """Documents, then transcripts, that hold the query; all score 1."""
    out = []
    for table, kind in (("doc_chunks", "document"), ("transcripts", "transcript")):
        if has_columns(snapshot, table, "content"):
            found = search.keyword(in_scope(snapshot, table, scope), "content", query).orderBy("id").limit(top_k)
            start, end = (F.col("start_ms"), F.col("end_ms")) if kind == "transcript" else (None, None)
            out.append(_hits(found, modality=kind, score=F.lit(1.0), start=start, end=end, snippet=F.col("content")))
    return _cut(snapshot, out, top_k)


def search_by_metadata(snapshot: Snapshot, filters: Mapping[str, str], *, top_k: int = 20, scope: Mapping[str, str] = {}) -> DataFrame:
    """Assets by uri, media type or content type; all score 1."""
    assets = search.scoped(snapshot["media_assets"], **scope)
    found = search.metadata(assets, {"uri": "contains", "media_type": "equals", "content_type": "equals"}, **filters).orderBy("id").limit(top_k)
    return _cut(snapshot, [_hits(found.withColumn("media_asset_id", F.col("id")), modality="metadata", score=F.lit(1.0))], top_k)


def _cut(snapshot: Snapshot, branches: Sequence[DataFrame | None], k: int) -> DataFrame:
    """Branches one after another, cut to the best k (equal scores in branch order), with uri and media_type of their assets."""
    parts = [b for b in branches if b is not None]
    assets = snapshot["media_assets"].select(F.col("id").cast("string").alias("media_asset_id"), "uri", "media_type")
    if not parts:
        none = {"score": "double", "start_ms": "long", "end_ms": "long", "evidence_refs": "array<map<string,string>>"}
        empty = assets.where(F.lit(False))
        return empty.select(*[F.lit(None).cast(none.get(c, "string")).alias(c) for c in HIT if c != "media_asset_id"], F.lit(0).alias("branch_ord"), "media_asset_id", "uri", "media_type")
    return search.branches(*parts, k=k, tie=["evidence_id"]).join(assets, "media_asset_id")


def looks_like_id(query: str) -> bool:
    """The plain twin of functions.text.id_like, for a query at hand."""
    parts = query.strip().split()
    return 4 <= len(query.strip()) <= 128 and 0 < len(parts) <= 3 and all(tx.ID_SHAPE.fullmatch(p) and (tx.ID_SIGN.search(p) or tx.ID_CAPITALS.fullmatch(p)) for p in parts)


def run_query(snapshot: Snapshot, request: Request, *, rerank: bool = False, scorer: Column | None = None, **settings) -> DataFrame:
    """Search, then filter, then fuse, then rerank (V24): one row a hit, with score (0 to 1), why and rerank_status."""
    check_request(top_k=request.top_k, page_limit=request.page_limit, query=request.query, image="image" if request.image else None, metadata=request.metadata or request.filters, kind=request.kind, modalities=request.modalities, group_by=request.group_by, sort_by=request.sort_by)
    parts = []
    if request.kind == "keyword" and request.query:
        parts.append(search_by_keyword(snapshot, request.query, top_k=request.top_k, scope=request.scope))
    elif request.kind == "metadata":
        wanted = request.metadata or legacy_filters(request.filters)
        if wanted:
            parts.append(search_by_metadata(snapshot, wanted, top_k=request.top_k, scope=request.scope))
    elif request.query:
        parts.append(search_by_text(snapshot, request.query, request.vectors, top_k=request.top_k, modalities=request.modalities, scope=request.scope, **{k: v for k, v in settings.items() if k == "gap_ms"}))
    if request.image:
        parts.append(search_by_image(snapshot, request.image, top_k=request.top_k, scope=request.scope))
    if not parts:
        parts = [_cut(snapshot, [], request.top_k)]
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    named = hits.withColumn("asset_id", F.coalesce("media_asset_id", "uri")).withColumn("asset_type", F.col("media_type"))
    kept = apply_filter(named, request.filters)
    keys = ["asset_id", "modality", "evidence_id", "start_ms", "end_ms"]
    fused = fusion.reciprocal_rank_fusion(kept, keys, tie=["evidence_id"], why=True, carry=("uri", "asset_type", "source_type", "snippet", "evidence_refs", "note"))
    order = [F.desc("score"), F.col("evidence_id")]
    if not rerank or not (request.query or "").strip():
        return fused.withColumn("base_score", F.col("score")).withColumn("rerank_status", F.lit("disabled"))
    score = tx.token_f1(F.col("snippet"), request.query) if scorer is None else scorer
    return fusion.rerank(fused, score, order=order, **{k: v for k, v in settings.items() if k != "gap_ms"})


def model_scores(hits: DataFrame, query: str, score: Callable[[str, list[str]], Sequence[float]], *, text: str = "snippet", name: str = "model_score", query_tokens: int = 32, tokens: int = 128, batch: int = 8) -> DataFrame:
    """hits with what a cross-encoder says of the query and each text, both cut to so many tokens, so many texts at a time.

    ``score`` is the model: it comes to the workers with the function, and
    loads what it needs there.  Hits without a text have no score.
    """
    short, at = " ".join(query.split()[:query_tokens]), len(hits.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)

    def run(batches):
        for part in batches:
            texts = part.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t]
            out: list[float | None] = [None] * len(texts)
            for k in range(0, len(known), batch):
                some = known[k : k + batch]
                for i, value in zip(some, score(short, [texts[i] for i in some])):
                    out[i] = float(value)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.float64())], [*part.schema.names[:-1], name])

    return hits.withColumn("_text", tx.first_tokens(F.col(text), tokens)).mapInArrow(run, f"{schema}, `{name}` double")


def redacted_hits(hits: DataFrame, policies: list[dict], org: str | None = None, action: str = "query") -> DataFrame:
    """Snippets with the kinds of data redacted that the policies name for a hit's modality."""
    kinds = redaction_types(policies, F.col("modality"), F.lit(org), action)
    out = hits.withColumn("_kinds", kinds)
    clean = F.col("snippet")
    for kind in tx.PII:
        asked = F.array_contains("_kinds", kind) | F.array_contains("_kinds", "pii")
        clean = F.when(asked, tx.redact(clean, (kind,))).otherwise(clean)
    return out.withColumn("snippet", clean).drop("_kinds")


def respond(hits: DataFrame, request: Request, policies: list[dict] = ()) -> DataFrame:
    """A page of hits as they are returned (V25): order, highlight, and, for groups by asset, count and best score.

    With groups a page is so many assets, and holds all their hits; ``place``
    tells the order of hits or of groups, ``total`` how many there are.
    """
    limit = max(1, min(request.page_limit or request.top_k, request.top_k))
    shown = redacted_hits(hits, list(policies)) if policies else hits
    why = F.transform("why", lambda w: F.concat_ws(":", w["modality"], w["rank"].cast("string"), F.round(w["contribution"], 8).cast("string")))
    rows = shown.select(
        "asset_id", F.coalesce("asset_type", F.lit("unknown")).alias("asset_type"), fusion.canonical_modality(F.col("modality")).alias("modality"), "start_ms", "end_ms", F.round("score", 6).alias("score"),
        F.col("evidence_id").alias("primary_evidence_id"), "evidence_refs", tx.highlight(F.col("snippet"), request.query or "").alias("highlight_text"), "snippet", "uri", why.alias("why"),
    )
    every = Window.partitionBy(F.lit(0))  # a query's hits
    order = [F.desc("score"), F.coalesce("asset_id", F.lit("")), F.coalesce("start_ms", F.lit(-1)), F.coalesce("primary_evidence_id", F.lit(""))]
    if request.group_by is None:
        placed = rows.withColumn("place", F.row_number().over(every.orderBy(*order))).withColumn("total", F.count("*").over(every))
        return placed.where((F.col("place") > request.offset) & (F.col("place") <= request.offset + limit))
    own = Window.partitionBy("asset_id")
    grouped = rows.withColumn("clip_count", F.count("*").over(own)).withColumn("best_score", F.max("score").over(own)).withColumn("moment", F.row_number().over(own.orderBy(*order)))
    first = ["clip_count", "best_score"] if request.sort_by == "clip_count" else ["best_score", "clip_count"]
    rank = F.dense_rank().over(every.orderBy(F.desc(first[0]), "asset_id", F.desc(first[1])))
    placed = grouped.withColumn("place", rank)
    placed = placed.withColumn("total", F.max("place").over(every))
    return placed.where((F.col("place") > request.offset) & (F.col("place") <= request.offset + limit))


def hit_trace(hits: DataFrame, n: int = 5) -> DataFrame:
    """One row of JSON: uri, distance and score of the first hits of a branch."""
    top = hits.orderBy(F.asc_nulls_last("distance"), "id").limit(n)
    item = F.struct(F.round("distance", 6).alias("distance"), "uri", F.round(score_of_distance(F.col("distance")), 6).alias("score"))
    return top.agg(F.to_json(F.array_sort(F.collect_list(item))).alias("trace"))


def evidence(snapshot: Snapshot, *, uri: str | None = None, asset_id: str | None = None, scope: Mapping[str, str] = {}, frames: int = 12, transcripts: int = 8, documents: int = 6) -> DataFrame:
    """What is known of an asset, by its uri or id: kind, at (ms), text and status.

    Frames by time, those without one last; transcripts by time; documents by
    id; so many of each, which are limits of the bundle.  One row of status
    pending stands for an asset of which nothing is known yet.
    """
    assets = search.scoped(snapshot["media_assets"], **scope)
    wanted = assets.where(F.col("uri") == uri) if asset_id is None else assets.where(F.col("id") == asset_id)
    known = wanted.select(F.col("id").alias("media_asset_id")).limit(1)
    none = F.lit(None)
    parts = []
    if "image_assets" in snapshot:
        own = snapshot["image_assets"].join(known, "media_asset_id", "left_semi").orderBy(F.asc_nulls_last("timestamp_ms"), "id").limit(frames)
        parts.append(own.select(F.lit("frame").alias("kind"), F.col("timestamp_ms").cast("long").alias("at"), none.cast("string").alias("text")))
    if has_columns(snapshot, "transcripts", "content"):
        own = snapshot["transcripts"].join(known, "media_asset_id", "left_semi").orderBy(F.asc_nulls_last("start_ms"), "id").limit(transcripts)
        parts.append(own.select(F.lit("transcript").alias("kind"), F.col("start_ms").cast("long").alias("at"), F.col("content").alias("text")))
    if has_columns(snapshot, "doc_chunks", "content"):
        own = snapshot["doc_chunks"].join(known, "media_asset_id", "left_semi").orderBy("id").limit(documents)
        parts.append(own.select(F.lit("document").alias("kind"), none.cast("long").alias("at"), F.col("content").alias("text")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    ready = out.withColumn("status", F.lit("ready"))
    pending = out.sparkSession.range(1).select(none.cast("string").alias("kind"), none.cast("long").alias("at"), none.cast("string").alias("text"), F.lit("pending").alias("status"))
    found = out.agg(F.count("*").alias("_n"))
    return ready.unionAll(pending.crossJoin(F.broadcast(found)).where("_n = 0").drop("_n"))
