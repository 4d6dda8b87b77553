"""Fusion, reranking, interval merging, grouping and pages."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import clamp
from ..session import running

# Weights of modalities in rank fusion, and its constant.
FUSION_WEIGHTS = {"text": 1.0, "ocr": 1.0, "vision": 0.8, "audio": 0.8, "video": 1.0, "fts": 1.2}
FUSION_K = 60


#: Names under which modalities are weighed.
CANONICAL = {"document": "text", "transcript": "text", "text": "text", "image": "vision", "vision": "vision", "audio": "audio", "ocr": "ocr", "video": "video", "fts": "fts"}


def canonical_modality(modality: Column) -> Column:
    """The name that a modality is weighed under; unknown ones as they are, in lower case."""
    clean = F.lower(F.trim(modality))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv]), clean), clean)


def reciprocal_rank_fusion(hits: DataFrame, keys: list[str], *, tie: list[str], weights: dict[str, float] = FUSION_WEIGHTS, k: int = FUSION_K, why: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits (modality, score, keys) to one row a key: the sum of weight / (k + rank in its modality) over the largest such sum.

    Weights go by the canonical name of a modality, ranks by the name it has.
    With ``why``, an array tells the share of each hit.  ``carry`` names
    columns that a key keeps from its best hit (null ones from the next).
    Hits are the cuts of branches, so the largest sum is found among few rows.
    """
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("modality").orderBy(F.desc("score"), *tie)))
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    weight = F.coalesce(F.try_element_at(named, canonical_modality(F.col("modality"))), F.lit(1.0))
    part = ranked.withColumn("weight", weight).withColumn("contribution", F.col("weight") / (k + F.col("rank")))
    share = F.struct("modality", "rank", "weight", "contribution", F.col("score").alias("raw_score"))
    more = [F.sort_array(F.collect_list(share)).alias("why")] * why
    more += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("contribution", "score"))).alias(c) for c in carry]
    fused = part.groupBy(*keys).agg(F.sum("contribution").alias("fused"), F.count("*").alias("n_hits"), *more)
    top = F.max("fused").over(Window.partitionBy(F.lit(0)))
    return fused.withColumn("score", clamp(F.col("fused") / top))


def normalised_scores(df: DataFrame, column: str = "raw") -> DataFrame:
    """Scores within 0 and 1 as they are, equal ones as one half, all others through a sigmoid."""
    every = Window.partitionBy(F.lit(0))  # the rows that are reranked: few
    x, low, high = F.col(column), F.min(column).over(every), F.max(column).over(every)
    out = F.when((low >= 0) & (high <= 1), x).when(low == high, 0.5).otherwise(1 / (1 + F.exp(-x)))
    return df.withColumn("normalised", out)


def rerank_selection(df: DataFrame, *, top_n: int = 20, min_candidates: int = 5, budget: int = 6000, length: str = "chars", order: list[Column]) -> DataFrame:
    """The best-first prefix that is reranked: at most top_n rows, cut where the characters pass the budget once there are enough; a budget of 0 is none."""
    top = df.orderBy(*order).limit(top_n)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # top_n rows at most
    at = top.withColumn("rn", F.row_number().over(w)).withColumn("total", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("rn") > min_candidates) & (F.col("total") > budget) & F.lit(budget > 0)
    first = F.min(F.when(over, F.col("rn"))).over(Window.partitionBy(F.lit(0)))
    return at.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("rn") < F.col("_first"))).drop("_first", "total")


def blend(base: Column, reranked: Column, share: float = 0.5) -> Column:
    return clamp((1 - share) * base + share * reranked)


def rerank(hits: DataFrame, scorer: Column, *, order: list[Column], text: str = "snippet", top_n: int = 20, min_candidates: int = 5, budget: int = 6000, skip_gap: float = 0.1, skip_score: float = 0.9, share: float = 0.5) -> DataFrame:
    """Hits (modality, score, text) with the scores of the chosen ones blended with ``scorer``; all others stay as they are.

    Texts and texts read off images take part, best first, as in
    rerank_selection.  Nothing changes if fewer than ``min_candidates`` are
    chosen, or if the first is good (skip_score) and far ahead (skip_gap).
    Adds base_score and rerank_status.  Hits are a query's, so few.
    """
    every = Window.partitionBy(F.lit(0))
    wanted = canonical_modality(F.col("modality")).isin("text", "ocr") & (F.length(text) > 0)
    at = hits.withColumn("_in", F.coalesce(wanted, F.lit(False)))
    w = Window.partitionBy("_in").orderBy(*order)
    at = at.withColumn("_rn", F.row_number().over(w)).withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("_in") & (F.col("_rn") > min_candidates) & (F.col("_sum") > budget) & F.lit(budget > 0)
    at = at.withColumn("_cut", F.coalesce(F.min(F.when(over, F.col("_rn"))).over(every), F.lit(top_n + 1)))
    at = at.withColumn("_in", F.col("_in") & (F.col("_rn") <= top_n) & (F.col("_rn") < F.col("_cut")))
    chosen = lambda value: F.max(F.when(F.col("_in"), value)).over(every)
    nth = lambda n: chosen(F.when(F.col("_rn") == n, F.col("score")))
    many = F.coalesce(F.sum(F.col("_in").cast("int")).over(every), F.lit(0))
    confident = (many >= 2) & (nth(1) >= skip_score) & (nth(1) - nth(2) >= skip_gap)
    status = F.when(many == 0, "skipped_no_text_candidates").when(many < min_candidates, "skipped_low_candidate_count").when(confident, "skipped_confident_top_result").otherwise("applied")
    at = at.withColumn("rerank_status", status).withColumn("_raw", F.when(F.col("_in"), scorer))
    low, high = F.min("_raw").over(every), F.max("_raw").over(every)
    own = F.when((low >= 0) & (high <= 1), F.col("_raw")).when(low == high, 0.5).otherwise(1 / (1 + F.exp(-F.col("_raw"))))
    mixed = F.when(F.col("_in") & (F.col("rerank_status") == "applied"), blend(F.col("base_score"), own, share)).otherwise(F.col("base_score"))
    return at.withColumn("base_score", F.col("score")).withColumn("score", mixed).drop("_in", "_rn", "_sum", "_cut", "_raw")


def merge_intervals(df: DataFrame, group: list[str], gap: int, *, start: str = "start_ms", end: str = "end_ms", score: str = "score", carry: tuple[str, ...] = (), refs: str | None = None, tie: tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
    """Intervals of a group that touch within a gap, as one: its bounds, number and best score.

    An interval joins the one before it if it starts no later than the largest
    end so far and the gap; one without a start or an end stays by itself.
    ``carry`` columns come from the row of the best score (the first of
    equals), ``refs`` (an array) holds the distinct references of all, and
    ``note`` says where several were merged.  With ``longest``, groups of more
    rows than that are cut into ranges of about as many, a task each.
    """
    loose = F.col(start).isNull() | F.col(end).isNull()
    at = df.withColumn("_loose", loose)
    most = at.groupBy(*group, "_loose").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first() if longest is not None else (0, 0)
    if longest is not None and (most[0] or 0) > longest:
        keys, order, ranges = [*group, "_loose"], [start, end, *tie], max(2, math.ceil(most[1] / max(1, longest)))
        reach = running(at, keys, order, ranges, _before=("max", F.col(end)))
        opens = F.when(F.col("_loose") | F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap), 1).otherwise(0)
        numbered = running(reach.withColumn("_new", opens), keys, order, ranges, _opened=("sum", F.col("_new")))
        return _merged(numbered.withColumn("island", F.coalesce("_opened", F.lit(0)) + F.col("_new")), group, start, end, score, carry, refs)
    w = Window.partitionBy(*group, "_loose").orderBy(start, end, *tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = at.withColumn("_new", F.when(F.col("_loose") | before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _merged(island, group, start, end, score, carry, refs)


def _merged(island: DataFrame, group: list[str], start: str, end: str, score: str, carry: tuple[str, ...], refs: str | None) -> DataFrame:
    """One row an island."""
    first = lambda c: F.coalesce(-F.col(c), F.lit(0))
    best = [F.max_by(c, F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), first(start), first(end))).alias(c) for c in carry]
    if refs:
        texts = F.transform(refs, lambda r: F.to_json(r))  # maps have neither an order nor an equality
        listed = F.transform(F.array_sort(F.collect_list(F.struct(start, end, texts.alias("r")))), lambda x: x["r"])
        best.append(F.transform(F.array_distinct(F.flatten(listed)), lambda r: F.from_json(r, "map<string,string>")).alias(refs))
    out = island.groupBy(*group, "_loose", "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"), F.max(score).alias(score), *best)
    return out.withColumn("note", F.when(F.col("n_merged") > 1, "merged_adjacent_segments")).drop("_loose")


def backfill(primary: DataFrame, extra: DataFrame, key: str, k: int, *, order: list[Column]) -> DataFrame:
    """The primary hits and, after them, extra ones of keys that aren't there yet, k at most."""
    fresh = extra.join(primary.select(key).distinct(), key, "left_anti")
    both = primary.withColumn("tier", F.lit(0)).unionByName(fresh.withColumn("tier", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("tier", *order).limit(k)


def group_moments(hits: DataFrame, key: str, *, order: list[Column], keep: int = 3) -> DataFrame:
    """Hits with their place among those of their key, and the key's count and best score; the first ``keep`` of each.

    The cut is made before rows are exchanged, and sums are added up before
    that too, so a key of many hits is no one task's.
    """
    totals = hits.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("clip_count"), F.max("score").alias("best_score"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = hits.withColumn("moment", nth).where(F.col("moment") <= keep)
    return best.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def hit_order(asset: str = "asset_id", start: str = "start_ms", evidence: str = "evidence_id") -> list[Column]:
    return [F.desc("score"), F.coalesce(F.col(asset).cast("string"), F.lit("")), F.coalesce(start, F.lit(-1)), F.coalesce(F.col(evidence).cast("string"), F.lit(""))]


class CursorError(ValueError):
    """A cursor of another query or snapshot."""


def fingerprint(query: dict) -> str:
    return hashlib.sha256(json.dumps(query, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def encode_cursor(query: dict, snapshot: str, offset: int) -> str:
    body = {"fingerprint": fingerprint(query), "snapshot": snapshot, "offset": offset}
    return base64.urlsafe_b64encode(json.dumps(body, sort_keys=True).encode()).decode()


def decode_cursor(cursor: str | None, query: dict, snapshot: str) -> int:
    """The offset that a cursor stands for, 0 for none."""
    if not cursor:
        return 0
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor))
        known = body["fingerprint"] == fingerprint(query) and body["snapshot"] == snapshot
        offset = int(body["offset"])
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("not a cursor") from e
    if not known or offset < 0:
        raise CursorError("the cursor belongs to another query")
    return offset


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class SortKey:
    """A column that pages are ordered by; nulls come first going up and last going down, unless said otherwise."""

    column: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def nulls_at_end(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def order(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_at_end else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_at_end else c.asc_nulls_first()

    def after(self, value: Column, is_null: bool, *, or_same: bool = False) -> Column:
        """Whether a row comes after a value in this order."""
        c = F.col(self.column)
        if is_null:
            return F.lit(True) if or_same and not self.nulls_at_end else c.isNull() if self.nulls_at_end and or_same else F.lit(False) if self.nulls_at_end else c.isNotNull()
        beyond = (c <= value if or_same else c < value) if self.descending else (c >= value if or_same else c > value)
        return beyond | c.isNull() if self.nulls_at_end else beyond


def _told(value: object) -> str | None:
    """A sort value as text that casts back to it; times with their zone."""
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat()
    return None if value is None else repr(value) if isinstance(value, float) else str(value)


def keyset_cursor(query: dict, snapshot: str, keys: Sequence[SortKey], last: Row) -> str:
    """A cursor that holds the sort values of the last row of a page, and the snapshot that pages are read from."""
    body = {"fingerprint": fingerprint(query), "snapshot": snapshot, "order": [[k.column, k.descending, k.nulls_at_end] for k in keys], "last": [_told(last[k.column]) for k in keys]}
    return base64.urlsafe_b64encode(json.dumps(body, sort_keys=True).encode()).decode()


def read_keyset(cursor: str, query: dict, keys: Sequence[SortKey], snapshot: str | None = None) -> tuple[str, list[str | None]]:
    """The snapshot and the sort values of a cursor of the same query and order."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor))
        mine = body["fingerprint"] == fingerprint(query) and body["order"] == [[k.column, k.descending, k.nulls_at_end] for k in keys]
        pinned, last = str(body["snapshot"]), [None if v is None else str(v) for v in body["last"]]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("not a cursor") from e
    if not mine or len(last) != len(keys) or snapshot is not None and pinned != snapshot:
        raise CursorError("the cursor belongs to another query")
    return pinned, last


def seek(schema: StructType, keys: Sequence[SortKey], last: Sequence[str | None]) -> Column:
    """Rows after a row in the order of keys, by comparisons that a scan can prune by.

    A row comes after if it does in one key and equals in those before it; what
    that means for the first key alone stands beside it, as files are cut by it.
    """
    values = [F.lit(v).cast(schema[k.column].dataType) for k, v in zip(keys, last)]
    out = F.lit(False)
    for i in reversed(range(len(keys))):
        same = F.col(keys[i].column).isNull() if last[i] is None else F.col(keys[i].column) == values[i]
        out = keys[i].after(values[i], last[i] is None) | (same & out)
    return keys[0].after(values[0], last[0] is None, or_same=True) & F.coalesce(out, F.lit(False))


def keyset_page(df: DataFrame, query: dict, keys: Sequence[SortKey], limit: int, cursor: str | None = None, snapshot: str = "") -> DataFrame:
    """The page after a cursor, the first one without; the last key must tell rows apart.

    A full page has a next one: keyset_cursor() of its last row.  A page costs
    a scan of what comes after its first row, of which each task keeps
    ``limit`` rows, whichever page it is.
    """
    if cursor:
        _, last = read_keyset(cursor, query, keys, snapshot)
        df = df.where(seek(df.schema, keys, last))
    return df.orderBy(*[k.order() for k in keys]).limit(limit)
