"""Search branches: scope, keyword, metadata, vectors, full text, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp, cosine_distance, score_of_distance

# Multipliers of modalities, and the words in a query that hint at one.
MODALITY_BOOSTS = {"document": 1.0, "transcript": 1.0, "image": 1.05, "audio": 1.05}
HINT_BOOST = 1.15
HINTS = {
    "video": {"image"}, "frame": {"image"}, "frames": {"image"}, "clip": {"image"}, "image": {"image"}, "photo": {"image"}, "visual": {"image"},
    "audio": {"audio"}, "sound": {"audio"}, "speech": {"audio", "transcript"}, "podcast": {"audio"}, "music": {"audio"},
}
OCR_SOURCES = ("image", "keyframe", "pdf_page")


def scoped(df: DataFrame, **scope: str | None) -> DataFrame:
    """Rows of a tenant: equality on each column that is given; a column that isn't there is an error."""
    for name, value in scope.items():
        if value is None:
            continue
        if name not in df.columns:
            raise ValueError(f"no column {name} to scope by")
        df = df.where(F.col(name) == value)
    return df


def with_scope_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Scope columns filled with defaults, and added where they are missing."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def keyword(df: DataFrame, column: str, query: str) -> DataFrame:
    """Case-insensitive containment; % and _ in the query are wildcards."""
    return df.where(F.col(column).ilike(f"%{query.strip()}%"))


def metadata(df: DataFrame, allowed: dict[str, str], **filters: str) -> DataFrame:
    """Conjunction of filters; ``allowed`` says of each column whether it is matched by "contains" or "equals"."""
    for name, value in filters.items():
        if name not in allowed:
            raise ValueError(f"unknown metadata filter {name}")
        df = df.where(F.col(name).ilike(f"%{value}%") if allowed[name] == "contains" else F.col(name) == value)
    return df


def modality_of(source_type: Column, own: str = "document") -> Column:
    """Text read off images counts as ocr."""
    return F.when(source_type.isin(*OCR_SOURCES), "ocr").otherwise(own)


def boost(score: Column, modality: str, query: str, boosts: dict[str, float] = MODALITY_BOOSTS, hint: float = HINT_BOOST) -> Column:
    """A score times what its modality and the query's words are worth, clamped."""
    hinted = {m for word, ms in HINTS.items() if word in query.lower() for m in ms}
    return clamp(score * F.lit(boosts.get(modality, 1.0) * (hint if modality in hinted else 1.0)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, *, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k nearest by cosine distance, ties by ``tie``; adds distance and score.

    Ranked before anything is joined to it, so the wide columns of k rows only
    are fetched.
    """
    ranked = vectors.where(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(vector, query))
    return ranked.orderBy(F.asc_nulls_last("distance"), tie).limit(k).withColumn("score", score_of_distance(F.col("distance")))


def branches(*parts: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """Branches one after another, cut to the k best scores; equal scores stay in branch order, then by ``tie``."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("branch_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(F.desc("score"), "branch_ord", *tie).limit(k)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of lower-case runs of letters a to z."""
    terms = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]+)"), F.lit(1)))
    return df.select(key, terms.alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _counted(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, dl and tf_0 ...: the length of a text in words and how often each term stands in it, worked out in one go."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")
    times = lambda w: F.array(*[F.size(w) - F.size(F.array_remove(w, t)) for t in terms])
    facts = lambda w: F.struct(F.size(F.array_remove(w, "")).alias("dl"), times(w).alias("tf"))
    # a lambda's variable is a value, and what a generator makes is not worked out again for each use
    once = df.select(key, F.inline(F.transform(F.array(words), facts)))
    return once.select(key, "dl", *[F.col("tf")[i].alias(f"tf_{i}") for i in range(len(terms))])


def bm25(df: DataFrame, key: str, text: str, query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows that hold a query term, by Okapi BM25.

    Texts are read and split once: their few numbers go through one exchange,
    from which both the corpus figures (one row) and the scores are taken.
    """
    terms = sorted(set(re.findall("[a-z]+", query.lower())))
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    counted = _counted(df, key, text, terms).repartition(key)
    # all columns of the exchange are used on both sides, so that it is one
    n = (F.count(key) + F.count_if(F.col(key).isNull())).alias("n")
    stats = counted.agg(n, F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df_i = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.ln((F.col("n") - df_i + 0.5) / (df_i + 0.5) + 1)
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # positive where a term stands, and only there; a condition on the sum can't be drawn below the exchange
    return both.select(key, total.alias("score")).where("score > 0")


#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 10_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count of rows, which stops beyond the limit, allows it; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def against_all(rows: DataFrame, queries: DataFrame, blocks: int = 64) -> DataFrame:
    """Every row beside every query of a stated set: a broadcast of a small set, else block by block of the queries.

    Blocks are an equi-join: a row goes to each block once, a query to one.
    """
    if queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.crossJoin(F.broadcast(queries))
    own = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)))
    every = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return every.join(own, "_block").drop("_block")


def label_scores(frames: DataFrame, labels: DataFrame, *, how: str = "max", top_k: int = 8, by: Sequence[str] = (), most: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Scores of labels (label, category, vector) against frames (vector): max or mean of dot products, clipped, the best of each category.

    With ``by``, for each asset by itself, over its first ``most`` frames in
    ``order``.  Labels are broadcast if they are few.
    """
    from ..functions.vectors import dot

    by = list(by)
    if most is not None:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        frames = frames.withColumn("_nth", nth).where(F.col("_nth") <= most)
    pairs = against_all(frames.select(*by, F.col("vector").alias("fv")), labels)
    scored = pairs.withColumn("s", dot(F.col("fv"), F.col("vector")))
    agg = F.max("s") if how == "max" else F.avg("s")
    best = scored.groupBy(*by, "category", "label").agg(clamp(agg).alias("score"))
    w = Window.partitionBy(*by, "category").orderBy(F.desc("score"), "label")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
