"""Operator 3, benchmark decontamination by SimHash windows; DataFrame functions only.

Windows of the size of each benchmark item run over every document.  A window
can only reach the similarity if it holds enough shingles of the item, so the
rolling shingles are joined to those of the items first, which loses nothing.
Fingerprints of the windows that are left meet those of the items in a
multi-index: with one block more than the radius, two fingerprints within it
agree on a block.  What is within the radius is verified by the weighted
similarity of its shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, clash_free, materialize, release, table
from .native import blocks, first_zero_block, multiset_overlap, rolling_hashes, simhash, spaced_words

#: Rows of a side that is broadcast, at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _shingled(df: DataFrame, ks: list[int]) -> DataFrame:
    """Adds ``grams``, an array of (k, hashes) for each k."""
    parts = [F.struct(F.lit(k).alias("k"), rolling_hashes(F.col("words"), k).alias("hashes")) for k in ks]
    return df.withColumn("grams", F.array(*parts))


def leaks(docs: DataFrame, items: DataFrame, *, k: int = 5, similarity: float = 0.8, radius: int = 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """Passages of documents that resemble a benchmark item.

    Columns: doc_id, text_hash (tells rows of one id apart), item_id,
    start_word, n_words and similarity, the best window of each document and
    item.  Words are lower-cased runs of characters other than white space;
    items of fewer than k words count as one shingle; null and empty texts
    match nothing, on either side; a document shorter than an item is one
    window.  Weights are the counts of a shingle in window and item.
    """
    words = spaced_words(F.lower(F.col("text")))
    own = items.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("text")).distinct().withColumn("words", words).where("size(words) > 0")
    own = own.select("item_id", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(k)).alias("k"))
    ks = sorted(r["k"] for r in own.select("k").distinct().collect())  # at most k numbers
    if not ks:
        ks = [k]
    own = _shingled(own, ks).select("item_id", "size", "k", F.filter("grams", lambda g: g["k"] == F.col("k"))[0]["hashes"].alias("hashes"))
    own = materialize(own.select("*", F.size("hashes").alias("n"), simhash(F.col("hashes")).alias("fp")))
    grams = own.select("item_id", "size", "k", "n", F.explode(F.array_distinct("hashes")).alias("h"))
    many = grams.count()

    base = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text")).where("text is not null")
    cut = base.withColumn("words", words)
    shingled = _shingled(cut, ks).select("doc_id", "text_hash", F.size("words").alias("doc_words"), F.explode("grams").alias("g"))
    rolled = shingled.select("doc_id", "text_hash", "doc_words", F.col("g.k").alias("k"), F.posexplode("g.hashes").alias("pos", "h"))
    hits = rolled.join(bounded_broadcast(grams, many, BROADCAST_ROWS), ["k", "h"])

    # Windows begin at a hit; hits meet in spans of two item sizes, so a group is never longer than that.
    spans = hits.withColumn("span", F.explode(F.array((F.col("pos") / F.col("n")).cast("int"), (F.col("pos") / F.col("n")).cast("int") - 1)))
    groups = spans.groupBy("doc_id", "text_hash", "doc_words", "item_id", "size", "n", "span").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    shared = similarity / (1 + similarity)  # of all shingles of both, what must be common
    held = F.least(F.col("n"), F.col("doc_words") - F.col("size") + F.col("n"))  # shingles of the window
    need = F.ceil(F.lit(shared) * (F.col("n") + held) - F.lit(1e-9))
    last = F.greatest(F.lit(0), F.col("doc_words") - F.col("size"))
    inside: Column = F.filter("at", lambda s: (F.col("span") * F.col("n") <= s) & (s < (F.col("span") + 1) * F.col("n")))
    full = lambda s: F.size(F.filter("at", lambda p: (s <= p) & (p < s + F.col("n")))) >= F.col("need")
    windows = groups.withColumn("need", need).where((F.col("need") > 0) & (F.size("at") >= F.col("need")))
    starts = F.transform(inside, lambda s: F.least(s, F.col("last")))
    windows = windows.withColumn("last", last).withColumn("start", F.explode(F.array_distinct(starts)))
    windows = materialize(windows.where(full(F.col("start"))).select("doc_id", "text_hash", "size", "start").distinct())
    kept = windows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("size", "start")).alias("windows"))
    few = kept.select(F.sum(F.size("windows"))).first()[0] or 0

    # Only documents with such windows are split again: the join stands below the words.
    back = base.join(bounded_broadcast(kept.withColumnRenamed("doc_id", "id2"), few, BROADCAST_ROWS).withColumnRenamed("text_hash", "hash2"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2"))).withColumn("words", words)
    back = _shingled(back, ks).select("doc_id", "text_hash", F.size("words").alias("doc_words"), "grams", F.explode("windows").alias("w"))
    cut_k = F.least(F.col("w.size"), F.lit(k))
    hashes = F.slice(F.filter("grams", lambda g: g["k"] == cut_k)[0]["hashes"], F.col("w.start") + 1, F.col("w.size") - cut_k + 1)
    finger = back.select("doc_id", "text_hash", F.col("w.size").alias("size"), F.col("w.start").alias("start"), F.least("doc_words", "w.size").alias("n_words"), hashes.alias("window"))
    finger = finger.withColumn("wfp", simhash(F.col("window")))

    index = own.select("item_id", "size", "hashes", "fp", F.explode(blocks(F.col("fp"), radius + 1)).alias("b"))
    index = bounded_broadcast(index, own.count() * (radius + 1), BROADCAST_ROWS)
    probes = finger.withColumn("b", F.explode(blocks(F.col("wfp"), radius + 1)))
    apart = F.col("fp").bitwiseXOR(F.col("wfp"))
    # a pair that agrees on several blocks is taken at the first of them
    near = probes.join(index, ["size", "b"]).where((F.bit_count(apart) <= radius) & (F.col("b.block") == first_zero_block(apart, radius + 1)))
    common = multiset_overlap(F.col("hashes"), F.col("window"))
    alike = near.withColumn("common", common).withColumn("similarity", F.round(F.col("common") / (F.size("hashes") + F.size("window") - F.col("common")), 6))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words"))
    found = alike.where(F.col("similarity") >= similarity).groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "text_hash", "item_id", F.col("b.start").cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), (-F.col("b.s")).alias("similarity"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@clash_free
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = materialize(leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2")).distinct())
    few = bounded_broadcast(found, found.count(), BROADCAST_ROWS)
    out = docs.join(few, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.xxhash64("text") == F.col("hash2")), "left_anti")
    return out.select(*docs.columns)
