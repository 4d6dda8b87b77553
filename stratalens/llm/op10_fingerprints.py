"""Operator 10, document fingerprints from closed syncmers; DataFrame functions only.

A k-mer of words is chosen if the least hash of its inner s-mers lies at its
first or last place: a choice that depends on the k-mer alone, so an edit
leaves all anchors beyond its reach as they were.  A fingerprint keeps all
anchors, each with the place it stands at, and two fingerprints are compared
by the anchors that match on neighbouring diagonals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, bucket_count, materialize, table, text_bytes
from .native import bind, spaced_words

K, S = 4, 2
#: Bits of an anchor's place.
PLACE = 24


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors of a text as structs (hash, place), repeats included.

    A text of fewer than k words is one anchor; a text without words has none.
    """
    inner = k - s  # places of s-mers in a k-mer, from 0

    def anchors(w: Column) -> Column:
        smers = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - s, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j if j else i) for j in range(s)]))

        def chosen(h: Column) -> Column:
            edge = lambda i: F.least(F.get(h, i), F.get(h, i + inner))
            between = lambda i: [F.get(h, i + j) for j in range(1, inner)]
            closed = lambda i: edge(i) <= (F.least(*between(i)) if inner > 2 else between(i)[0])
            at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), closed)
            return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + inner)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"), i.alias("place")))

        whole = F.array(F.struct(F.xxhash64(w).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"), F.lit(0).alias("place")))
        return F.when(F.size(w) >= k, bind(smers, chosen)).when(F.size(w) > 0, whole).otherwise(F.slice(whole, 1, 0))

    return bind(spaced_words(F.lower(text)), anchors)


def packed_anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All anchors as numbers, ascending: hash (32 bits), then place (24 bits, the last value for all beyond)."""
    packed = F.transform(syncmers(text, k, s), lambda a: F.shiftleft(a["hash"], PLACE) + F.least(a["place"], F.lit((1 << PLACE) - 1)))
    return F.sort_array(packed)


def as_text(numbers: Column) -> Column:
    """Anchors as hex digits, 14 an anchor."""
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x), 14, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the anchors of both that match at consistent places; 1 for two empty ones.

    Anchors of one hash match in their order, each on a diagonal, the
    difference of its two places.  Those on the diagonals of one band count: a
    sixteenth of the anchors of the larger side, 16 at least; the best band of
    a grid and of that grid moved by half a band.
    """
    tagged = lambda xs, side: F.transform(xs, lambda x: F.shiftleft(F.shiftrightunsigned(x, PLACE), PLACE + 1) + F.lit(side << PLACE) + x.bitwiseAND(F.lit((1 << PLACE) - 1)))
    side = lambda x: F.shiftrightunsigned(x, PLACE).bitwiseAND(F.lit(1))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))

    def runs(xs: Column, value: Callable[[Column], Column]) -> Column:
        """Places where runs of equal values start in a sorted array, and its size."""
        at = F.filter(F.sequence(F.lit(0), F.size(xs)), lambda i: (i == 0) | (i == F.size(xs)) | (value(F.get(xs, i)) != value(F.get(xs, i - 1))))
        return F.when(F.size(xs) > 0, at).otherwise(F.array().cast("array<int>"))

    def diagonals(xs: Column) -> Column:
        def matched(run: Column) -> Column:
            many = F.size(F.filter(run, lambda x: side(x) == 0))
            pairs = F.least(many, F.size(run) - many)
            return F.transform(F.slice(run, 1, pairs), lambda x, i: place(F.get(run, many + i)) - place(x))

        starts = runs(xs, lambda x: F.shiftrightunsigned(x, PLACE + 1))
        groups = bind(starts, lambda at: F.filter(F.transform(at, lambda s, i: F.slice(xs, s + 1, F.coalesce(F.get(at, i + 1), s) - s)), lambda run: F.size(run) > 1))
        return F.flatten(F.transform(groups, lambda run: bind(run, matched)))

    def best(found: Column, width: Column) -> Column:
        most = lambda bands: bind(runs(bands, lambda x: x), lambda at: F.coalesce(F.array_max(F.transform(at, lambda s, i: F.coalesce(F.get(at, i + 1), s) - s)), F.lit(0)))
        grid = lambda move: F.sort_array(F.transform(found, lambda d: F.floor((d + move) / width)))
        return F.greatest(bind(grid(F.lit(0)), most), bind(grid(F.floor(width / 2)), most))

    def share(p: Column) -> Column:
        total = F.size(p["a"]) + F.size(p["b"])
        width = F.greatest(F.lit(16), F.floor(F.greatest(F.size(p["a"]), F.size(p["b"])) / 16))
        met = bind(bind(F.sort_array(F.concat(tagged(p["a"], 0), tagged(p["b"], 1))), diagonals), lambda found: best(found, width))
        hashes = lambda xs: F.transform(xs, lambda x: F.shiftrightunsigned(x, PLACE))
        # texts without a hash in common, as most of two documents are, need no diagonals
        apart = ~F.arrays_overlap(hashes(p["a"]), hashes(p["b"]))
        return F.when(total == 0, F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(bind(met, lambda m: m / (total - m)))

    return F.round(bind(F.struct(a.alias("a"), b.alias("b")), share), 6)


#: Ranges of a group, whose largest keys a row is compared with after those of the groups; ranges in all, at most, for a broadcast of 16 bytes each.
GROUP, MOST_RANGES = 1024, 8_000_000


def range_tops(keys: DataFrame, many: int) -> DataFrame:
    """(range, id, hash): the largest key of each of ``many`` even ranges, numbered from 1 in descending order of keys."""
    down = [F.desc("id"), F.desc("hash")]
    ranged = keys.repartitionByRange(many, *down).select("id", "hash", F.spark_partition_id().alias("part"))
    tops = ranged.groupBy("part").agg(F.max(F.struct("id", "hash")).alias("top")).select("top.*")
    # one row a range, whatever the keys
    return materialize(tops.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*down)).alias("range"), "id", "hash"))


def with_range(rows: DataFrame, tops: DataFrame, many: int) -> DataFrame:
    """rows (id, hash, ...) with the number of their range: first among the groups of ranges, then within the group."""
    key = F.struct("id", "hash")
    listed = lambda df, *by: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "hash")), asc=False).alias("tops"))
    group = F.floor((F.col("range") - 1) / GROUP).cast("int")
    heads = listed(tops.where((F.col("range") - 1) % GROUP == 0)).withColumnRenamed("tops", "heads")  # one row
    groups = listed(tops.withColumn("group", group), "group")
    reached = lambda c: F.size(F.filter(c, lambda t: t >= key))
    at = rows.crossJoin(F.broadcast(heads)).withColumn("group", reached("heads") - 1).drop("heads")
    both = at.join(bounded_broadcast(groups, many, MOST_RANGES), "group")
    return both.withColumn("range", F.col("group") * GROUP + reached("tops")).drop("group", "tops")


def fingerprint_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document, descending ids, null ids last, the
    first after the last; rows of one id go by the hash of their text, and rows
    equal in both are one document.  A null text is empty.  Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """
    lowest = -(1 << 63)
    base = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(lowest)).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    base = base.withColumn("hash", F.xxhash64("text"))
    n = bucket_count(docs.sparkSession, text_bytes(docs, text_column))
    tops = range_tops(base.select("id", "hash").distinct(), 4 * n)
    ranged = with_range(base, tops, 4 * n)
    # the texts move once, to the place of their range; a range is followed by the top of the next one
    near = ranged.repartition(n, "range")
    following = F.struct("id", "hash", "text")
    after = F.lead(following).over(Window.partitionBy("range").orderBy(F.desc("id"), F.desc("hash")))
    near = near.withColumn("after", after).withColumn("after", F.when(F.struct("after.id", "after.hash") == F.struct("id", "hash"), None).otherwise(F.col("after")))
    near = near.withColumn("after", F.max("after").over(Window.partitionBy("range", "id", "hash")))
    # the first text of a range follows the last one of the range before, the very first the very last
    last = tops.agg(F.max("range").alias("last"))
    wanted = tops.crossJoin(F.broadcast(last)).select("id", "hash", F.when(F.col("range") == 1, F.col("last")).otherwise(F.col("range") - 1).alias("range"))
    few = bounded_broadcast(wanted, 4 * n, MOST_RANGES)
    heads = base.join(few, ["id", "hash"]).dropDuplicates(["range"]).select("range", F.struct("id", "hash", "text").alias("head"))  # one text a range
    both = near.join(heads, "range", "left").withColumn("next", F.coalesce("after", "head"))
    both = both.select("doc_id", "text", F.col("next.text").alias("next_text"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = both.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "text", "next_text")
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "next_text", "edited")
    values = F.struct(packed_anchors(F.col("text")).alias("own"), packed_anchors(F.col("edited")).alias("changed"), packed_anchors(F.col("next_text")).alias("next"))
    result = bind(values, lambda v: F.struct(as_text(v["own"]).alias("fingerprint"), as_text(v["changed"]).alias("edited_fingerprint"), likeness(v["own"], v["changed"]).alias("near_edited"), likeness(v["own"], v["next"]).alias("near_next")))
    return out.select("doc_id", "n_chars", "edited_sha256", result.alias("r")).select("doc_id", "n_chars", "edited_sha256", "r.fingerprint", "r.edited_fingerprint", "r.near_edited", "r.near_next")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
