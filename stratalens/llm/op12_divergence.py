"""Operator 12, source divergence audit by a baseline-corrected inverted index.

How far two sources of a language lie apart is a sum over all V kept terms,
most of which neither source holds.  So each pair starts at V times f of its
two probabilities of a count of zero, and postings only emit what differs from
that.  What one side's count changes depends on the count alone, so it is added
up over a histogram of counts; only terms that both sources hold meet term by
term.  Integers all the way: p is at most 1e9 + 1, so its squares fit into 64
bits, and what may not is a decimal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, table

#: Terms of UTF-8 bytes: ASCII letters and every character beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A task emits its counts when it holds so many entries, or has read so many bytes.
ENTRIES, READ_BYTES, LONG_TEXT = 1 << 20, 256 << 20, 4 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, df) in held.items():
        terms = list(n)
        for i in range(0, len(terms), 65536):
            part = terms[i : i + 65536]
            yield pa.record_batch([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())], schema=_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, df rows that hold the term; added up within tasks, then over them."""

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = read = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode().lower()  # of bytes: A to Z only
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                if len(raw) > LONG_TEXT:
                    own = Counter(m[0] for m in TERM.finditer(raw))
                    for t, k in own.items():
                        n[t] += k
                    df.update(own.keys())
                else:
                    words = TERM.findall(raw)
                    n.update(words)
                    df.update(set(words))
                entries += len(n) - before
                read += len(raw)
                if entries >= ENTRIES or read >= READ_BYTES:
                    yield from _emit(held)
                    held, entries, read = {}, 0, 0
        yield from _emit(held)

    made = docs.select("lang", "source", "text").mapInArrow(lean(count), "lang string, source string, term string, n long, df long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * terms)), exactly; of no meaning without terms."""
    wide = lambda c: c.cast("decimal(18,0)")
    whole = F.greatest(wide(total) + wide(terms) + wide(terms), F.lit(1).cast("decimal(20,0)"))
    return F.call_function("div", F.lit(1000000000).cast("decimal(10,0)") * (wide(count) + F.lit(2).cast("decimal(18,0)")), whole) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_postings(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, term, source, n and the term's total in the lang, of terms that ``least`` rows of the lang hold."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("held_by", F.sum("df").over(of_term)).withColumn("total", F.sum("n").over(of_term))
    return counts.where(F.col("held_by") >= least).select("lang", "term", "source", "n", "total")


def source_divergence(docs: DataFrame, *, least: int = 10, top: int = 10, lang_column: str = "lang", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: sources apart from a source, and its ``top`` terms over those of its lang.

    Part ``pair``: every other source of the lang, by the sum of f over all
    kept terms.  Part ``term``: terms that the source uses more than its lang.
    Ranks go by value, descending, then by the item's bytes.  A null text,
    lang or source is an empty string; every row counts as a document, equal
    ones too; a source without terms, or a lang that keeps none, still has its
    pairs (of value 0 if no term is kept); a source alone in its lang has
    none; an empty table gives no rows.  Other columns are ignored.
    """
    named = {lang_column: "lang", source_column: "source", text_column: "text"}
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in named.items()])
    postings = materialize(kept_postings(docs, least))
    # what is known of a lang and of its sources: one row each
    langs = postings.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    groups = materialize(groups.withColumn("p0", probability(F.lit(0), F.col("group_n"), F.col("v"))))
    known = postings.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("group_n"), F.col("v")))

    # pairs, a before b: the baseline, what the counts of one side change, what the counts of both change
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"{x}0"), "v") for x in "ab")
    base = a.join(b.drop("v"), "lang").where(F.col("a") < F.col("b")).select("lang", "a", "b", (F.col("v") * difference(F.col("a0"), F.col("b0"))).alias("value"))
    histogram = known.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    alone = histogram.join(b.drop("v"), "lang").where(F.col("source") != F.col("b"))
    change = F.col("terms") * (difference(F.col("p"), F.col("b0")) - difference(F.col("p0"), F.col("b0")))
    alone = alone.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), change.alias("value"))
    left, right = (known.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"{x}p"), F.col("p0").alias(f"{x}0")) for x in "ab")
    change = difference(F.col("ap"), F.col("bp")) - difference(F.col("ap"), F.col("b0")) - difference(F.col("a0"), F.col("bp")) + difference(F.col("a0"), F.col("b0"))
    both = left.join(right, ["lang", "term"]).where(F.col("a") < F.col("b")).select("lang", "a", "b", change.alias("value"))
    sums = base.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    pairs = sums.select("lang", "value", ways).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    q = probability(F.col("total"), F.col("lang_n"), F.col("v"))
    over = known.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = over.withColumn("rank", rank).where(F.col("rank") <= top)  # cut before the exchange as well
    return pairs.withColumn("rank", rank).unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
