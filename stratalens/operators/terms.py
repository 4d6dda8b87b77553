"""A full-text index: postings in blocks with their largest impact, searched without what can't reach the top k.

Texts are sorted by length and cut into ranges, so a range holds texts of like
length and a block's largest impact says something of all of it.  A block is a term's
postings in one range; the blocks of all terms have the same ranges, so the
largest impacts of a query's terms add up to a bound of a range's scores.  A
search scores the ranges of the highest bounds first; ranges whose bound is
below the k-th score so found are never read.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import porter
from ..functions.text import ascii_fold
from ..session import materialize
from ..sources.snapshots import SnapshotLog

#: Texts of a range; files that an index is dealt to, by the hashes of terms.
RANGE, BUCKETS = 4_096, 64
#: Bytes of text that are counted at once; entries of a range, at most, unless one text has more.
SLICE_BYTES, RANGE_ENTRIES = 4 << 20, 4 << 20
#: Words of the texts for each file of blocks, about.
PART_WORDS = 2_000_000


def _folded(c: str) -> str:
    """A character as ascii_fold() has it."""
    if c.isascii():
        return c
    plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() if 0x80 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 else ""
    return plain if len(plain) == 1 else ""


@dataclass(frozen=True)
class Analysis:
    """How texts become terms: lower-case runs of a to z, accents folded or not, stop words left out, stems or whole words."""

    accents: bool = False
    stems: bool = False
    stop_words: tuple[str, ...] = ()

    def terms_of(self, query: str) -> list[str]:
        """The distinct terms of a query, in order."""
        text = "".join(map(_folded, query)) if self.accents else query
        words = [w for w in re.findall("[a-z]+", text.lower()) if w not in self.stop_words]
        return sorted({porter(w) if self.stems else w for w in words})

    def lowered(self, text: Column) -> Column:
        """A text in lower case, whose runs of a to z are its words; a null one has none."""
        text = F.coalesce(text, F.lit(""))
        return F.lower(ascii_fold(text) if self.accents else text)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """Runs of a to z, and the text that each stands in."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = data - np.uint8(97) < 26
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = ends[:-1][ends[:-1] < data.size]
    first[heads] = letter[heads]  # no word goes on in the next text
    starts, body = np.flatnonzero(first), data[letter]
    sizes = np.add.reduceat(letter, starts, dtype=np.int32) if starts.size else starts
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends)))
    return of, pa.StringArray.from_buffers(starts.size, pa.py_buffer(offsets), pa.py_buffer(body))


def _packed(offsets: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """Numbers as blobs of 32 bits each, the most significant byte first."""
    data = numbers.astype(">u4")
    width = data.nbytes // max(1, len(data))  # of a row of numbers
    return pa.Array.from_buffers(pa.binary(), offsets.size - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(data)])


def _counted(analysis: Analysis):
    """An Arrow function from (key, lower-case text) to (key, dl, terms, tfs), some megabytes of text at a time.

    A text's distinct terms are one string, and how often each stands there 32
    bits each: blobs, which Spark moves and writes as wholes.
    """

    def counts(key: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        of, words = _words(texts)
        coded = words.dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy(), coded.dictionary
        if analysis.stop_words:
            kept = ~pc.is_in(vocabulary, pa.array(analysis.stop_words, pa.string())).to_numpy(zero_copy_only=False)[codes]
            of, codes = of[kept], codes[kept]
        dl = np.bincount(of, minlength=len(texts))
        if analysis.stems:
            stems = pa.array([porter(w) for w in vocabulary.to_pylist()], pa.string()).dictionary_encode()
            codes, vocabulary = stems.indices.to_numpy()[codes], stems.dictionary
        pairs, tf = np.unique(of.astype(np.int64) * max(1, len(vocabulary)) + codes, return_counts=True)
        of, codes = np.divmod(pairs, max(1, len(vocabulary)))
        offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), vocabulary.take(pa.array(codes))), " ")
        return pa.RecordBatch.from_arrays([key, pa.array(dl, pa.int64()), terms, _packed(offsets, tf)], names=["key", "dl", "terms", "tfs"])

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                yield counts(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at))
                at = to

    return run


def _inverted(size: int, avgdl: float, k1: float, b: float):
    """An Arrow function from texts in order (part, key, dl, terms, tfs) to the blocks of ranges of them; figures are tf and dl of each key.

    A range ends after ``size`` texts, or before the text with which it would
    hold more than RANGE_ENTRIES entries.
    """

    def blocks(held: list[pa.RecordBatch], no: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        part, key, dl, terms, tfs = rows.columns
        of, words = _words(terms)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        tf = np.frombuffer(b"".join(tfs.to_pylist()), ">u4")[order].astype(np.int64)
        of = of[order]
        dl = dl.to_numpy()[of]
        n = np.bincount(codes, minlength=len(coded.dictionary))
        ends = np.append(0, np.cumsum(n))
        most = np.maximum.reduceat(impact(tf, dl, avgdl, k1, b), ends[:-1]) if n.size else np.zeros(0)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), key.take(pa.array(of))), _packed(ends, np.stack([tf, dl], 1))]
        own = [coded.dictionary, pa.array(np.full(n.size, (part[0].as_py() << 32) + no), pa.int64()), pa.array(n, pa.int64()), pa.array(most, pa.float64())]
        return pa.RecordBatch.from_arrays([*own, *lists], names=["term", "range", "n", "most", "keys", "figures"])

    def run(batches):
        held, rows, entries, no = [], 0, 0, 0
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column(4)).to_numpy() // 4, dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                fits = int(np.searchsorted(ends, ends[at] + RANGE_ENTRIES - entries, "right")) - 1 - at
                take = max(min(size - rows, batch.num_rows - at, fits), int(not rows))  # a text alone may be larger
                if take > 0:
                    held.append(batch.slice(at, take))
                    rows, entries, at = rows + take, entries + int(ends[at + take] - ends[at]), at + take
                if rows == size or at < batch.num_rows:
                    yield blocks(held, no)
                    held, rows, entries, no = [], 0, 0, no + 1
        if rows:
            yield blocks(held, no)

    return run


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def impact(tf: Column | np.ndarray, dl: Column | np.ndarray, avgdl: float | Column, k1: float, b: float) -> Column | np.ndarray:
    """What a term is worth in a text, but for how rare it is."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def build_terms(texts: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", analysis: Analysis = Analysis(), k1: float = 1.2, b: float = 0.75, size: int = RANGE) -> int:
    """Index every text, in one version of a snapshot; how many texts there are.

    Keys tell texts apart; a null text has no terms, and counts as a text.
    """
    spark, kind = texts.sparkSession, texts.select(key).schema[0].dataType.simpleString()
    held = materialize(texts.select(F.col(key).alias("key"), analysis.lowered(F.col(text)).alias("text")).mapInArrow(_counted(analysis), f"key {kind}, dl long, terms string, tfs binary"))
    figures = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("words")).first()
    if not figures["n"]:
        return 0
    # one exchange puts texts of like length side by side, and a task cuts its own into ranges
    placed = held.repartitionByRange("dl", "key").sortWithinPartitions("dl", "key").select(F.spark_partition_id().alias("part"), "key", "dl", "terms", "tfs")
    inverted = placed.mapInArrow(_inverted(size, float(figures["avgdl"] or 1), k1, b), f"term string, range long, n long, most double, keys array<{kind}>, figures binary")
    # by buckets, and within large ones by where their ranges come from
    parts = max(1, figures["words"] // PART_WORDS)
    wide, slices = min(parts, BUCKETS), -(-parts // BUCKETS)
    blocks = inverted.select(_bucket(F.col("term")).alias("bucket"), "*")
    part = F.floor(F.col("bucket") * wide / BUCKETS) * slices + F.pmod(F.shiftright("range", 32), F.lit(slices))
    blocks = blocks.repartitionById(wide * slices, part.cast("int")).sortWithinPartitions("bucket", "term", "range")
    log, commit = SnapshotLog(spark, path), uuid.uuid4().hex
    seen = log.version()
    gone = [(r["table"], r["uri"]) for r in log.files(seen).select("table", "uri").collect()] if seen >= 0 else []
    facts = spark.createDataFrame([(figures["n"], float(figures["avgdl"] or 1), k1, b, analysis.accents, analysis.stems, list(analysis.stop_words))], "n long, avgdl double, k1 double, b double, accents boolean, stems boolean, stop_words array<string>").coalesce(1)
    added = log.write("blocks", blocks, commit) + log.write("facts", facts, commit)
    log.commit(added, gone, schemas={"blocks": blocks.schema, "facts": facts.schema}, read_version=seen, commit=commit)
    return figures["n"]


@dataclass
class TermSearch:
    """A search: its hits (key, score), and the ranges (range, bound, looked_at) that it weighed."""

    hits: DataFrame
    ranges: DataFrame


def search_terms(spark: SparkSession, path: str, query: str, k: int) -> TermSearch:
    """The k best texts by BM25, ties by key: as by a scan of all texts, with most blocks unread."""
    log = SnapshotLog(spark, path)
    version = log.version()
    nothing = TermSearch(spark.createDataFrame([], "key long, score double"), spark.createDataFrame([], "range long, bound double, looked_at boolean"))
    if version < 0 or k < 1:
        return nothing
    facts = log.read("facts", version).first()
    terms = Analysis(facts["accents"], facts["stems"], tuple(facts["stop_words"])).terms_of(query)
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    buckets = [r["b"] for r in asked.select(_bucket(F.col("term")).alias("b")).distinct().collect()]
    own = log.read("blocks", version, bucket=buckets).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    rare = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term of the query
    if not rare:
        return nothing
    terms = [t for t in terms if t in rare]
    idf = F.coalesce(*[F.when(F.col("term") == t, F.ln((F.lit(float(facts["n"])) - rare[t] + 0.5) / (rare[t] + 0.5) + 1)) for t in terms])
    # figures of blocks only: the arrays of entries aren't read
    bounds = materialize(own.groupBy("range").agg(F.sum(idf * F.col("most")).alias("bound")))

    def scored(ranges: DataFrame) -> DataFrame:
        wanted = own.join(ranges.select("range"), "range", "left_semi")
        entries = wanted.select("term", idf.alias("idf"), "figures", F.posexplode("keys").alias("at", "key"))
        figure = lambda i: F.conv(F.hex(F.substring("figures", F.col("at") * 8 + 1 + 4 * i, F.lit(4))), 16, 10).cast("long")
        at = entries.select("term", "key", (F.col("idf") * impact(figure(0), figure(1), facts["avgdl"], facts["k1"], facts["b"])).alias("part"))
        parts = at.groupBy("key").agg(*[F.max(F.when(F.col("term") == t, F.col("part"))).alias(f"p{i}") for i, t in enumerate(terms)])
        total = F.lit(0.0)
        for i in range(len(terms)):  # always in one order, so that equal texts have equal scores
            total = total + F.coalesce(f"p{i}", F.lit(0.0))
        return parts.select("key", total.alias("score")).orderBy(F.desc("score"), "key").limit(k)

    # a range that stands here holds one text at least, so k of them hold k
    first = materialize(bounds.orderBy(F.desc("bound"), "range").limit(k))
    best = materialize(scored(first))
    least = best.agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0)).first()[0]
    rest = bounds.join(first.select("range"), "range", "left_anti").where(F.col("bound") >= least - 1e-9)
    hits = best.unionAll(scored(rest)).orderBy(F.desc("score"), "key").limit(k)
    looked = first.select("range").unionAll(rest.select("range")).withColumn("looked_at", F.lit(True))
    return TermSearch(hits, bounds.join(looked, "range", "left").na.fill(False, ["looked_at"]))
