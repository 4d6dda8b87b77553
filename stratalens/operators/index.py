"""An index of vectors: lists by nearest centroid, quantised residuals, exact distances for what is left.

What a search scans is codes: a vector's list, and its residual cut into parts
of which each is the number of a word in that part's code book.  Slices of
codes meet blocks of queries by matrix products.  The best by code are then
measured by their whole vectors.  Vectors and their codes are columns of a
table of a versioned snapshot whose files each hold few lists, so a scan reads
the column of codes, measuring reads the files of some lists only, an insertion
adds files, and a deletion rewrites those it touches.

``search_index`` may miss a neighbour; ``search_exactly`` may not: every vector
is known to lie within a stored distance of what its code stands for, which
bounds how near it can be.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, score_of_distance
from ..session import materialize
from ..sources.snapshots import SnapshotLog
from .blocks import CHUNK, best_by, best_of_slice, matrix, places, slices_and_blocks, unit

#: Vectors that centroids and code books are fitted on, at most, by the hashes of their ids; centroids, at most; words of a book; rounds of fitting.
TRAIN, LISTS, WORDS, ROUNDS = 1_000_000, 4_096, 256, 5
#: Coordinates of one part of a residual; files that a build writes.
WIDTH, FILES = 4, 64
#: How many times k vectors are measured after the codes are scanned.
RERANK = 16


@dataclass
class Model:
    centres: np.ndarray  # lists, dimensions
    books: np.ndarray  # parts, words, width
    radius: np.ndarray  # of each list: how far its farthest vector is

    @property
    def parts(self) -> int:
        return len(self.books)

    def padded(self, points: np.ndarray) -> np.ndarray:
        return np.pad(points, ((0, 0), (0, self.parts * self.books.shape[2] - points.shape[1])))

    def lists_of(self, points: np.ndarray) -> np.ndarray:
        return (points @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code, and how far the vector is from what they stand for."""
        which = self.lists_of(points)
        rest = self.padded(points - self.centres[which]).reshape(len(points), self.parts, -1)
        codes = np.empty((len(points), self.parts), np.uint8)
        off = np.zeros(len(points))
        for j, book in enumerate(self.books):
            apart = ((rest[:, j, None, :] - book[None]) ** 2).sum(axis=2)
            codes[:, j] = apart.argmin(axis=1)
            off += apart.min(axis=1)
        return which, codes, np.sqrt(off)


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors, each scaled to length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _means(points: DataFrame, vector: str, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], old: np.ndarray) -> np.ndarray:
    """One round of k-means: sums by slot within tasks, added up by Spark; a slot that nothing fell to stays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(old.shape), np.zeros(len(old), np.int64)
        for batch in batches:
            if batch.num_rows:
                slots, values = place(_matrix(batch.column(0)))
                np.add.at(sums, slots, values)
                counts += np.bincount(slots, minlength=len(old))
        met = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.float64()))], names=["slot", "n", "total"])

    made = points.select(vector).mapInArrow(partial, "slot int, n long, total array<double>")
    rows = made.groupBy("slot").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).collect()  # a row a slot
    new = old.copy()
    for r in rows:
        new[r["slot"]] = np.array(r["total"]) / r["n"]
    return new


def fit(vectors: DataFrame, total: int, *, key: str, vector: str, lists: int, words: int = WORDS, width: int = WIDTH, rounds: int = ROUNDS) -> Model:
    """Centroids by rounds over up to TRAIN vectors in place, then code books of the residuals in the same way."""
    points = vectors.select(key, vector)
    if total > TRAIN:
        points = materialize(points.where(F.pmod(F.xxhash64(key), F.lit(total)) < TRAIN))
    first = points.orderBy(F.xxhash64(key), key).limit(max(lists, words)).select(vector).toArrow().column(0).combine_chunks()
    start = _matrix(first)
    centres = start[:lists]
    for _ in range(rounds):
        near = lambda p, c=centres: ((p @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1), p)
        centres = _means(points, vector, near, centres)
    parts = math.ceil(start.shape[1] / width)
    words = min(words, len(start))
    model = Model(centres, np.zeros((parts, words, width)), np.zeros(len(centres)))
    rest = model.padded(start[:words] - centres[model.lists_of(start[:words])])
    books = rest.reshape(words, parts, width).transpose(1, 0, 2)
    for _ in range(rounds):

        def coded(p: np.ndarray, m: Model = Model(centres, books, model.radius)) -> tuple[np.ndarray, np.ndarray]:
            which, codes, _ = m.encode(p)
            left = m.padded(p - m.centres[which]).reshape(len(p), parts, width)
            return (codes + np.arange(parts) * words).ravel(), left.reshape(-1, width)

        books = _means(points, vector, coded, books.reshape(-1, width)).reshape(parts, words, width)
    return Model(centres, books, model.radius)


def _coded(vectors: DataFrame, model: Model, key: str, vector: str) -> DataFrame:
    """vectors with list, code, off (the distance to what the code stands for) and away (to the centroid)."""
    at = vectors.columns.index(vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column(at))
                which, codes, off = model.encode(points)
                away = np.sqrt(((points - model.centres[which]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(away)], [*batch.schema.names, "list", "code", "off", "away"])

    return vectors.mapInArrow(run, f"{schema}, list int, code binary, off double, away double")


def _known(vectors: DataFrame, vector: str) -> DataFrame:
    """Vectors that have a direction."""
    return vectors.where(F.exists(vector, lambda x: x != 0))


def _store(log: SnapshotLog, coded: DataFrame, key: str) -> list[dict]:
    """Write coded vectors by list; a hot list is four tasks' work."""
    placed = coded.repartition(min(FILES, coded.sparkSession.sparkContext.defaultParallelism * 4), "list", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("list", key)
    return log.write("vectors", placed, uuid.uuid4().hex)


def _as_rows(spark: SparkSession, model: Model) -> DataFrame:
    rows = [("centre", i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(model.centres, model.radius))]
    rows += [("word", i, w.tolist(), float(model.books.shape[1])) for i, w in enumerate(model.books.reshape(-1, model.books.shape[2]))]
    return spark.createDataFrame(rows, "kind string, place int, value array<double>, more double").coalesce(1)


def load_model(log: SnapshotLog) -> Model | None:
    """The model of an index, some thousand short rows; None for an empty index."""
    if log.version() < 0:
        return None
    rows = log.read("model").orderBy("kind", "place").collect()
    centres, words = ([r for r in rows if r["kind"] == k] for k in ("centre", "word"))
    book = np.array([r["value"] for r in words])
    return Model(np.array([r["value"] for r in centres]), book.reshape(-1, int(words[0]["more"]), book.shape[1]), np.array([r["more"] for r in centres]))


def _commit(log: SnapshotLog, seen: int, model: Model, coded: DataFrame, key: str, gone: list[tuple[str, str]]) -> int:
    """Coded vectors, and the model with the radius that they need, in one version."""
    for r in coded.groupBy("list").agg(F.max("away").alias("away")).collect():  # LISTS rows at most
        model.radius[r["list"]] = max(model.radius[r["list"]], r["away"])
    rows = _as_rows(log.spark, model)
    old = [("model", r["uri"]) for r in log.pruned("model", seen).select("uri").collect()]
    added = _store(log, coded, key) + log.write("model", rows, uuid.uuid4().hex)
    return log.commit(added, [*gone, *old], schemas={"vectors": coded.schema, "model": rows.schema}, read_version=seen)


def build_index(vectors: DataFrame, path: str, *, key: str = "id", vector: str = "vector", lists: int | None = None, **sizes: int) -> int:
    """Fit a model and index every vector that has a direction, neither null nor zero; how many lists there are, 0 if there is no such vector.

    An index that is there already is replaced, in one version.
    """
    known = _known(vectors, vector)
    total = known.count()
    if not total:
        return 0
    model = fit(known, total, key=key, vector=vector, lists=lists or max(1, min(LISTS, math.isqrt(total))), **sizes)
    log = SnapshotLog(vectors.sparkSession, path)
    seen = log.version()
    gone = [("vectors", r["uri"]) for r in log.pruned("vectors", seen).select("uri").collect()] if seen >= 0 else []
    _commit(log, seen, model, materialize(_coded(known, model, key, vector)), key, gone)
    return len(model.centres)


def insert_vectors(vectors: DataFrame, path: str, *, key: str = "id", vector: str = "vector") -> int:
    """Add vectors to an index, in new files; the model's centroids and books stay.  The version."""
    log = SnapshotLog(vectors.sparkSession, path)
    model, seen = load_model(log), log.version()
    return _commit(log, seen, model, materialize(_coded(_known(vectors, vector), model, key, vector)), key, [])


def delete_vectors(spark: SparkSession, path: str, keys: DataFrame, *, key: str = "id") -> int:
    """Take the vectors of keys out: files that hold one are rewritten without it.  The version."""
    log = SnapshotLog(spark, path)
    seen, gone = log.version(), keys.select(key).distinct()
    held = log.read("vectors", seen)
    uris = [r["uri"] for r in held.select(key, F.col("_metadata.file_path").alias("uri")).join(gone, key, "left_semi").select("uri").distinct().collect()]  # files, not rows
    if not uris:
        return seen
    kept = materialize(spark.read.schema(held.schema).parquet(*uris).join(gone, key, "left_anti").select(*held.columns))
    return log.commit(_store(log, kept, key), [("vectors", u) for u in uris], schemas={"vectors": kept.schema}, read_version=seen)


def _looked_at(points: np.ndarray, reach: np.ndarray, model: Model, probes: int | None) -> np.ndarray:
    """Which lists each query looks into: the nearest ``probes``, or all that may hold a vector within its reach."""
    apart = np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + (model.centres**2).sum(axis=1)[None] - 2 * points @ model.centres.T, 0))
    return apart - model.radius <= reach[:, None] if probes is None else apart.argsort(axis=1).argsort(axis=1) < probes


class _Codes:
    """Codes of a slice beside a block of queries: squared distances to what the codes stand for, some rows at a time."""

    def __init__(self, own: pa.Table, asked: pa.Table, model: Model, probes: int | None):
        self.model, self.points = model, unit(matrix(asked.column("vector")))
        self.reach = asked.column("reach").to_numpy()
        self.lists, self.offs = own.column("list").to_numpy(), own.column("off").to_numpy()
        self.codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(own.num_rows, model.parts)
        self.looks = _looked_at(self.points, self.reach, model, probes)
        self.own = (self.points**2).sum(axis=1)[:, None]

    def near(self, a: int, z: int) -> np.ndarray:
        words = self.model.books[np.arange(self.model.parts), self.codes[a:z]].reshape(min(z, len(self.codes)) - a, -1)
        stood = words[:, : self.points.shape[1]] + self.model.centres[self.lists[a:z]]
        left = (words[:, self.points.shape[1] :] ** 2).sum(axis=1)  # words of a part that is wider than what is left of a vector
        out = np.maximum(self.own + ((stood**2).sum(axis=1) + left)[None] - 2 * self.points @ stood.T, 0)
        out[~self.looks[:, self.lists[a:z]]] = np.inf
        return out

    def within(self, a: int, z: int) -> np.ndarray:
        """Rows that may lie within a query's reach."""
        near = self.near(a, z)
        return np.isfinite(near) & (np.sqrt(near) - self.offs[a:z] <= self.reach[:, None])


def _candidates(stored: DataFrame, queries: DataFrame, model: Model, key: str, *, probes: int | None, most: int) -> DataFrame:
    """(qid, key, list, near) of the ``most`` nearest of each query by codes; a call hands on no more of a query and slice."""
    kinds = queries.schema["qid"].dataType.simpleString(), stored.schema[key].dataType.simpleString()

    def scan(own: pa.Table, asked: pa.Table) -> pa.Table:
        q, v, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if own.num_rows and asked.num_rows:
            codes = _Codes(own, asked, model, probes)
            best, place = np.full((asked.num_rows, 0), np.inf), np.zeros((asked.num_rows, 0), np.int64)
            for i in range(0, own.num_rows, CHUNK):
                near = codes.near(i, i + CHUNK)
                best, place = np.c_[best, near], np.c_[place, np.broadcast_to(np.arange(i, i + near.shape[1]), near.shape)]
                if best.shape[1] > most:
                    keep = np.argpartition(best, most, axis=1)[:, :most]
                    best, place = np.take_along_axis(best, keep, axis=1), np.take_along_axis(place, keep, axis=1)
            q, at = np.nonzero(np.isfinite(best))
            v, d = place[q, at], best[q, at]
        return pa.table([asked.column("qid").take(pa.array(q)), own.column(key).take(pa.array(v)), own.column("list").take(pa.array(v)), pa.array(d)], names=["qid", key, "list", "near"])

    found = slices_and_blocks(stored.select(key, "list", "code", "off"), key, queries, scan, f"qid {kinds[0]}, `{key}` {kinds[1]}, list int, near double")
    return best_by(found, most, "near", key, name="_nth").drop("_nth")


def _sure(stored: DataFrame, queries: DataFrame, model: Model, k: int, key: str, vector: str) -> DataFrame:
    """(qid, key, list) of the k nearest vectors of each query (qid, vector, reach): every code that may lie within reach is measured where it lies."""
    kinds = queries.schema["qid"].dataType.simpleString(), stored.schema[key].dataType.simpleString()

    def scan(own: pa.Table, asked: pa.Table) -> pa.Table:
        q, v, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if own.num_rows and asked.num_rows:
            points = matrix(asked.column("vector"))
            q, v, d = best_of_slice(matrix(own.column(vector), points.shape[1]), points, places(own.column(key)), k, _Codes(own, asked, model, None).within)
        return pa.table([asked.column("qid").take(pa.array(q)), own.column(key).take(pa.array(v)), own.column("list").take(pa.array(v)), pa.array(d)], names=["qid", key, "list", "near"])

    found = slices_and_blocks(stored.select(key, "list", "code", "off", vector), key, queries, scan, f"qid {kinds[0]}, `{key}` {kinds[1]}, list int, near double")
    return best_by(found, k, "near", key, name="_nth").drop("_nth")


def _measured(log: SnapshotLog, version: int, found: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """The k nearest candidates of each query by their whole vectors, read from files of the candidates' lists."""
    found = materialize(found.select("qid", key, "list"))
    lists = [r["list"] for r in found.select("list").distinct().collect()]  # LISTS at most
    stored = log.read("vectors", version, list=lists).drop("code", "off", "away")
    both = stored.join(found, ["list", key]).drop("list").join(queries.select("qid", F.col("vector").alias("_query")), "qid")
    apart = both.withColumn("distance", cosine_distance(vector, F.col("_query"))).drop("_query")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", key))
    return apart.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", score_of_distance(F.col("distance")))


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int | None = None, rerank: int = RERANK, exact: bool = False, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest vectors of each query (qid, vector): qid, rank, the vectors' columns, distance and score.

    Codes are scanned in the ``probes`` nearest lists (all, if none is given),
    and ``rerank`` times k of a query are measured.  With ``exact`` the k-th
    distance so found is a bound: every list and code that may lie within it is
    looked at again, and what is left is measured, so no neighbour is missed.
    Queries without a direction have no neighbours.
    """
    log = SnapshotLog(spark, path)
    model, version = load_model(log), log.version()
    if model is None:
        return spark.createDataFrame([], "qid long, rank int, distance double, score double")
    asked = _known(queries.select("qid", "vector"), "vector").withColumn("reach", F.lit(math.inf))
    stored = log.read("vectors", version)
    best = _measured(log, version, _candidates(stored, asked, model, key, probes=probes or len(model.centres), most=rerank * k), asked, k, key, vector)
    if not exact:
        return best
    bound = best.groupBy("qid").agg(F.when(F.count("*") == k, F.sqrt(2 * F.max("distance")) + 1e-6).alias("_reach"))
    asked = asked.drop("reach").join(bound, "qid", "left").select("qid", "vector", F.coalesce("_reach", F.lit(math.inf)).alias("reach"))
    asked = materialize(asked)
    return _measured(log, version, _sure(stored, asked, model, k, key, vector), asked, k, key, vector)


def search_index(spark: SparkSession, path: str, query: Sequence[float], k: int, **options) -> DataFrame:
    """The k nearest of one query, with distance and score."""
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "qid int, vector array<double>")
    return search_many(spark, path, asked, k, **options).orderBy("rank").drop("qid", "rank")
